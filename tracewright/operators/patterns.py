"""The pattern scan: every match of every rule in every layer, with its lines.

A layer is a row (pkg_id, path, layer_ord, text, provenance, line_offset, anchor_line, lang). A rule's matches and
the gaps between them are taken by two native regular expression functions, and positions follow from running counts
of their line feeds. A rule runs on a layer only if the layer holds one of the strings that a match must contain.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.functions.rules import BIDI, DETECTORS, RULES, SHELL, ZERO_WIDTH, Rule

LAYER = "pkg_id string, path string, layer_ord int, text string, provenance array<string>, line_offset int, anchor_line int, lang string"
FINDING_COLUMNS = ("pkg_id", "path", "layer_ord", "detector", "detector_ord", "rule_ord", "match_ord", "rule_id", "capability", "severity", "confidence", "start_line", "end_line", "matched_text", "provenance")
RULE_ORD = {r.rule_id: i for i, r in enumerate(RULES)}


def guarded(rule: Rule, lower: Column) -> Column:
    """Whether a layer can match at all."""
    return reduce(lambda a, b: a | b, [lower.contains(n) for n in rule.needs]) if rule.needs else F.lit(True)


def _spans(rule: Rule, text: Column, lower: Column) -> Column:
    """Null where nothing matches; else the rule's number, its matches and the gaps around them. The gaps are taken only where something matched."""
    found = F.when(guarded(rule, lower), F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)))
    told = lambda hits: F.when(F.size(hits) > 0, F.struct(F.lit(RULE_ORD[rule.rule_id]).alias("rule_ord"), hits.alias("hits"), F.split(text, rule.java, -1).alias("gaps")))
    return F.get(F.transform(F.array(found), told), F.lit(0))


def rule_table(spark) -> DataFrame:
    """One row per rule."""
    rows = [(RULE_ORD[r.rule_id], r.rule_id, r.detector, DETECTORS.index(r.detector), r.capability, r.severity, r.confidence, r.lang) for r in RULES]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, detector string, detector_ord int, capability string, severity string, confidence double, lang string")


def matches(layers: DataFrame, rules: Iterable[Rule] = RULES, text: str = "text") -> DataFrame:
    """`layers` with a row per match: rule_ord, match_ord, hit, start_line and end_line within the text."""
    searched = layers.withColumn("_lower", T.lower_for_search(F.col(text)))
    spans = F.array_compact(F.array(*[_spans(r, F.col(text), F.col("_lower")) for r in rules]))
    each = searched.withColumn("_span", F.explode(spans)).drop("_lower")
    placed = each.select(*layers.columns, F.col("_span.rule_ord").alias("rule_ord"), T.placed_hits(F.col("_span.hits"), F.col("_span.gaps")).alias("_placed"))
    kept = [c for c in placed.columns if c != "_placed"]
    return placed.select(*kept, F.posexplode("_placed").alias("match_ord", "_m")).select(*kept, "match_ord", F.col("_m.hit").alias("hit"), F.col("_m.start_line").alias("start_line"), F.col("_m.end_line").alias("end_line"))


def on_lines(line: Column) -> Column:
    """A line within a layer as a line of its file: decoded layers are anchored, others shifted."""
    return F.coalesce(F.col("anchor_line"), line + F.col("line_offset"))


def scan(layers: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Findings of the pattern rules over `layers`, without those that only a normalized shell text shows."""
    facts = rule_table(layers.sparkSession).withColumnRenamed("lang", "_spoken")
    found = matches(layers, rules).join(F.broadcast(facts), "rule_ord")
    provenance = F.when(F.col("_spoken").isNotNull(), F.concat("provenance", F.array(F.concat(F.lit("lang:"), "_spoken")))).otherwise(F.col("provenance"))
    return found.withColumn("provenance", provenance).select(
        "pkg_id", "path", "layer_ord", "detector", "detector_ord", "rule_ord", "match_ord", "rule_id", "capability", "severity", "confidence",
        on_lines(F.col("start_line")).alias("start_line"), on_lines(F.col("end_line")).alias("end_line"), T.evidence(F.col("hit")).alias("matched_text"), "provenance",
    )


def shell_rescan(layers: DataFrame) -> DataFrame:
    """Shell findings that only a text without quote and separator tricks shows, and one summary for each such layer.

    A match on a line where the raw text has the same rule's match already is not told again.
    """
    rules = [r for r in RULES if r.detector == SHELL]
    key = ["pkg_id", "path", "layer_ord"]
    tricked = layers.where(T.shell_tricked(F.col("text")))
    both = tricked.select(*[c for c in layers.columns if c != "text"], F.posexplode(F.array("text", T.shell_normal(F.col("text")))).alias("_normal", "text"))
    on_line = Window.partitionBy(*key, "rule_ord", "start_line")
    found = matches(both, rules).drop("text").withColumn("_first", F.min("_normal").over(on_line)).where("_first = 1")
    anew = found.join(F.broadcast(rule_table(layers.sparkSession).drop("lang")), "rule_ord")
    recovered = F.struct(
        (F.col("rule_ord") + 1000).alias("rule_ord"), "match_ord", "rule_id", "capability", "severity", F.lit(0.5).alias("confidence"),
        on_lines(F.col("start_line")).alias("start_line"), on_lines(F.col("end_line")).alias("end_line"), T.evidence(F.col("hit")).alias("matched_text"), F.concat("provenance", F.array(F.lit("shell-deobfuscated"))).alias("provenance"),
    )
    each = anew.groupBy(*key, "detector", "detector_ord", "line_offset", "anchor_line", "provenance").agg(F.collect_list(recovered).alias("_found"), F.array_sort(F.collect_set("rule_id")).alias("_rules"))
    line = on_lines(F.lit(1))
    summary = F.struct(
        F.lit(2000).alias("rule_ord"), F.lit(0).alias("match_ord"), F.lit("SC-SH12").alias("rule_id"), F.lit("obfuscation").alias("capability"), F.lit("medium").alias("severity"), F.lit(0.7).alias("confidence"),
        line.alias("start_line"), line.alias("end_line"), F.concat(F.lit("quote-splitting / $IFS obfuscation constructing: "), F.array_join("_rules", ", ")).alias("matched_text"), F.col("provenance").alias("provenance"),
    )
    # The findings of one layer, whose number its text bounds.
    return each.select(*key, "detector", "detector_ord", F.explode(F.concat("_found", F.array(summary))).alias("f")).select(*key, "detector", "detector_ord", "f.*").select(*FINDING_COLUMNS)


def _named_characters(layers: DataFrame, names: dict[str, str], rule_id: str, severity: str, confidence: float, order: int) -> DataFrame:
    """One finding for each of the given characters, told by code point and name."""
    chars = "".join(names)
    some = layers.where(F.length(F.translate("text", chars, "")) < F.length("text"))
    lines = some.select("*", F.posexplode(F.split("text", "\n", -1)).alias("_line", "_text"))
    each = lines.select("*", F.posexplode(F.regexp_extract_all("_text", F.lit(f"[{chars}]"), F.lit(0))).alias("_at", "_char"))
    label = F.element_at(F.create_map(*[F.lit(x) for c, n in names.items() for x in (c, f"U+{ord(c):04X} {n}")]), F.col("_char"))
    line = on_lines(F.col("_line") + 1)
    return each.select(
        "pkg_id", "path", "layer_ord", F.lit("unicode").alias("detector"), F.lit(DETECTORS.index("unicode")).alias("detector_ord"), F.lit(order).alias("rule_ord"), (F.col("_line") * 100_000 + F.col("_at")).cast("int").alias("match_ord"), F.lit(rule_id).alias("rule_id"),
        F.lit("obfuscation").alias("capability"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), line.alias("start_line"), line.alias("end_line"), label.alias("matched_text"), "provenance",
    )


def mixed_script(layers: DataFrame) -> DataFrame:
    """One finding for each word of four letters or more that mixes ASCII letters with letters of another script than Latin."""
    some = layers.where(F.col("text").rlike(r"[^\x00-\x7F]"))
    lines = some.select("*", F.posexplode(F.split("text", "\n", -1)).alias("_line", "_text")).where(F.col("_text").rlike(r"[\p{L}&&[^\p{IsLatin}]]"))
    words = lines.select("*", F.posexplode(F.regexp_extract_all("_text", F.lit(r"\p{L}{4,}"), F.lit(0))).alias("_at", "_word"))
    mixed = words.where(F.col("_word").rlike("[A-Za-z]") & F.col("_word").rlike(r"[\p{L}&&[^\p{IsLatin}\x00-\x7F]]"))
    line = on_lines(F.col("_line") + 1)
    return mixed.select(
        "pkg_id", "path", "layer_ord", F.lit("unicode").alias("detector"), F.lit(DETECTORS.index("unicode")).alias("detector_ord"), F.lit(3).alias("rule_ord"), (F.col("_line") * 100_000 + F.col("_at")).cast("int").alias("match_ord"), F.lit("SC-U3").alias("rule_id"),
        F.lit("obfuscation").alias("capability"), F.lit("medium").alias("severity"), F.lit(0.35).alias("confidence"), line.alias("start_line"), line.alias("end_line"), F.substring("_word", 1, 80).alias("matched_text"), "provenance",
    )


def unicode_scan(layers: DataFrame) -> DataFrame:
    return _named_characters(layers, ZERO_WIDTH, "SC-U1", "medium", 0.5, 1).unionByName(_named_characters(layers, BIDI, "SC-U2", "high", 0.7, 2)).unionByName(mixed_script(layers))

