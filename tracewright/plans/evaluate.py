"""Evaluation over a corpus of packages: expectations, rates, ratchets, mutations, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.scoring import TIERS
from tracewright.operators.verdicts import LABELS, label_rank

# The host and the seed of mutations.
SWAPPED_HOST = "attacker-controlled-mirror.example.net"
MUTATION_SEED = 1234


def label_distribution(verdicts: DataFrame, sample: int | None = None) -> DataFrame:
    """(label, n) over all packages, or over the first `sample` by id."""
    rows = verdicts.orderBy("pkg_id").limit(sample) if sample else verdicts
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def missed_expectations(verdicts: DataFrame, findings: DataFrame, chains: DataFrame, pins: DataFrame) -> DataFrame:
    """(pkg_id, kind, detail) of every expectation that does not hold.

    `pins`: pkg_id, min_label, rules, capabilities, provenance (arrays), chain (boolean).
    """
    seen = findings.groupBy("pkg_id").agg(F.collect_set("rule_id").alias("_rules"), F.collect_set("capability").alias("_capabilities"), F.array_distinct(F.flatten(F.collect_list("provenance"))).alias("_provenance"))
    has_chain = chains.select("pkg_id").distinct().withColumn("_chain", F.lit(True))
    joined = pins.join(verdicts.select("pkg_id", "label"), "pkg_id", "left").join(seen, "pkg_id", "left").join(has_chain, "pkg_id", "left")
    none = F.array().cast("array<string>")
    lacking = lambda want, got: F.array_join(F.array_sort(F.array_except(F.coalesce(want, none), F.coalesce(got, none))), ", ")
    told = [
        (F.coalesce(label_rank(F.col("label")), F.lit(-1)) < label_rank(F.coalesce("min_label", F.lit("SUSPICIOUS"))), "LABEL_MISS", F.coalesce("label", F.lit("not scanned"))),
        (lacking(F.col("rules"), F.col("_rules")) != "", "WRONG_REASON", lacking(F.col("rules"), F.col("_rules"))),
        (lacking(F.col("capabilities"), F.col("_capabilities")) != "", "WRONG_REASON", lacking(F.col("capabilities"), F.col("_capabilities"))),
        (lacking(F.col("provenance"), F.col("_provenance")) != "", "PROVENANCE_MISS", lacking(F.col("provenance"), F.col("_provenance"))),
        (F.coalesce("chain", F.lit(False)) & F.col("_chain").isNull(), "WRONG_REASON", F.lit("no chain")),
    ]
    rows = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))) for bad, kind, detail in told]))
    return joined.select("pkg_id", F.inline(rows))


def false_positive_rate(verdicts: DataFrame) -> DataFrame:
    """(n, convicted, rate): how many packages are labelled dangerous or worse."""
    grave = F.count_if(label_rank(F.col("label")) >= LABELS.index("DANGEROUS"))
    return verdicts.agg(F.count("*").alias("n"), grave.alias("convicted")).select("n", "convicted", (F.col("convicted") / F.when(F.col("n") > 0, F.col("n"))).alias("rate"))


def ratchet(measured: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, value, allowed, holds): a metric may not exceed its baseline; one without baseline holds."""
    joined = measured.join(baseline.select("metric", F.col("value").alias("allowed")), "metric", "left")
    return joined.select("metric", "value", "allowed", F.coalesce(F.col("value") <= F.col("allowed"), F.lit(True)).alias("holds"))


def tool_swapped(text: Column) -> Column:
    """The downloader's first use with its usual flags, then the first that is left, as another tool's; null where it does not apply."""
    once = F.regexp_replace(text, r"(?s)^(.*?)curl -sL", "$1wget -qO-")
    twice = F.regexp_replace(once, r"(?s)^(.*?)curl", "$1wget")
    return F.when(text.contains("curl") & ~text.contains("wget"), twice)


def host_swapped(text: Column) -> Column:
    return F.when(text.contains("webhook.site"), F.replace(text, F.lit("webhook.site"), F.lit(SWAPPED_HOST)))


def lines_shuffled(text: Column, seed: int = MUTATION_SEED) -> Column:
    """Lines in an order that a seed and the text decide; null for three lines or fewer."""
    lines = F.split(text, "\n", -1)
    keyed = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.xxhash64(F.lit(seed), text, i).alias("k"), i.alias("i"), x.alias("line"))))
    return F.when(F.size(lines) > 3, F.array_join(F.transform(keyed, lambda k: k["line"]), "\n"))


def mutations(texts: DataFrame) -> DataFrame:
    """(pkg_id, path, mutation, text) of every mutation that applies."""
    made = F.map_from_arrays(F.array(F.lit("curl_to_wget"), F.lit("swap_domain"), F.lit("reorder_lines")), F.array(tool_swapped(F.col("text")), host_swapped(F.col("text")), lines_shuffled(F.col("text"))))
    return texts.select("pkg_id", "path", F.explode(made).alias("mutation", "text")).where("text is not null")


def status_rollup(ledger: DataFrame) -> DataFrame:
    """(status, bytes, files) over ledger entries."""
    return ledger.groupBy("status").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


def by_tier(findings: DataFrame) -> DataFrame:
    """`findings` with the certain ones first, else as found."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    return findings.orderBy("pkg_id", rank, "finding_ord")
