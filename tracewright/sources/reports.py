"""Reports: content addresses, the stored table, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.scoring import SEVERITIES, TIERS
from tracewright.plans.scan import Scan

RULESET_VERSION = "1"


def report_id(content: Column, version: str = RULESET_VERSION) -> Column:
    """The address of content under a rule set: part of a hash over version, a zero byte and the bytes."""
    return F.substring(F.sha2(F.concat(F.lit(version).cast("binary"), F.lit(b"\x00"), content.cast("binary")), 256), 1, 20)


def package_ids(files: DataFrame, version: str = RULESET_VERSION) -> DataFrame:
    """(pkg_id, report_id) over the digests of a package's paths and contents in order."""
    each = F.struct(F.split("path", "/").alias("place"), F.sha2(F.concat(F.col("path").cast("binary"), F.lit(b"\x00"), F.col("content")), 256).alias("digest"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda e: e["digest"]), "\n")
    return files.groupBy("pkg_id").agg(listed.alias("_all")).select("pkg_id", report_id(F.col("_all"), version).alias("report_id"))


def latest(reports: DataFrame) -> DataFrame:
    """The newest row of each report_id."""
    order = Window.partitionBy("report_id").orderBy(F.desc("scanned_at"))
    return reports.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upserted(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """`stored` with `fresh` rows in place of those with their report_id."""
    return stored.join(fresh.select("report_id"), "report_id", "left_anti").unionByName(latest(fresh))


def looked_up(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored reports of the wanted ids, marked as such."""
    return stored.join(wanted.select("report_id").distinct(), "report_id", "left_semi").withColumn("cached", F.lit(True))


def to_scan(files: DataFrame, stored: DataFrame, force: bool = False, own_key: bool = False) -> DataFrame:
    """Files of packages that have no stored report. A forced scan, or one with the caller's own key, takes all."""
    if force or own_key:
        return files
    known = package_ids(files).join(stored.select("report_id").distinct(), "report_id", "left_semi")
    return files.join(known.select("pkg_id"), "pkg_id", "left_anti")


def display_order() -> list[Column]:
    """By tier, then the gravest first, then as found."""
    rank = lambda names, c: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c))
    return [rank(TIERS, "tier"), -rank(SEVERITIES, "severity"), F.col("finding_ord")]


def _shown(found: DataFrame) -> DataFrame:
    keys = display_order()
    return found.select("pkg_id", F.struct(keys[0].alias("_1"), keys[1].alias("_2"), keys[2].alias("_3"), F.struct("rule_id", "capability", "severity", "tier", "confidence", F.col("path").alias("file"), "start_line", "end_line", "matched_text", "provenance", "attack_technique", "chain_id", "chain_ids", "detector", "notes").alias("f")).alias("_f"))


def nested(done: Scan) -> DataFrame:
    """One row per package with its findings, chains and ledger as arrays."""
    findings = _shown(done.findings).groupBy("pkg_id").agg(F.transform(F.sort_array(F.collect_list("_f")), lambda x: x["f"]).alias("findings"))
    chains = done.chains.groupBy("pkg_id").agg(F.sort_array(F.collect_list(F.struct("chain_ord", "chain_id", "source_rule", "sink_rule", "source_path", "sink_path", "same_file", "direct"))).alias("chains"))
    entries = done.ledger.groupBy("pkg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.split("path", "/").alias("place"), "path", "status", "bytes", "reason"))), lambda e: F.struct(e["path"].alias("path"), e["status"].alias("status"), e["bytes"].alias("bytes"), e["reason"].alias("reason"))).alias("ledger"))
    rows = done.verdicts.join(findings, "pkg_id", "left").join(chains, "pkg_id", "left").join(entries, "pkg_id", "left")
    return rows.withColumn("mode", F.lit(None).cast("string")) if done.modes is None else rows.join(done.modes, "pkg_id", "left")


def _mode(given: str | None) -> Column:
    """What a report says of its judge: the word given, else the scan's own."""
    return F.lit(given) if given else F.coalesce("mode", F.lit("deterministic"))


def as_json(done: Scan, mode: str | None = None) -> DataFrame:
    """(pkg_id, report): a JSON text per package."""
    rows = nested(done)
    return rows.select("pkg_id", F.to_json(F.struct("label", "coverage_pct", "summary", _mode(mode).alias("adjudicator_mode"), "findings", "chains", "ledger"), {"pretty": "true"}).alias("report"))


def as_markdown(done: Scan, mode: str | None = None) -> DataFrame:
    """(pkg_id, report): a Markdown text per package."""
    rows = nested(done)

    def finding(f: Column) -> Column:
        lines = [
            F.concat(F.lit("### "), f["rule_id"], F.lit(" — "), f["capability"], F.lit(" ["), f["tier"], F.lit("] ("), f["severity"], F.lit(")")),
            F.concat(F.lit("- **File**: `"), f["file"], F.lit(":"), f["start_line"], F.lit("-"), f["end_line"], F.lit("`")),
            F.concat(F.lit("- **Evidence**: `"), f["matched_text"], F.lit("`")),
            F.concat(F.lit("- **ATT&CK**: "), f["attack_technique"]),
            F.concat(F.lit("- **Confidence**: "), F.format_number(f["confidence"], 2)),
            F.when(F.size(f["notes"]) > 0, F.concat(F.lit("- **Notes**: "), F.array_join(f["notes"], "; "))),
            F.when(f["chain_id"].isNotNull(), F.concat(F.lit("- **Chain**: "), f["chain_id"])),
            F.when(F.size(f["provenance"]) > 0, F.concat(F.lit("- **Provenance**: "), F.array_join(f["provenance"], " -> "))),
        ]
        return F.array_join(F.array_compact(F.array(*lines)), "\n")

    chain = lambda c: F.concat(F.lit("- `"), c["chain_id"], F.lit("`: "), c["source_rule"], F.lit(" @ "), c["source_path"], F.when(c["same_file"], F.lit(" -> ")).otherwise(F.lit(" -> (cross-file) ")), c["sink_rule"], F.lit(" @ "), c["sink_path"])
    entry = lambda e: F.concat(F.lit("| `"), e["path"], F.lit("` | "), e["status"], F.lit(" | "), e["bytes"], F.lit(" | "), F.coalesce(e["reason"], F.lit("-")), F.lit(" |"))
    parts = [
        F.concat(F.lit("# Scan report\n\n**Verdict: "), F.col("label"), F.lit("**\n\n"), F.col("summary"), F.lit("\n\n_Adjudicator mode: "), _mode(mode), F.lit("_\n")),
        F.when(F.size("chains") > 0, F.concat(F.lit("## Capability chains\n"), F.array_join(F.transform("chains", chain), "\n"), F.lit("\n"))),
        F.concat(F.lit("## Findings\n"), F.when(F.size("findings") > 0, F.array_join(F.transform("findings", finding), "\n\n")).otherwise(F.lit("None.")), F.lit("\n")),
        F.concat(F.lit("## Coverage ledger\n\n| Path | Status | Bytes | Reason |\n|---|---|---|---|\n"), F.array_join(F.transform("ledger", entry), "\n")),
    ]
    return rows.select("pkg_id", F.array_join(F.array_compact(F.array(*parts)), "\n").alias("report"))
