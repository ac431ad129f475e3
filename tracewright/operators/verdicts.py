"""How much of a package was read, and the label that its findings give it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as T

# Labels by rank, the coverage below which nothing is cleared, long lines, languages without a syntax tree.
LABELS = ("NO_FINDINGS", "UNVERIFIED", "SUSPICIOUS", "DANGEROUS", "MALICIOUS")
LEAST_COVERAGE = 90.0
LONG_LINE = 2000
PATTERN_ONLY = (".sh", ".bash", ".zsh", ".rb", ".ps1", ".js", ".ts", ".php", ".pl", ".cjs", ".mjs")
GRAVE_ALONE = ("anti_forensics", "persistence", "agent_manipulation")


def label_rank(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), label) - 1


def ledger(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(pkg_id, path, status, bytes, reason, counted, analysed_bytes) of every file."""
    read = texts.select("pkg_id", "path", T.longest_line(F.col("text")).alias("_longest"))
    joined = files.select("pkg_id", "path", "size", "is_binary").join(read, ["pkg_id", "path"], "left")
    extension = F.when(F.col("path").contains("."), F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))).otherwise(F.lit(""))
    was_read, size = F.col("_longest").isNotNull(), F.col("size")
    long, patterned = was_read & (F.col("_longest") > LONG_LINE), was_read & extension.isin(*PATTERN_ONLY)
    status = F.when(long | patterned, F.lit("partial")).when(was_read, F.lit("analysed")).otherwise(F.lit("unanalysed"))
    reason = (
        F.when(long, F.lit("minified/very-long-line, pattern coverage reduced"))
        .when(patterned, F.lit("regex/pattern coverage only, no AST analysis for this language"))
        .when(was_read, F.lit(None).cast("string"))
        .when(F.col("is_binary"), F.lit("binary"))
        .otherwise(F.lit("unreadable"))
    )
    counted = was_read | ~F.col("is_binary")
    analysed = F.when(long, F.expr("size div 2")).when(was_read, size).otherwise(F.lit(0))
    return joined.select("pkg_id", "path", status.alias("status"), size.alias("bytes"), reason.alias("reason"), counted.alias("counted"), analysed.cast("long").alias("analysed_bytes"))


def coverage(entries: DataFrame) -> DataFrame:
    """(pkg_id, coverage_pct, coverage_note): the share of bytes read, to a tenth, and a sentence on it."""
    total, done = F.sum(F.when(F.col("counted"), F.col("bytes")).otherwise(0)), F.sum("analysed_bytes")
    count = lambda s: F.count_if(F.col("status") == s)
    unread = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("status") == "unanalysed", F.struct(F.split("path", "/").alias("place"), "reason")))), 1, 6), lambda e: F.concat(F.lit("1 "), e["reason"]))
    sums = entries.groupBy("pkg_id").agg(total.alias("_total"), done.alias("_done"), count("analysed").alias("_a"), count("partial").alias("_p"), count("unanalysed").alias("_u"), F.count("*").alias("_n"), unread.alias("_reasons"))
    pct = F.when(F.col("_total") == 0, F.lit(100.0)).otherwise(F.bround(100.0 * F.col("_done") / F.when(F.col("_total") > 0, F.col("_total")), 1))
    parts = F.array_compact(
        F.array(
            F.concat("_a", F.lit("/"), "_n", F.lit(" files fully analysed")),
            F.when(F.col("_p") > 0, F.concat("_p", F.lit(" partially analysed"))),
            F.when(F.col("_u") > 0, F.concat("_u", F.lit(" files unanalysed ("), F.array_join("_reasons", ", "), F.lit(")"))),
        )
    )
    out = sums.withColumn("coverage_pct", pct)
    return out.select("pkg_id", "coverage_pct", F.concat(F.col("coverage_pct").cast("string"), F.lit("% coverage — "), F.array_join(parts, "; "), F.lit(".")).alias("coverage_note"))


def corroborated_mediums(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """(pkg_id) with two medium findings of different rules in one file or in files with an edge between them.

    Two rules in a file are seen by counting. Across an edge it is enough to know each end's rules: their union has
    two, or either end has, so no pair of findings is made.
    """
    medium = findings.where((F.col("severity") == "medium") & (F.col("tier") != "false_positive_suspected")).select("pkg_id", "path", "rule_id").distinct()
    by_file = medium.groupBy("pkg_id", "path").agg(F.min("rule_id").alias("low"), F.max("rule_id").alias("high"))
    within = by_file.where("low < high").select("pkg_id")
    left = by_file.select("pkg_id", F.col("path").alias("src"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    right = by_file.select("pkg_id", F.col("path").alias("dst"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    across = edges.join(left, ["pkg_id", "src"]).join(right, ["pkg_id", "dst"]).where("least(l1, l2) < greatest(h1, h2)").select("pkg_id")
    return within.unionByName(across).distinct()


def verdicts(packages: DataFrame, findings: DataFrame, edges: DataFrame, entries: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """(pkg_id, label, coverage_pct, summary, n_findings) of every package of `packages` (pkg_id).

    The gravest label that fits. `findings` have tiers. `failed` (pkg_id, stage): steps that gave nothing; they keep a
    package from being found clean.
    """
    tier, severity = F.col("tier"), F.col("severity")
    grave = severity.isin("high", "critical")
    sums = findings.groupBy("pkg_id").agg(
        F.count_if((tier == "confirmed") & F.col("chain_id").isNotNull()).alias("_confirmed_chain"),
        F.count_if((tier == "confirmed") & (severity == "critical")).alias("_confirmed_critical"),
        F.bool_or((tier == "likely") & F.col("chain_id").isNotNull()).alias("_likely_chain"),
        F.bool_or(tier.isin("likely", "confirmed") & F.col("capability").isin(*GRAVE_ALONE)).alias("_alone"),
        F.bool_or(tier.isin("possible", "likely", "confirmed") & grave).alias("_grave"),
        F.bool_or((tier == "insufficient_context") & grave).alias("_open"),
        F.bool_or(F.col("capability") == "unscanned_reference").alias("_unscanned"),
        F.bool_or("scope_mismatch").alias("_scope"),
        F.count("*").alias("n_findings"),
    )
    mediums = corroborated_mediums(findings, edges).withColumn("_mediums", F.lit(True))
    joined = packages.select("pkg_id").distinct().join(sums, "pkg_id", "left").join(mediums, "pkg_id", "left").join(coverage(entries), "pkg_id", "left")
    if failed is not None:
        stages = failed.groupBy("pkg_id").agg(F.count("*").alias("_failed"))
        joined = joined.join(stages, "pkg_id", "left")
    else:
        joined = joined.withColumn("_failed", F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    pct, note = F.coalesce("coverage_pct", F.lit(100.0)), F.coalesce("coverage_note", F.lit("100.0% coverage — 0/0 files fully analysed."))
    convicted = n("_confirmed_chain") + n("_confirmed_critical")
    suspect = yes("_grave") | yes("_scope")
    label = (
        F.when(convicted > 0, F.lit("MALICIOUS"))
        .when(yes("_likely_chain") | yes("_alone"), F.lit("DANGEROUS"))
        .when(suspect | yes("_mediums"), F.lit("SUSPICIOUS"))
        .when((pct < LEAST_COVERAGE) | yes("_open") | yes("_unscanned"), F.lit("UNVERIFIED"))
        .when(n("_failed") > 0, F.lit("UNVERIFIED"))
        .otherwise(F.lit("NO_FINDINGS"))
    )
    why = (
        F.when(F.col("label") == "MALICIOUS", F.concat(convicted.cast("string"), F.lit(" confirmed finding(s) with corroborated evidence")))
        .when(F.col("label") == "DANGEROUS", F.lit("capability chain or high-risk behaviour, intent not confirmed"))
        .when((F.col("label") == "SUSPICIOUS") & suspect, F.lit("uncorroborated high-severity finding(s), or tools beyond the declared scope"))
        .when(F.col("label") == "SUSPICIOUS", F.lit("two or more independent medium findings corroborate each other"))
        .when(F.col("label") == "UNVERIFIED", F.concat_ws(", ", F.when(pct < LEAST_COVERAGE, F.lit("coverage below threshold")), F.when(yes("_open"), F.lit("a grave finding is unresolved")), F.when(yes("_unscanned"), F.lit("a named file was not part of the scan")), F.when(n("_failed") > 0, F.lit("a stage did not complete"))))
        .otherwise(F.lit("nothing found"))
    )
    out = joined.withColumn("label", label)
    return out.select("pkg_id", "label", pct.alias("coverage_pct"), F.concat("label", F.lit(" — "), why, F.lit(". "), note).alias("summary"), n("n_findings").cast("long").alias("n_findings"))
