"""Corroboration of findings, tiers, techniques, batches for a judge and what it answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hosts, decoding tags, tiers, techniques, thresholds, verdict words.
DROP_HOSTS = ("webhook.site", "pastebin.com", "ngrok.io", "ngrok-free.app", "requestbin.com", "discord.com/api/webhooks", "discordapp.com/api/webhooks", "transfer.sh", "file.io", "0x0.st", "anonfiles.com", "pipedream.net")
DECODE_TAGS = ("base64", "hex", "rot13", "url-encode", "base64+zlib")
STRONG, WEAK = 0.85, 0.45
TECHNIQUES = {
    "credential_access": "T1552 (Unsecured Credentials)",
    "exfiltration": "T1041 (Exfiltration Over C2 Channel)",
    "hidden_execution": "T1059 (Command and Scripting Interpreter)",
    "stage2_fetch": "T1105 (Ingress Tool Transfer)",
    "persistence": "T1547 (Boot or Logon Autostart Execution)",
    "anti_forensics": "T1070.003 (Clear Command History)",
    "agent_manipulation": "AML.T0051 (LLM Prompt Injection) / OWASP LLM01",
    "task_then_payload": "AML.T0051 (LLM Prompt Injection) / OWASP LLM01",
    "scope_mismatch": "OWASP LLM08 (Excessive Agency)",
    "obfuscation": "T1027 (Obfuscated Files or Information)",
    "ssrf": "T1090 (Proxy) / OWASP LLM-adjacent SSRF",
    "privilege_escalation": "T1548 (Abuse Elevation Control Mechanism)",
    "harmful_content": "OWASP LLM09 (Misinformation) / AML.T0048 (Harmful Content Generation)",
    "anti_refusal": "AML.T0054 (LLM Jailbreak) / OWASP LLM01",
    "agent_snooping": "T1082 (System Information Discovery) / OWASP LLM06",
}
RULE_TECHNIQUES = {"SC-ST1": "T1546 (Event Triggered Execution)", "SC-ST6": "T1090 (Proxy)"}
SEVERITIES = ("low", "medium", "high", "critical")
TIERS = ("confirmed", "likely", "possible", "insufficient_context", "false_positive_suspected")
JUDGED = {"malicious": "confirmed", "benign-but-risky": "likely", "false-positive": "false_positive_suspected", "insufficient-context": "insufficient_context"}
CLEARABLE = ("scope_mismatch", "agent_snooping", "unknown")
CLAIMABLE = ("credential_access", "exfiltration", "agent_manipulation", "hidden_execution")
READ_FILES, READ_CHARS = 5, 6000
BATCH = 60


def first_drop_host(text: Column) -> Column:
    """The first listed host that a text names, letter for letter."""
    return F.coalesce(*[F.when(text.contains(h), F.lit(h)) for h in DROP_HOSTS])


def corroborated(findings: DataFrame, texts: DataFrame, of_files: DataFrame, chained: DataFrame, declared: DataFrame) -> DataFrame:
    """`findings` with raised confidence, notes in the order of the steps, chain_id, chain_ids and scope_mismatch.

    Steps: provenance, reputation, reachability, chains, scope. `declared`: pkg_id, path, tools (lower case).
    """
    hosts = texts.select("pkg_id", "path", first_drop_host(F.col("text")).alias("_file_host")).where("_file_host is not null")
    stage = of_files.select("pkg_id", "path", (F.col("has_root") & ~F.col("reachable")).alias("_loose"))
    gain = F.when(F.col("same_file"), F.lit(0.15)).otherwise(F.lit(0.1))
    alone = F.when(F.col("sink_unattended"), F.array(F.lit(0.15))).otherwise(F.array().cast("array<double>"))
    ends = chained.select("pkg_id", F.col("source_ord").alias("finding_ord"), "chain_ord", "chain_id", F.array(gain).alias("gains"), F.lit(False).alias("unattended"))
    ends = ends.unionByName(chained.select("pkg_id", F.col("sink_ord").alias("finding_ord"), "chain_ord", "chain_id", F.concat(F.array(gain), alone).alias("gains"), F.col("sink_unattended").alias("unattended")))
    per_finding = ends.groupBy("pkg_id", "finding_ord").agg(F.sort_array(F.collect_list(F.struct("chain_ord", "chain_id", "gains"))).alias("_chains"), F.count_if("unattended").alias("_unattended"))
    joined = findings.join(hosts, ["pkg_id", "path"], "left").join(stage, ["pkg_id", "path"], "left").join(per_finding, ["pkg_id", "finding_ord"], "left").join(declared.select("pkg_id", "path", "tools"), ["pkg_id", "path"], "left")
    provenance = F.coalesce("provenance", F.array().cast("array<string>"))
    hidden = F.array_contains(provenance, "html-comment")
    unpacked = ~hidden & F.arrays_overlap(provenance, F.array(*[F.lit(t) for t in DECODE_TAGS]))
    host = F.when(F.col("capability").isin("exfiltration", "stage2_fetch"), F.coalesce(first_drop_host(F.col("matched_text")), F.col("_file_host")))
    tools = F.col("tools")
    grave = F.col("severity").isin("high", "critical") & tools.isNotNull()
    out = grave & F.col("capability").isin("exfiltration", "stage2_fetch") & ~tools.contains("network") & ~tools.contains("web") & ~tools.contains("bash")
    run = grave & (F.col("capability") == "hidden_execution") & ~tools.contains("bash") & ~tools.contains("shell") & ~tools.contains("exec")
    beyond = F.coalesce(out | run, F.lit(False))
    flat = F.flatten(F.transform("_chains", lambda c: c["gains"]))
    steps = F.concat(
        F.when(hidden | unpacked, F.array(F.lit(0.15))).otherwise(F.array().cast("array<double>")),
        F.when(host.isNotNull(), F.array(F.lit(0.25))).otherwise(F.array().cast("array<double>")),
        F.coalesce(flat, F.array().cast("array<double>")),
        F.when(beyond, F.array(F.lit(0.2))).otherwise(F.array().cast("array<double>")),
    )
    notes = F.array_compact(
        F.array(
            F.when(hidden, F.lit("hidden in an HTML comment")),
            F.when(unpacked, F.concat(F.lit("present only after decoding: "), F.array_join(provenance, "+"))),
            F.when(host.isNotNull(), F.concat(F.lit("names the drop site "), host)),
            F.when(F.coalesce("_loose", F.lit(False)), F.lit("file is not reachable from the root")),
            F.when(F.coalesce("_unattended", F.lit(0)) > 0, F.lit("its chain ends in a file that runs unattended")),
            F.when(beyond, F.lit("declared tools do not cover this capability")),
        )
    )
    raised = F.aggregate(steps, F.col("confidence"), lambda total, gain: F.least(F.lit(1.0), total + gain))
    chain_ids = F.coalesce(F.transform("_chains", lambda c: c["chain_id"]), F.array().cast("array<string>"))
    own = [c for c in findings.columns if c != "confidence"]
    return joined.select(*own, raised.alias("confidence"), notes.alias("notes"), F.get(chain_ids, 0).alias("chain_id"), chain_ids.alias("chain_ids"), beyond.alias("scope_mismatch"))


def tier() -> Column:
    """The tier that a finding gets without a judge; the first case that fits."""
    chained, severity, confidence = F.col("chain_id").isNotNull(), F.col("severity"), F.col("confidence")
    return (
        F.when((F.col("detector") == "structure") & (severity == "critical"), F.lit("confirmed"))
        .when(confidence < WEAK, F.lit("insufficient_context"))
        .when(chained & (severity == "critical"), F.lit("confirmed"))
        .when(chained & (severity == "high") & (confidence >= STRONG), F.lit("confirmed"))
        .when(chained & severity.isin("high", "critical"), F.lit("likely"))
        .when(severity == "critical", F.lit("likely"))
        .otherwise(F.lit("possible"))
    )


def techniques() -> Column:
    """By rule, else by capability, else unmapped."""
    by_rule = F.coalesce(*[F.when(F.col("rule_id") == r, F.lit(t)) for r, t in RULE_TECHNIQUES.items()])
    by_capability = F.coalesce(*[F.when(F.col("capability") == c, F.lit(t)) for c, t in TECHNIQUES.items()])
    return F.coalesce(by_rule, by_capability, F.lit("unmapped"))


def batches(findings: DataFrame, size: int = BATCH) -> DataFrame:
    """`findings` with batch and the id of each in its batch."""
    place = F.row_number().over(Window.partitionBy("pkg_id").orderBy("finding_ord")) - 1
    return findings.withColumn("batch", F.floor(place / size).cast("int")).withColumn("batch_key", F.concat("rule_id", F.lit(":"), (place % size).cast("string")))


def snippets(findings: DataFrame, texts: DataFrame, around: int = 2, most: int = 200) -> DataFrame:
    """`findings` with context: numbered lines around the first, each cut."""
    lines = F.split("text", "\n", -1)
    first = F.greatest(F.lit(1), F.col("start_line") - around)
    wanted = F.filter(F.sequence(first, F.greatest(first, F.col("end_line") + around)), lambda n: n <= F.size(lines))
    numbered = F.array_join(F.transform(wanted, lambda n: F.concat(n.cast("string"), F.lit(": "), F.substring(F.get(lines, n - 1), 1, most))), "\n")
    return findings.join(texts.select("pkg_id", "path", "text"), ["pkg_id", "path"], "left").withColumn("context", F.coalesce(numbered, F.lit(""))).drop("text")


def judged(findings: DataFrame, answers: DataFrame) -> DataFrame:
    """Tiers from a judge's `answers` (pkg_id, batch, batch_key, verdict); `findings` come from `batches`.

    A clean bill holds only for capabilities that a judge may clear, else the finding is possible. What an answered
    batch leaves out has insufficient context; a batch without any answer keeps the deterministic tier. Only the
    first of several answers to a finding counts, and one with an unknown word counts as left out.
    """
    word = F.lower(F.trim("verdict"))
    mapped = F.coalesce(*[F.when(F.col("_word") == w, F.lit(t)) for w, t in JUDGED.items()])
    told = answers.select("pkg_id", "batch", "batch_key", word.alias("_word")).groupBy("pkg_id", "batch", "batch_key").agg(F.min("_word").alias("_word"))
    heard = told.select("pkg_id", "batch").distinct().withColumn("_heard", F.lit(True))
    joined = findings.join(told, ["pkg_id", "batch", "batch_key"], "left").join(heard, ["pkg_id", "batch"], "left").withColumn("_mapped", mapped)
    may = F.col("capability").isin(*CLEARABLE)
    answered = F.when((F.col("_mapped") == "false_positive_suspected") & ~may, F.lit("possible")).otherwise(F.coalesce("_mapped", F.lit("insufficient_context")))
    return joined.withColumn("tier", F.when(F.col("_heard"), answered).otherwise(tier())).drop("_word", "_heard", "_mapped")


def reading_matter(texts: DataFrame) -> DataFrame:
    """(pkg_id, path, text): what a semantic reader is shown, the head of the first markdown files of a package."""
    place = F.row_number().over(Window.partitionBy("pkg_id").orderBy(F.split("path", "/")))
    return texts.where(F.lower("path").rlike(r"\.(md|markdown)$")).withColumn("_n", place).where(F.col("_n") <= READ_FILES).select("pkg_id", "path", F.substring("text", 1, READ_CHARS).alias("text"))


def grounded(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """Semantic findings SC-SEM1 from `claims` (pkg_id, path, capability, severity, quote) whose quote stands in what was shown.

    An unknown capability is agent_manipulation, and a severity other than high is medium.
    """
    met = claims.where(F.coalesce("quote", F.lit("")) != "").join(reading_matter(texts), ["pkg_id", "path"])
    head = F.expr("substring(text, 1, position(quote, text) - 1)")
    capability = F.when(F.col("capability").isin(*CLAIMABLE), F.col("capability")).otherwise(F.lit("agent_manipulation"))
    severity = F.when(F.col("severity") == "high", F.lit("high")).otherwise(F.lit("medium"))
    line = (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")
    kept = met.where(F.expr("position(quote, text) > 0"))
    return kept.select("pkg_id", "path", F.lit("SC-SEM1").alias("rule_id"), capability.alias("capability"), severity.alias("severity"), F.lit(0.6).alias("confidence"), line.alias("start_line"), line.alias("end_line"), F.col("quote").alias("matched_text"))
