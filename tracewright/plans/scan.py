"""The whole scan: files of many packages to findings, chains, a ledger and a label each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.functions.rules import DETECTORS
from tracewright.operators import decode, documents, graph, judge, manifests, patterns, scoring, syntax, verdicts
from tracewright.scratch import stash

try:
    import yaml
except ImportError:  # then front matter is read by patterns
    yaml = None

# Order of the stages that make findings.
CONTENT, ADVISORY, STRUCTURE, REFERENCE, SEMANTIC = range(5)


@dataclass
class Scan:
    texts: DataFrame
    findings: DataFrame
    nodes: DataFrame
    edges: DataFrame
    chains: DataFrame
    ledger: DataFrame
    verdicts: DataFrame
    modes: DataFrame | None = None


def all_layers(texts: DataFrame) -> DataFrame:
    return documents.layers(texts).unionByName(decode.decoded_layers(texts)).unionByName(decode.normal_layers(texts))


#: A detector of one's own: layers in, findings with patterns.FINDING_COLUMNS out.
Detector = Callable[[DataFrame], DataFrame]


def content_findings(layers: DataFrame, detectors: Iterable[Detector] = ()) -> DataFrame:
    """What every detector finds in every layer, `detectors` after our own."""
    broken = F.get("provenance", 0).startswith(decode.FAILED)
    lost, layers = layers.where(broken), layers.where(~F.coalesce(broken, F.lit(False)))
    out = patterns.scan(layers).unionByName(decode.failures(lost))
    for order, detector in enumerate(detectors):
        out = out.unionByName(detector(layers).select(*patterns.FINDING_COLUMNS).withColumn("detector_ord", F.lit(len(DETECTORS) + order)))
    for part in (patterns.shell_rescan(layers), patterns.unicode_scan(layers), syntax.syntax_scan(layers)):
        out = out.unionByName(part)
    return out


def reference_findings(unresolved: DataFrame) -> DataFrame:
    """SC-REF1 for each mention of a file that is not there."""
    return unresolved.select(
        "pkg_id", "path", F.lit(0).alias("layer_ord"), F.lit("component-graph").alias("detector"), F.when(F.col("kind") == "reference", 0).otherwise(1).alias("detector_ord"), F.col("line").cast("int").alias("rule_ord"), F.col("ord").cast("int").alias("match_ord"),
        F.lit("SC-REF1").alias("rule_id"), F.lit("unscanned_reference").alias("capability"), F.lit("medium").alias("severity"), F.lit(1.0).alias("confidence"), F.col("line").cast("int").alias("start_line"), F.col("line").cast("int").alias("end_line"), F.col("target").alias("matched_text"), F.array().cast("array<string>").alias("provenance"),
    )


TOOL_KEYS = ("allowed-tools", "allowed_tools", "tools")


def tools_said(front: str) -> str | None:
    """What front matter declares under the first of the keys that says something, in lower case; null where it cannot be read."""
    try:
        fields = yaml.safe_load(front)
    except Exception:  # front matter that does not parse declares nothing
        return None
    if not isinstance(fields, dict):
        return None
    return next((str(fields[k]).lower() for k in TOOL_KEYS if fields.get(k)), None)


def declared_tools(texts: DataFrame) -> DataFrame:
    """(pkg_id, path, tools): what a document's front matter declares, in lower case; the first key that says something."""
    fronted = texts.where(documents.is_markdown(F.col("path"))).select("pkg_id", "path", F.regexp_extract(F.regexp_replace("text", "^\ufeff", ""), documents.FRONT_MATTER, 2).alias("front"))
    named = fronted.where(F.col("front").contains("tools"))
    if yaml is None:
        return named.select("pkg_id", "path", _tools_by_pattern(F.col("front")).alias("tools")).where("tools is not null")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([tools_said(f) for f in batch.column(2).to_pylist()], pa.string())], ["pkg_id", "path", "tools"])

    return named.mapInArrow(per_batch, "pkg_id string, path string, tools string").where("tools is not null")


def _tools_by_pattern(front: Column) -> Column:
    def value(key: str) -> Column:
        said = T.stripped(F.regexp_extract(front, rf"(?m)^{key}:([^\n]*(?:\n[ \t-][^\n]*)*)", 1))
        return F.when(~said.isin("", "[]", "{}", "''", '""', "null", "~", "false", "0"), F.lower(said))

    return F.coalesce(*[value(k) for k in TOOL_KEYS])


def numbered(findings: DataFrame, files: DataFrame) -> DataFrame:
    """`findings` (with stage) and finding_ord, the place in the order in which one pass over a package finds them."""
    order = Window.partitionBy("pkg_id").orderBy("stage", F.coalesce("file_ord", F.lit(1 << 30)), "layer_ord", "detector_ord", "rule_ord", "match_ord", "rule_id", "matched_text")
    placed = findings.join(graph.ordered_files(files).select("pkg_id", "path", "file_ord"), ["pkg_id", "path"], "left")
    return placed.withColumn("finding_ord", F.row_number().over(order)).drop("file_ord", "layer_ord", "detector_ord", "rule_ord", "match_ord")


def failed_stages(findings: DataFrame) -> DataFrame:
    """(pkg_id, stage) of manifests that could not be read and of detectors that failed on a file."""
    name = F.when(F.col("detector") == "structure", F.lit("structure-manifest")).otherwise(F.col("detector"))
    return findings.where(F.col("rule_id") == "SC-SCN1").select("pkg_id", F.concat(name, F.lit(":"), "path").alias("stage")).distinct()


def integrity_findings(failed: DataFrame) -> DataFrame:
    """One package-level SC-SCN1 for the stages that gave nothing; it comes after tiering and keeps the default tier."""
    named = F.array_join(F.array_sort(F.collect_set(F.substring_index("stage", ":", 1))), ", ")
    return failed.groupBy("pkg_id").agg(F.concat(F.lit("failed layers: "), named).alias("matched_text"))


def scan(files: DataFrame, advisories: DataFrame | None = None, claims: DataFrame | None = None, detectors: Iterable[Detector] = (), asked: judge.Judge | None = None) -> Scan:
    """Scan `files` (pkg_id, path, content, size, is_binary). Packages are independent; all of them go in one job.

    `advisories` (ecosystem, name, version, advisory_id) and a semantic reader's `claims` are optional. `detectors` are
    tables of findings from layers beside our own; `asked` judges the findings in place of the fixed tiers.
    """
    read = stash(documents.texts(files), "texts")
    edges, unresolved = graph.edges_and_unresolved(read, files)
    edges, unresolved = stash(edges, "edges"), stash(unresolved, "unresolved")
    of_files = stash(graph.nodes(files, edges), "nodes")
    structural = manifests.structure_scan(read).unionByName(manifests.unreferenced_code(files, of_files))
    staged = [(CONTENT, content_findings(stash(all_layers(read), "layers"), detectors)), (STRUCTURE, structural), (REFERENCE, reference_findings(unresolved))]
    if advisories is not None:
        staged.append((ADVISORY, manifests.advisory_scan(read, advisories)))
    raw = None
    for stage, part in staged:
        part = part.withColumn("stage", F.lit(stage))
        raw = part if raw is None else raw.unionByName(part)
    if claims is not None:
        critical = raw.where("severity = 'critical'").select("pkg_id").distinct()
        told = scoring.grounded(claims, read).join(critical, "pkg_id", "left_anti")
        raw = raw.unionByName(told.withColumns({"layer_ord": F.lit(0), "detector": F.lit("semantic-pass"), "detector_ord": F.lit(0), "rule_ord": F.lit(0), "match_ord": F.lit(0), "provenance": F.array().cast("array<string>"), "stage": F.lit(SEMANTIC)}))
    found = stash(numbered(raw, files), "findings")
    of_files = stash(graph.promoted(of_files, found), "staged")
    chained = stash(graph.chains(found, of_files, edges), "chains")
    scored = scoring.corroborated(found, read, of_files, chained, declared_tools(read))
    tiered, replied = judge.judged(scored, read, asked)
    failed = failed_stages(found)
    integrity = integrity_findings(failed).select(
        "pkg_id", F.lit("<scan>").alias("path"), F.lit("scan-integrity").alias("detector"), F.lit("SC-SCN1").alias("rule_id"), F.lit("unknown").alias("capability"), F.lit("medium").alias("severity"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "matched_text",
        F.array().cast("array<string>").alias("provenance"), F.lit(9).alias("stage"), F.lit(1 << 30).alias("finding_ord"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("notes"), F.lit(None).cast("string").alias("chain_id"), F.array().cast("array<string>").alias("chain_ids"), F.lit(False).alias("scope_mismatch"), F.lit("possible").alias("tier"),
    )
    final = stash(tiered.unionByName(integrity).withColumn("attack_technique", scoring.techniques()), "scored")
    entries = stash(verdicts.ledger(files, read), "ledger")
    labels = verdicts.verdicts(files.select("pkg_id"), final, edges, entries, failed)
    return Scan(read, final, of_files, edges, chained, entries, labels, judge.modes(files, replied, asked, found))
