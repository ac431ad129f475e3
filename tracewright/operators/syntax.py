"""Findings from the syntax tree of Python layers."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.rules import DETECTORS
from tracewright.operators.patterns import on_lines

# Called names and the rules that they are.
CALLS = {"eval": ("SC-C1", "high"), "exec": ("SC-C2", "high"), "compile": ("SC-C3", "medium"), "__import__": ("SC-C4", "medium"), "system": ("SC-C5", "high"), "popen": ("SC-C6", "high")}
SHELL_CALLERS = {"run", "call", "Popen", "check_output", "check_call"}
PATTERN_MODULES = {"re", "regex"}
EVIDENCE = 400

_SCHEMA = pa.schema(
    [("pkg_id", pa.string()), ("path", pa.string()), ("layer_ord", pa.int32()), ("rule_ord", pa.int32()), ("match_ord", pa.int32()), ("rule_id", pa.string()), ("capability", pa.string()), ("severity", pa.string()), ("confidence", pa.float64())]
    + [("first", pa.int32()), ("last", pa.int32()), ("matched_text", pa.string()), ("provenance", pa.list_(pa.string())), ("line_offset", pa.int32()), ("anchor_line", pa.int32())]
)


def called(node: ast.Call) -> tuple[str | None, str | None]:
    """(name, name of what it is taken from) of a call by a name or an attribute."""
    match node.func:
        case ast.Name(id=name):
            return name, None
        case ast.Attribute(attr=name, value=ast.Name(id=owner)):
            return name, owner
        case ast.Attribute(attr=name):
            return name, None
    return None, None


def risky_calls(source: str) -> Iterator[tuple[str, str, str, float, ast.Call]]:
    """(rule, capability, severity, confidence, node) in the order of a breadth-first walk; none where the source does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call):
            continue
        name, owner = called(node)
        if name in CALLS and not (name == "compile" and owner in PATTERN_MODULES):
            yield *(CALLS[name][0], "hidden_execution", CALLS[name][1], 0.6), node
        if name in SHELL_CALLERS:
            for keyword in node.keywords:
                if keyword.arg == "shell" and isinstance(keyword.value, ast.Constant) and keyword.value.value is True:
                    yield "SC-C7", "hidden_execution", "high", 0.65, node
        if name == "getattr" and len(node.args) >= 2:
            yield "SC-C8", "obfuscation", "low", 0.3, node


def layer_calls(source: str, layer: dict) -> list[dict]:
    """Findings of one layer as rows. A layer on which the walk fails is told as one SC-SCN1 instead, and the others go on."""
    try:
        return [
            layer | {"rule_ord": 0, "match_ord": i, "rule_id": rule_id, "capability": capability, "severity": severity, "confidence": confidence, "first": node.lineno, "last": node.end_lineno or node.lineno, "matched_text": (ast.get_source_segment(source, node) or "")[:EVIDENCE]}
            for i, (rule_id, capability, severity, confidence, node) in enumerate(risky_calls(source))
        ]
    except Exception as error:  # whatever a hostile source provokes must not take down the scan
        return [layer | {"rule_ord": 0, "match_ord": 0, "rule_id": "SC-SCN1", "capability": "unknown", "severity": "medium", "confidence": 1.0, "first": 1, "last": 1, "matched_text": f"code-ast failed: {type(error).__name__}"}]


def syntax_scan(layers: DataFrame) -> DataFrame:
    """Findings of the call rules over the layers that are Python."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                rows += layer_calls(row.pop("text"), row)
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    python = layers.where(F.col("lang") == "python").select("pkg_id", "path", "layer_ord", "text", "provenance", "line_offset", "anchor_line")
    schema = "pkg_id string, path string, layer_ord int, rule_ord int, match_ord int, rule_id string, capability string, severity string, confidence double, first int, last int, matched_text string, provenance array<string>, line_offset int, anchor_line int"
    found = python.mapInArrow(per_batch, schema)
    return found.select(
        "pkg_id", "path", "layer_ord", F.lit("code-ast").alias("detector"), F.lit(DETECTORS.index("code-ast")).alias("detector_ord"), "rule_ord", "match_ord", "rule_id", "capability", "severity", "confidence",
        on_lines(F.col("first")).alias("start_line"), on_lines(F.col("last")).alias("end_line"), "matched_text", "provenance",
    )
