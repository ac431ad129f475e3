"""Layers that only a decoder or a normal form shows.

A native guard picks the texts that hold a candidate; those alone go through Arrow to Python, where decoding nests.
"""

from __future__ import annotations

import ast
import base64
import binascii
import codecs
import re
import unicodedata
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as T

# Candidate shapes, depth, least lengths, the words that make a rotation credible.
MAX_DEPTH = 4
LEAST_CHARS = 16
MAX_INFLATED = 8_000_000  # our own bound, four times what is scanned of a file
BASE64 = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=])"
HEX = r"(?<![0-9a-fA-F])(?:[0-9a-fA-F]{2}){10,}(?![0-9a-fA-F])"
PERCENT = r"(?:%[0-9a-fA-F]{2}){4,}"
TELLING = r"\b(curl|bash|import|eval|exec|http)\b"
TAG_FIRST, TAG_LAST, TAG_CANCEL, LEAST_TAGS = 0xE0020, 0xE007E, 0xE007F, 12
DECODED_FROM, NORMAL_FROM = 10_000, 20_000
FAILED = "failed:"  # begins the provenance of a layer that stands for a step that failed

_KINDS = (("base64", re.compile(BASE64)), ("hex", re.compile(HEX)), ("url-encode", re.compile(PERCENT)))
_TAGS = re.compile(f"[{chr(TAG_FIRST)}-{chr(TAG_LAST)}]+{chr(TAG_CANCEL)}?")
_FOLD = str.maketrans(T.CONFUSABLES)


def readable(data: bytes) -> str | None:
    """UTF-8 text that is printable or has several lines."""
    try:
        out = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return out if out.isprintable() or "\n" in out else None


def inflated(data: bytes, most: int = MAX_INFLATED) -> str | None:
    """Compressed UTF-8 text of at most `most` bytes; more than that is not unpacked, so that a small input cannot fill a worker."""
    for form in (zlib.MAX_WBITS, zlib.MAX_WBITS | 16):
        unpack = zlib.decompressobj(form)
        try:
            raw = unpack.decompress(data, most + 1)
            if len(raw) > most or not unpack.eof:
                continue
            out = raw.decode("utf-8")
        except (zlib.error, UnicodeDecodeError):
            continue
        if out:
            return out
    return None


def decoded(kind: str, raw: str) -> tuple[str, str] | None:
    """(kind, text) of a candidate, or None."""
    if kind == "url-encode":
        out = urllib.parse.unquote(raw)
        return (kind, out) if out and out != raw else None
    try:
        data = base64.b64decode(raw, validate=True) if kind == "base64" else bytes.fromhex(raw)
    except (binascii.Error, ValueError):
        return None
    plain = readable(data)
    if plain is not None:
        return (kind, plain) if plain else None
    packed = inflated(data) if kind == "base64" else None
    return (f"{kind}+zlib", packed) if packed else None


def spans(text: str, depth: int = 0, chain: tuple[str, ...] = ()) -> Iterator[tuple[int, tuple[str, ...], str]]:
    """(offset of the outermost candidate, encodings from outside in, text) of everything encoded in a text."""
    if depth >= MAX_DEPTH:
        return
    for kind, pattern in _KINDS:
        for m in pattern.finditer(text):
            found = decoded(kind, m[0]) if len(m[0]) >= LEAST_CHARS else None
            if found:
                inner = (*chain, found[0])
                yield m.start(), inner, found[1]
                for _, deeper, out in spans(found[1], depth + 1, inner):
                    yield m.start(), deeper, out
    if depth == 0:
        turned = codecs.decode(text, "rot_13")
        if turned != text and re.search(TELLING, turned, re.IGNORECASE):
            yield 0, ("rot13",), turned
            for _, deeper, out in spans(turned, 1, ("rot13",)):
                yield 0, deeper, out


def parses_as_python(text: str) -> bool:
    bare = text.strip()
    try:
        return bool(bare) and bool(ast.parse(bare) or True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def encoded_candidate(text: Column) -> Column:
    """Whether a text can hold anything that `spans` decodes."""
    return F.regexp_like(text, F.lit(BASE64)) | F.regexp_like(text, F.lit(HEX)) | F.regexp_like(text, F.lit(PERCENT)) | F.regexp_like(T.rot13(text), F.lit("(?iU)" + TELLING))


def decoded_layers(texts: DataFrame) -> DataFrame:
    """A layer for each decoded span; its findings are anchored to the line of the outermost candidate."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pkg_id, path, text in zip(*(c.to_pylist() for c in batch.columns)):
                one = {"pkg_id": pkg_id, "path": path, "line_offset": 0}
                try:
                    found = [(text.count("\n", 0, offset) + 1, list(chain), out) for offset, chain, out in spans(text)]
                    rows += [one | {"layer_ord": DECODED_FROM + i, "text": out, "provenance": chain, "anchor_line": line, "lang": "python" if parses_as_python(out) else None} for i, (line, chain, out) in enumerate(found)]
                except Exception as error:  # whatever a hostile text provokes must not take down the scan
                    rows.append(one | {"layer_ord": DECODED_FROM, "text": type(error).__name__, "provenance": [FAILED + "decode"], "anchor_line": 1, "lang": None})
            yield pa.RecordBatch.from_pylist(rows, schema=_LAYER)

    return texts.where(encoded_candidate(F.col("text"))).select("pkg_id", "path", "text").mapInArrow(per_batch, "pkg_id string, path string, layer_ord int, text string, provenance array<string>, line_offset int, anchor_line int, lang string")


_LAYER = pa.schema([("pkg_id", pa.string()), ("path", pa.string()), ("layer_ord", pa.int32()), ("text", pa.string()), ("provenance", pa.list_(pa.string())), ("line_offset", pa.int32()), ("anchor_line", pa.int32()), ("lang", pa.string())])


def tags_folded(text: str) -> str:
    """Runs of tag characters spelled out, with the cancel tag that ends them; short runs stay."""

    def spell(m: re.Match) -> str:
        letters = m[0].rstrip(chr(TAG_CANCEL))
        return "".join(chr(ord(c) - 0xE0000) for c in letters) if len(letters) >= LEAST_TAGS else m[0]

    return _TAGS.sub(spell, text)


def confusables_folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).translate(_FOLD)


def normal_form(text: str) -> tuple[str, list[str]]:
    """(text, techniques) without zero-width characters, tag runs and look-alike letters, in this order."""
    used = []
    for name, step in (("zero-width-join", lambda t: t.translate(dict.fromkeys(map(ord, T.ZERO_WIDTH)))), ("tag-fold", tags_folded), ("nfkc-homoglyph-fold", confusables_folded)):
        after = step(text)
        if after != text:
            used.append(name)
            text = after
    return text, used


def _form_or_failure(text: str) -> tuple[str, list[str]]:
    try:
        return normal_form(text)
    except Exception as error:  # told by `failures`, the other texts go on
        return type(error).__name__, [FAILED + "normalise"]


def failures(lost: DataFrame) -> DataFrame:
    """SC-SCN1 for each layer that stands for a step that failed on a file."""
    step = F.expr(f"substring(provenance[0], {len(FAILED) + 1})")
    return lost.select(
        "pkg_id", "path", "layer_ord", step.alias("detector"), F.lit(-1).alias("detector_ord"), F.lit(0).alias("rule_ord"), F.lit(0).alias("match_ord"), F.lit("SC-SCN1").alias("rule_id"), F.lit("unknown").alias("capability"), F.lit("medium").alias("severity"), F.lit(1.0).alias("confidence"),
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.concat(step, F.lit(" failed: "), "text").alias("matched_text"), F.array().cast("array<string>").alias("provenance"),
    )


def normal_texts(texts: DataFrame) -> DataFrame:
    """(pkg_id, path, text, techniques) of the texts that a normal form changes. ASCII texts are their own."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [_form_or_failure(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([f[0] for f in forms]), pa.array([f[1] for f in forms], pa.list_(pa.string()))], ["pkg_id", "path", "text", "techniques"])

    some = texts.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("pkg_id", "path", "text")
    return some.mapInArrow(per_batch, "pkg_id string, path string, text string, techniques array<string>").where(F.size("techniques") > 0)


def normal_layers(texts: DataFrame) -> DataFrame:
    """A layer for each text that a normal form changes; its lines are the file's."""
    return normal_texts(texts).select("pkg_id", "path", F.lit(NORMAL_FROM).alias("layer_ord"), "text", F.col("techniques").alias("provenance"), F.lit(0).alias("line_offset"), F.lit(None).cast("int").alias("anchor_line"), F.lit(None).cast("string").alias("lang"))
