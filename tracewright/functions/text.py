"""Column functions on text: newlines, lines, evidence, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.rules import ZERO_WIDTH

EVIDENCE_CHARS = 400

# Look-alike letters and the Latin letters that they stand for.
CONFUSABLES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
}


def unix_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF, as a text-mode reader makes them."""
    return F.regexp_replace(text, "\r\n?", "\n")


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def stripped(text: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def evidence(text: Column, limit: int = EVIDENCE_CHARS) -> Column:
    return F.substring(stripped(text), 1, limit)


def collapsed_evidence(text: Column, limit: int = 300) -> Column:
    """White space collapsed, cut with a mark that shows the cut."""
    flat = F.regexp_replace(stripped(text), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit), r"(?U)\s+$", ""), F.lit(" [...truncated]")))


def placed(text: Column, pattern: str) -> Column:
    """Every match of a Java pattern with the lines on which it starts and ends: array of (hit, start_line, end_line).

    Matches and the gaps between them come from two native functions; lines are running counts of their line feeds.
    """
    return placed_hits(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))


def placed_hits(hits: Column, gaps: Column) -> Column:
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<hit:string,start_line:int,end_line:int>>").alias("done"))

    def step(state: Column, h: Column) -> Column:
        first = state["line"] + h["before"]
        last = first + h["inside"]
        return F.struct(last.alias("line"), F.concat(state["done"], F.array(F.struct(h["hit"].alias("hit"), first.alias("start_line"), last.alias("end_line")))).alias("done"))

    counted = F.transform(hits, lambda h, i: F.struct(h.alias("hit"), newlines(h).alias("inside"), newlines(F.get(gaps, i)).alias("before")))
    return F.aggregate(counted, start, step, lambda s: s["done"])


def blanked(text: Column, pattern: str) -> Column:
    """Matches of a Java pattern replaced by their line feeds, so that later lines keep their numbers."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blanks = F.transform(hits, lambda h: F.repeat(F.lit("\n"), newlines(h)))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), blanks, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")


def longest_line(text: Column) -> Column:
    """Length of the longest line, broken at every character that ends a line."""
    lines = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0))


def lower_for_search(text: Column) -> Column:
    """Lower case for literal tests; the two letters that case folding takes for ASCII ones are made so."""
    return F.lower(F.translate(text, "\u017f\u212a", "sk"))


def without_zero_width(text: Column) -> Column:
    return F.translate(text, "".join(ZERO_WIDTH), "")


def rot13(text: Column) -> Column:
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    turned = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
    return F.translate(text, plain, turned)


# What a shell drops or splits at.
EMPTY_QUOTES = r"(?<=[A-Za-z0-9_])(['\"])\1(?=[A-Za-z0-9_])"
SINGLE_QUOTE = r"(?<=[A-Za-z0-9_])['\"](?=[A-Za-z0-9_])"
FIELD_SEPARATOR = r"\$\{?IFS\}?(?:\$\d)?"


def shell_tricked(text: Column) -> Column:
    """Whether `shell_normal` changes a text."""
    return F.regexp_like(text, F.lit(f"{EMPTY_QUOTES}|{SINGLE_QUOTE}|{FIELD_SEPARATOR}"))


def shell_normal(text: Column) -> Column:
    """Quotes between word characters dropped, then the field separator variable as a space.

    Empty pairs go before single quotes, and a lookaround is not consumed, so that one pass leaves nothing for a second.
    """
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, EMPTY_QUOTES, ""), SINGLE_QUOTE, ""), FIELD_SEPARATOR, " ")
