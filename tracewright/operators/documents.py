"""Files to texts, and texts to layers: front matter, prose, code blocks, comments, whole files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as T

MAX_FILE_BYTES = 2_000_000

# The shapes of front matter, fences, comments, links and urls, in Java's spelling.
FRONT_MATTER = r"(?sU)^(---\s*\n)(.*?\n)---\s*\n"
FENCE = r"(?smdU)^```([\w+-]*)\s*\n(.*?)\n```"
COMMENT = r"(?s)<!--(.*?)-->"
LINK = r"\[([^\]]*)\]\(([^)]+)\)"
BARE_URL = r"(?U)(?<![\(\[])\bhttps?://[^\s)>\]\"']+"
PYTHON_TAGS = ("python", "py", "python3")


def texts(files: DataFrame) -> DataFrame:
    """(pkg_id, path, text) of the files that are read: not binary, small enough, valid UTF-8; line ends are LF.

    `files`: pkg_id, path, content, size, is_binary.
    """
    readable = files.where(~F.col("is_binary") & (F.col("size") <= MAX_FILE_BYTES))
    decoded = readable.select("pkg_id", "path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return decoded.where(F.col("text").isNotNull()).withColumn("text", T.unix_newlines(F.col("text")))


def is_markdown(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown)$")


def _layer(text: Column, tag: Column, offset: Column, lang: Column) -> Column:
    return F.struct(text.alias("text"), F.array(tag).alias("provenance"), offset.cast("int").alias("line_offset"), F.lit(None).cast("int").alias("anchor_line"), lang.cast("string").alias("lang"))


def parsed(markdown: DataFrame) -> DataFrame:
    """`markdown` (…, text) with front_matter, front_offset, body, body_offset, fences, comments and prose."""
    raw = F.regexp_replace("text", "^\ufeff", "")
    whole = F.regexp_extract("raw", FRONT_MATTER, 0)
    split = markdown.withColumn("raw", raw).withColumn("_front", whole)
    split = split.withColumn("front_matter", F.regexp_extract("raw", FRONT_MATTER, 2)).withColumn("front_offset", T.newlines(F.regexp_extract("raw", FRONT_MATTER, 1)))
    split = split.withColumn("body", F.substring("raw", F.length("_front") + 1, F.length("raw"))).withColumn("body_offset", T.newlines(F.col("_front")))
    found = split.withColumn("fences", T.placed(F.col("body"), FENCE)).withColumn("comments", T.placed(F.col("body"), COMMENT))
    prose = F.concat(F.repeat(F.lit("\n"), F.col("body_offset")), T.blanked(T.blanked(F.col("body"), FENCE), COMMENT))
    return found.withColumn("prose", prose).drop("_front")


def links(markdown: DataFrame) -> DataFrame:
    """(pkg_id, path, label, target, line): markdown links, and bare urls that are no link's target."""
    body = parsed(markdown)
    marked = F.transform(T.placed(F.col("body"), LINK), lambda m: F.struct(F.regexp_extract(m["hit"], LINK, 1).alias("label"), F.regexp_extract(m["hit"], LINK, 2).alias("target"), (m["start_line"] + F.col("body_offset")).alias("line")))
    bare = F.transform(T.placed(F.col("body"), BARE_URL), lambda m: F.struct(m["hit"].alias("label"), m["hit"].alias("target"), (m["start_line"] + F.col("body_offset")).alias("line")))
    both = body.withColumn("_links", marked)
    fresh = F.filter(bare, lambda b: ~F.array_contains(F.transform("_links", lambda x: x["target"]), b["target"]))
    return both.withColumn("_all", F.concat("_links", fresh)).select("pkg_id", "path", F.inline("_all"))


def layers(found: DataFrame) -> DataFrame:
    """The layers of every text: parts of markdown documents, other files whole."""
    none = F.lit(None).cast("string")
    markdown = parsed(found.where(is_markdown(F.col("path"))))
    front = F.when(F.col("front_matter") != "", F.array(_layer(F.col("front_matter"), F.lit("frontmatter"), F.col("front_offset"), none)))
    prose = F.array(_layer(F.col("prose"), F.lit("prose"), F.lit(0), none))

    def block(m: Column) -> Column:
        tag = F.regexp_extract(m["hit"], FENCE, 1)
        lang = F.when(F.lower(tag).isin(*PYTHON_TAGS), F.lit("python"))
        return _layer(F.regexp_extract(m["hit"], FENCE, 2), F.concat(F.lit("code-block:"), F.when(tag == "", F.lit("text")).otherwise(tag)), m["start_line"] + F.col("body_offset"), lang)

    def comment(m: Column) -> Column:
        return _layer(F.regexp_extract(m["hit"], COMMENT, 1), F.lit("html-comment"), m["start_line"] + F.col("body_offset") - 1, none)

    nothing = F.array().cast("array<struct<text:string,provenance:array<string>,line_offset:int,anchor_line:int,lang:string>>")
    parts = F.concat(F.coalesce(front, nothing), prose, F.transform("fences", block), F.transform("comments", comment))
    of_markdown = markdown.select("pkg_id", "path", F.posexplode(parts).alias("layer_ord", "_l"))
    lang = F.when(F.lower("path").endswith(".py"), F.lit("python"))
    of_files = found.where(~is_markdown(F.col("path"))).select("pkg_id", "path", F.lit(0).alias("layer_ord"), _layer(F.col("text"), F.lit("file"), F.lit(0), lang).alias("_l"))
    return of_markdown.unionByName(of_files).select("pkg_id", "path", "layer_ord", "_l.*")
