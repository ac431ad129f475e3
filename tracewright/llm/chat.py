r"""Chat formatting with a grammar round trip, with DataFrame functions only.

A turn is written as `<|im_start|>ROLE\nTEXT<|im_end|>\n`. A deterministic parser reads the written text back: it
splits at the start mark, takes the role up to the first line feed and the text up to the end mark, and undoes
escapes. A conversation whose recovered turns differ from its source is written again with its conflicting texts
and roles escaped, and is read back once more; one that would still differ stops the job.

Escapes: a backslash goes between `<` and `|`, after any that stand there, so that no control string can occur in
an escaped text, and reading back takes one away. In roles, moreover, a line feed is written as `<\n` after the
same fashion: `<`, backslashes, `n`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
LEARNED_ROLE = "assistant"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape_text(F.regexp_replace(role, r"<(\\+)n", r"<\\$1n")), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape_text(role), r"<\\n", "\n"), r"<\\(\\+)n", r"<$1n")


def written(turns: Column) -> Column:
    """The formatted text of an array of (role, text) as they stand."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + BREAK))), "")


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), with escapes undone; text is null where the grammar fails."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p, i: (i > 0) | (p != ""))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        rest = F.substring(part, F.length(role) + 2, F.length(part))
        text = F.substring(rest, F.lit(1), F.length(rest) - len(END + BREAK))
        good = part.contains("\n") & rest.endswith(END + BREAK) & ~text.contains(END)
        return F.struct(unescape_role(role).alias("role"), F.when(good, unescape_text(text)).alias("text"))

    return F.transform(parts, turn)


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from one row per turn; turns in the order of (turn, role, text)."""
    tidy = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = tidy.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def segments_of(turns: Column) -> Column:
    """Runs of formatted text in order, `learned` where the loss mask covers them: assistant content, marks excluded."""

    def runs(turn: Column) -> Column:
        pieces = ((F.concat(F.lit(START), turn["role"], F.lit("\n")), F.lit(False)), (turn["text"], unescape_role(turn["role"]) == LEARNED_ROLE), (F.lit(END + BREAK), F.lit(False)))
        return F.array(*[F.struct(text.alias("text"), learned.alias("learned")) for text, learned in pieces])

    return F.flatten(F.transform(turns, runs))


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments, escaped) per conversation of `rows` (conv_id, turn, role, text).

    `segments` are runs of the formatted text, whose concatenation it is, with a flag that is true where the loss
    mask covers them. Null roles and texts count as empty; rows without a turn number come first; repeated rows are
    turns of their own; rows without a conv_id form one conversation. Empty assistant texts keep an empty segment.
    An empty table gives an empty table. A conversation is one text, so all of its turns are gathered in one row.
    """
    plain = conversations_of(rows).withColumn("plain", written(F.col("turns")))
    checked = plain.withColumn("escaped", ~F.coalesce(parsed(F.col("plain")) == F.col("turns"), F.lit(False)))
    safe = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape_text(t["text"]).alias("text")))
    chosen = checked.withColumn("sent", F.when(F.col("escaped"), safe).otherwise(F.col("turns")))
    chosen = chosen.withColumn("formatted", F.when(F.col("escaped"), written(F.col("sent"))).otherwise(F.col("plain")))
    same = F.when(F.col("escaped"), F.coalesce(parsed(F.col("formatted")) == F.col("turns"), F.lit(False))).otherwise(F.lit(True))
    proven = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")).cast("string"))
    return chosen.select("conv_id", proven.alias("formatted"), segments_of(F.col("sent")).alias("segments"), "escaped")


def read_back(done: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the formatted text and its mask alone."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["learned"]), lambda s: unescape_text(s["text"])), "")
    read = done.select("conv_id", parsed(F.col("formatted")).alias("turns"), masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
