"""Registry of the subpackage's queries and of the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import ann, chat, hnsw, mixing, packing, sharding, simhash, substring, toxicity, url_filter
from tracewright.llm.oracles import ORACLES

URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]
HARD_CASE = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in pieces of sequences of at most 1024 tokens."""
    pieces = packing.packed(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from the labels of rows that are not held out."""
    return toxicity.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.95 or more and the smallest vec_id of its component."""
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its component."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    return url_filter.judged(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 8, sizes as near equal as whole groups of equal texts allow."""
    dealt = sharding.sharded(_table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each vector whose vec_id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from every formatted conversation, and from one whose texts look like the template."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", HARD_CASE), (-1, 1, "assistant", HARD_CASE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.formatted(rows.unionByName(hard)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, and which are left without windows that a smaller doc_id has too."""
    return substring.repeats(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's last stage."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_packing, op2_toxicity, op3_hnsw, op4_simhash, op5_url_filter, op6_sharding, op7_ann, op8_chat_format, op9_mixing, op10_substring, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
