"""Written tables that cut lineage, kept in the shared folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: No _SUCCESS file: nobody waits for one here, and in a local store without Hadoop's native library it costs the driver two processes of five.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one of our own only where the setting is absent and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = f"file://{tempfile.mkdtemp(prefix='tracewright-')}"
    return _own[sc.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and return a DataFrame that reads the written table. Lost executors reread it instead of recomputing."""
    spark = df.sparkSession
    path = f"{root(spark)}/tracewright/{uuid.uuid4().hex}-{label}"
    with _small_batches(spark):
        df.write.options(**UNMARKED).parquet(path)
    atexit.register(_delete_at_exit, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What goes to Python workers is bounded in bytes meanwhile, unless the session sets a bound itself: whole texts are long, and a batch is held in the JVM and in the worker at once."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def discard(df: DataFrame) -> None:
    """Delete the files of a stashed table that no later step reads."""
    spark = df.sparkSession
    base = f"{root(spark)}/tracewright/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(base.split(":", 1)[-1].lstrip("/")):
            _delete(spark, folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` does not have, in whatever case, and that differ from each other."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"_{name}"
        while new.lower() in held:
            new = f"_{new}"
        held.add(new.lower())
        out.append(new)
    return out
