"""Scanning packages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.plans.scan import scan
from tracewright.sources.packages import FILES


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over Parquet files of the files table."""
    return spark.readStream.schema(FILES).parquet(folder)


def scan_stream(files: DataFrame, verdicts: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Scan each micro-batch's packages and write their labels under the batch's number, so that a retry overwrites its own rows."""

    def per_batch(batch: DataFrame, number: int) -> None:
        done = scan(batch)
        done.verdicts.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{verdicts}/batch={number}")

    writer = files.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
