"""Sliding-window admission: at most LIMIT admitted requests of a key in any WINDOW seconds.

Rejected requests don't count, so the state is a fold over the requests of a key in order, not a window count.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW = 20, 60.0


class Bucket:
    """The admitted times of a key that still count."""

    def __init__(self, times: list[float] | None = None, limit: int = LIMIT, window: float = WINDOW):
        self.times, self.limit, self.window = deque(times or []), limit, window

    def admit(self, at: float | None) -> bool:
        if at is None or at != at:  # without a time: admitted, and not counted
            return True
        while self.times and at - self.times[0] > self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(at)
        return True


def admitted(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """`requests` (request_id, key, at) with `admitted`. A key's rows stand in order in one partition and are streamed; only its bucket is held."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = None, Bucket(limit=limit, window=window)
        for batch in batches:
            out = []
            for key, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if key != held:
                    held, bucket = key, Bucket(limit=limit, window=window)
                out.append(bucket.admit(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], ["request_id", "key", "at", "admitted"])

    rows = requests.select(F.col("request_id").cast("long").alias("request_id"), F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("at"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "request_id").mapInArrow(per_partition, "request_id long, key string, at double, admitted boolean")


def admitted_stream(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW) -> DataFrame:
    """The same over a stream: a key's bucket is kept as state between micro-batches."""

    def per_key(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bucket = Bucket(list(state.get[0]) if state.exists else None, limit, window)
        rows = pd.concat(list(frames)).sort_values(["at", "request_id"])
        rows["admitted"] = [bucket.admit(at) for at in rows["at"]]
        state.update((list(bucket.times),))
        yield rows[["request_id", "key", "at", "admitted"]]

    rows = requests.select(F.col("request_id").cast("long").alias("request_id"), F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("at"))
    return rows.groupBy("key").applyInPandasWithState(per_key, "request_id long, key string, at double, admitted boolean", "times array<double>", "append", "NoTimeout")
