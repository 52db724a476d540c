"""Keyed state with timers: copies dropped across batches, for a limited time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstCopies(StatefulProcessor):
    """Gives out the first row of a key, and forgets the key ``seconds`` of event time after it.

    Of rows of one batch the first by ``order`` counts. A timer runs on the watermark, so what a
    key costs ends with its time, and a copy that comes later than that is a first copy again.
    """

    def __init__(self, columns: list[str], order: str, ts: str, seconds: int):
        self.columns, self.order, self.ts, self.millis = columns, order, ts, seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "order string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            if self.seen.exists() or part.empty:
                continue
            part.columns = self.columns
            first = part.sort_values([self.order]).head(1)
            if best is None or first[self.order].iloc[0] < best[self.order].iloc[0]:
                best = first
        if best is not None:
            self.seen.update((str(best[self.order].iloc[0]),))
            self.handle.registerTimer(int(best[self.ts].iloc[0].timestamp() * 1000) + self.millis)
            yield best[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this provider; it keeps state on the executors' disks and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def first_copies(rows: DataFrame, key: str, order: str, ts: str, seconds: int, late: str = "0 seconds") -> DataFrame:
    """The rows of a stream that are the first of their key, as ``corpus.first_copies`` over a
    table while all copies of a key lie within ``seconds`` of its first and no row is later than
    ``late``. Rows with a null time are dropped by the watermark's rule and do not appear."""
    use_rocksdb(rows.sparkSession)
    marked = rows.where(rows[ts].isNotNull()).withWatermark(ts, late)
    return marked.groupBy(key).transformWithStateInPandas(FirstCopies(rows.columns, order, ts, seconds), rows.schema, "append", "eventTime")
