"""Event-time windows; the same code serves tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if late and events.isStreaming else events


def tumbling(events: DataFrame, ts: str, width: str, by: str, value: str, late: str | None = None) -> DataFrame:
    rows = _marked(events, ts, late).groupBy(F.window(ts, width).alias("w"), by)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sliding(events: DataFrame, ts: str, width: str, step: str, by: str, late: str | None = None) -> DataFrame:
    rows = _marked(events, ts, late).groupBy(F.window(ts, width, step).alias("w"), by)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    rows = _marked(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), by)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("session_start"), "n")
