"""Two streams joined by a key and an interval of event time; the same code serves tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed(left: DataFrame, right: DataFrame, key: str, ts: str, within: str, late: str = "0 seconds", how: str = "left_outer") -> DataFrame:
    """Rows of ``left`` with those of ``right`` of the same key from the same time on until
    ``within`` later (columns of ``right`` get the prefix ``next_``). On streams both sides are
    watermarked: a row of ``left`` without a partner is given out once the watermark says that
    none can come, and state is dropped by then. Rows with a null key or time find no partner;
    on streams a null time never leaves the state of its watermark, so it is dropped."""
    later = right.select(*[F.col(c).alias(f"next_{c}") for c in right.columns])
    if left.isStreaming:
        left = left.where(F.col(ts).isNotNull()).withWatermark(ts, late)
        later = later.where(F.col(f"next_{ts}").isNotNull()).withWatermark(f"next_{ts}", late)
    near = (F.col(key) == F.col(f"next_{key}")) & (F.col(f"next_{ts}") >= F.col(ts)) & (F.col(f"next_{ts}") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return left.join(later, near, how)
