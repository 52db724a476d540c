"""Counters that cost no second pass: they are gathered while rows flow to where they go."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.predicates import is_bulk
from .corpus import first_copies

PROGRESS = "query string, batch long, rows long, rows_per_second double, seconds double"


@dataclass
class Counted:
    """Rows with counters that are known once an action has run over them."""

    rows: DataFrame
    observations: list[Observation]

    def counters(self) -> dict:
        return {k: v for o in self.observations for k, v in o.get.items()}


def watched(rows: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return rows.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


def filtered(messages: DataFrame) -> Counted:
    """First copies that are not bulk, with the funnel's counters gathered on the way."""
    parsed, all_ = watched(messages, n_parsed=F.count(F.lit(1)))
    firsts, copies = watched(first_copies(parsed).withColumn("__bulk", is_bulk()), n_first=F.count(F.lit(1)), n_bulk=F.count_if(F.col("__bulk")), n_kept=F.count_if(~F.col("__bulk")))
    return Counted(firsts.where(~F.col("__bulk")).drop("__bulk"), [all_, copies])


def funnel(counters: dict) -> dict:
    return {"n_parsed": counters["n_parsed"], "n_dupe": counters["n_parsed"] - counters["n_first"], "n_bulk": counters["n_bulk"], "n_kept": counters["n_kept"]}


@dataclass
class Progress(StreamingQueryListener):
    """A row for each batch of the streams of a session, kept or handed to ``write``."""

    write: Callable[[Row], None] | None = None
    rows: list[Row] = field(default_factory=list)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = Row(query=p.name or str(p.id), batch=p.batchId, rows=p.numInputRows, rows_per_second=float(p.processedRowsPerSecond or 0.0), seconds=p.batchDuration / 1000)
        self.rows.append(row)
        if self.write:
            self.write(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, PROGRESS)
