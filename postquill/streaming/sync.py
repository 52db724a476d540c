"""A mailbox brought up to date in one call: changes since the cursor, or everything.

``root`` holds what ``ingest_batch`` keeps, ``cursor`` (one row: the next start and the
number of syncs) and ``failed`` (ids by sync whose content could not be fetched). The end of
a sync is read before anything is fetched, so what arrives meanwhile is left to the next
one, and the cursor moves last. A sync whose driver is lost before that runs again under
the same number and replaces its rows; nothing is lost, and copies fall to deduplication.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..sources import mail, mailbox, versions
from ..sources.changes import _service
from ..sources.tables import read_if_there
from .ingest import ingest_batch

CURSOR = "cursor long, syncs long"
FAILED = "source_path string, problem string, batch long"
CONTENTS = "source_path string, content binary, problem string"


@dataclass(frozen=True)
class Synced:
    """One sync: its range, whether it read everything, and counts of what it wrote."""

    start: int
    end: int
    full: bool
    fetched: int
    failed: int
    kept: int


def _changed(service: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = _service({"service": service})
        for ranges in batches:
            for a, b in zip(ranges.column(0).to_pylist(), ranges.column(1).to_pylist()):
                for _, path, content in box.since(a, b):  # one message at a time in memory
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([None], pa.string())], names=["source_path", "content", "problem"])

    return run


def changes(spark: SparkSession, service: str, start: int, end: int, page: int = mailbox.PAGE) -> DataFrame:
    """(source_path, content, problem) of the changes from ``start`` on and before ``end``,
    pages of the range read by different tasks."""
    pages = max(0, -(-(end - start) // page))
    first = F.lit(start) + F.col("id") * page
    ranges = spark.range(pages, numPartitions=max(1, min(pages, 200))).select(first.alias("a"), F.least(first + page, F.lit(end)).alias("b"))
    return ranges.mapInArrow(_changed(service), CONTENTS)


def sync(spark: SparkSession, service: str, root: str, page: int = mailbox.PAGE, tasks: int = 20) -> Synced:
    """Reads what is new since the last sync, and again what it could not fetch; everything,
    where there was none or the service has forgotten its cursor, even while it is read."""
    state = versions.read(spark, f"{root}/cursor", CURSOR).first()
    number = state["syncs"] if state else 0
    start, end, full = mailbox.starting_point(service, state["cursor"] if state else None)
    missed = read_if_there(spark, f"{root}/failed", FAILED).where(F.col("batch") == number - 1).select("source_path")

    def everything() -> DataFrame:
        return materialise(mailbox.fetch(mailbox.list_ids(spark, service, page), service, tasks), "fetched")

    if not full:
        try:
            new = changes(spark, service, start, end, page)
            again = mailbox.fetch(missed.join(new.select("source_path"), "source_path", "left_anti"), service, tasks)
            contents = materialise(new.unionByName(again), "fetched")
        except Exception as e:  # the cursor expired between the choice and the read
            if mailbox.CursorExpired.__name__ not in str(e):
                raise
            start, full = 0, True
    if full:
        contents = everything()
    ingest_batch(spark, mail.parse_messages(contents.where("problem IS NULL")), root, number)
    lost = contents.where("problem IS NOT NULL").select("source_path", "problem")
    lost.write.mode("overwrite").parquet(f"{root}/failed/batch={number}")
    versions.replace(spark.createDataFrame([(end, number + 1)], CURSOR), f"{root}/cursor")
    counts = contents.agg(F.count(F.when(F.col("problem").isNull(), 1)).alias("fetched"), F.count("problem").alias("failed")).first()
    return Synced(start, end, full, counts["fetched"], counts["failed"], spark.read.parquet(f"{root}/messages/batch={number}").count())
