"""A mailbox service read in batches: ids page by page, contents by many tasks, and the
choice between changes since a cursor and everything.

A service has ``page(token, size)`` (ids and the next page's token, None at the end),
``fetch(id)`` (bytes), ``latest()`` and ``since(start, to)`` as the change feed has; it
raises :class:`CursorExpired` for a cursor that it has forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .changes import DemoService, _service

PAGE = 500


class CursorExpired(Exception):
    """The service no longer knows what has changed since the cursor."""


class MailIdsReader(DataSourceReader):
    """A page's token is known only from the page before, so one task walks the pages."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        service, token, left = _service(self.options), None, int(self.options.get("most", -1))
        while left:
            ids, token = service.page(token, int(self.options.get("page", PAGE)))
            ids = ids if left < 0 else ids[:left]
            left -= len(ids) if left > 0 else 0
            yield from ((i,) for i in ids)
            if token is None:
                return


class MailIds(DataSource):
    """``spark.dataSource.register(MailIds)``, then format("mail_ids"); options service, page, most."""

    @classmethod
    def name(cls) -> str:
        return "mail_ids"

    def schema(self) -> str:
        return "source_path string"

    def reader(self, schema) -> MailIdsReader:
        return MailIdsReader(self.options)


def list_ids(spark: SparkSession, service: str, page: int = PAGE, most: int | None = None) -> DataFrame:
    spark.dataSource.register(MailIds)
    return spark.read.format("mail_ids").options(service=service, page=page, most=-1 if most is None else most).load()


def _fetch(service: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mailbox = _service({"service": service})
        for batch in batches:
            for id_ in batch.column(0).to_pylist():  # one message at a time in memory
                content = problem = None
                try:
                    content = mailbox.fetch(id_)
                except Exception as e:  # one message that fails is reported, the others go on
                    problem = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([id_], pa.string()), pa.array([content], pa.binary()), pa.array([problem], pa.string())], names=["source_path", "content", "problem"])

    return run


def fetch(ids: DataFrame, service: str, tasks: int = 20) -> DataFrame:
    """(source_path, content, problem) of every id; ``tasks`` bounds the calls at a time.
    Where ``problem`` is set there is no content, and the id may be asked for again."""
    return ids.select("source_path").repartition(tasks).mapInArrow(_fetch(service), "source_path string, content binary, problem string")


def starting_point(service: str, cursor: int | None) -> tuple[int, int, bool]:
    """(from, to, full) of the next sync: changes since the cursor, or everything where
    there is none or it has expired. Deduplication makes a full sync harmless."""
    mailbox = _service({"service": service})
    to = mailbox.latest()
    if cursor is None:
        return 0, to, True
    try:
        next(iter(mailbox.since(cursor, cursor)), None)
    except CursorExpired:
        return 0, to, True
    return cursor, to, False


class DemoMailbox(DemoService):
    """The offline stand-in with pages; message 7 cannot be fetched, cursors under 3 have expired."""

    def page(self, token: int | None, size: int) -> tuple[list[str], int | None]:
        start = token or 0
        end = min(start + size, self.latest())
        return [f"demo/inbox/{i}" for i in range(start, end)], end if end < self.latest() else None

    def fetch(self, id_: str) -> bytes:
        number = int(id_.rpartition("/")[2])
        if number == 7:
            raise OSError("gone")
        return next(super().since(number, number + 1))[2]

    def since(self, start: int, end: int):
        if 0 < start < 3:
            raise CursorExpired(start)
        return super().since(start, end)
