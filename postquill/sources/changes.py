"""A mailbox service as a streaming source: pages of ids, and changes since a cursor.

The service is any object with ``latest()``, ``since(cursor, to)`` and ``ids(cursor)``
that can be pickled; it is given by import path, so readers build their own. An
expired cursor raises, and the caller starts a new query from the beginning:
deduplication makes that harmless.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def _service(options: dict):
    module, _, name = options["service"].partition(":")
    return getattr(importlib.import_module(module), name)()


class MailChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.pages = int(options.get("pages", 1))

    def initialOffset(self) -> dict:
        return {"cursor": int(self.options.get("start", 0))}

    def latestOffset(self) -> dict:
        return {"cursor": _service(self.options).latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["cursor"], end["cursor"]
        step = max(1, -(-(b - a) // self.pages))
        return [InputPartition((x, min(x + step, b))) for x in range(a, b, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in _service(self.options).since(*partition.value):
            yield tuple(row)


class MailChanges(DataSource):
    """``spark.dataSource.register(MailChanges)``, then format("mail_changes")."""

    @classmethod
    def name(cls) -> str:
        return "mail_changes"

    def schema(self) -> str:
        return "change_id long, source_path string, content binary"

    def streamReader(self, schema) -> MailChangesReader:
        return MailChangesReader(self.options)


class DemoService:
    """An offline stand-in: ten generated messages, every third a copy."""

    def latest(self) -> int:
        return 10

    def since(self, start: int, end: int):
        for i in range(start, end):
            n = i - i % 3 if i % 3 == 2 else i
            raw = f"Message-ID: <m{i}@demo>\r\nDate: Tue, 5 Dec 2000 09:{n:02d}:00 +0000\r\nFrom: a{n}@demo\r\nTo: b@demo\r\nSubject: Re: plan {n}\r\n\r\nA body of more than twenty characters, number {n}.\r\n"
            yield i, f"demo/inbox/{i}", raw.encode()
