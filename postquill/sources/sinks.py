"""Vectors to a store that takes rows as text, a connection a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row

DIGITS = 7


def vector_text(vector: list[float], dim: int) -> str:
    """``[a,b,...]`` with seven significant digits; another length is an error."""
    if len(vector) != dim:
        raise ValueError(f"a vector of {len(vector)} in a table of {dim}")
    return "[" + ",".join(f"{x:.{DIGITS}g}" for x in vector) + "]"


def copy_rows(rows: DataFrame, columns: list[str], vector: str, dim: int, connect: Callable[[], Callable]) -> None:
    """Every row as a tuple of ``columns`` and the vector's text. ``connect`` runs once a
    partition and gives a context manager of a function that takes one row; it has to
    make a partition that is sent again harmless (insert by key, or commit at the end)."""

    def send(part: Iterator[Row]) -> None:
        with connect() as put:
            for row in part:
                put((*[row[c] for c in columns], vector_text(row[vector], dim)))

    rows.select(*columns, vector).foreachPartition(send)
