"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: every node links neighbours to its smallest neighbour.

    The large star moves the larger neighbours, the small star the smaller ones
    and the node itself. Only minima are gathered per node, by partial aggregation;
    a node of very many neighbours is a skewed join key, which AQE splits.
    """
    if large:
        ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    else:
        ends = F.explode(F.array(F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    both = edges.select(ends.alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    moved = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # the node itself moves along with its neighbours
        out = moved.select(F.explode(F.array("v", "u")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, rows_per_task: int = 200_000) -> DataFrame:
    """(id, component) for every node of ``edges`` (columns a, b): the component is
    the smallest id reachable. Rounds grow with the logarithm of the longest path;
    each star is written to the shared folder, so plans and lineage stay short, in
    as many files as its edges need.

    Null ends and loops are ignored; repeated edges count once; an empty edge
    table gives no rows.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    now = materialise(clean, "cc")
    files = max(8, now.count() // rows_per_task)
    mark = None
    for _ in range(max_rounds):
        for large in (True, False):
            after = materialise(_star(now, large).coalesce(files), "cc")
            discard(now)
            now = after
        # a fixed point leaves the same stars; the sum over a set of edges tells it apart
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark or not new[0]:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
