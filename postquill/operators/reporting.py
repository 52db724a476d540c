"""Small tables for reports, and their rendering. Only what is rendered reaches the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET_MS = 200


def table_name(chunking: str, model: str) -> str:
    """The name of a configuration's table: lower-case letters, digits and underscores only."""
    name = f"chunks_{chunking}__{re.sub('[-.]', '_', model.rpartition('/')[2]).lower()}"
    if not re.fullmatch("[a-z0-9_]+", name):
        raise ValueError(f"no safe table name for {chunking!r} and {model!r}")
    return name


def grounded_shape(refused: Column, cited: Column, invalid: Column) -> Column:
    """An answer that refused, or cited something and nothing that does not exist."""
    return F.coalesce(refused, F.lit(False)) | ((F.size(cited) > 0) & (F.size(invalid) == 0))


def cited_sources(sources: Column, cited: Column) -> Column:
    """The sources (structs with field n) whose numbers are cited."""
    return F.filter(sources, lambda s: F.array_contains(cited, s["n"]))


def decided_by(routes: DataFrame) -> DataFrame:
    """decided_by, n and share of all."""
    by = routes.groupBy("decided_by").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # a row per decider


def newest(rows: DataFrame, by: str) -> DataFrame:
    """The row with the largest ``by``."""
    return rows.agg(F.max_by(F.struct(*rows.columns), by).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def best_affordable(rows: DataFrame, budget_ms: float = BUDGET_MS) -> DataFrame:
    """Of the arms (top_k, passage_tokens, ms) within the budget the one that reads most; no row without one."""
    return newest(rows.where(F.col("ms") <= budget_ms).withColumn("__o", F.struct("top_k", "passage_tokens")), "__o").drop("__o")


def paired_with_gold(found: DataFrame, gold: DataFrame, same: Column) -> DataFrame:
    """Each found commitment (message_id, f_*) with the first gold row (g_order, g_*) of its
    message that ``same`` accepts; messages without gold rows and rows without a match go."""
    rows = found.withColumn("__row", F.monotonically_increasing_id())
    both = rows.join(gold, "message_id").where(same)
    first = Window.partitionBy("__row").orderBy("g_order")
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__row")


def extraction_stats(messages: DataFrame, commitments: DataFrame) -> DataFrame:
    """One row of counts; the pass rate is null without messages."""
    seen = messages.agg(
        F.count(F.lit(1)).alias("messages_seen"), F.count_if(~F.col("passed")).alias("messages_prefiltered_out"), F.count_if("passed").alias("messages_called"),
        F.round(F.avg(F.col("passed").cast("int")), 6).alias("prefilter_pass_rate"),
    )
    made = commitments.agg(F.count(F.lit(1)).alias("commitments"), F.count("due_at").alias("with_due_date"))
    one = lambda df: df.withColumn("__k", F.lit(1))
    return one(seen).join(one(made), "__k").drop("__k")


def markdown_table(rows: DataFrame, columns: list[str], most: int = 1000) -> str:
    """At most ``most`` rows as a table; null is a dash, and a bar in a value is escaped."""
    cell = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows.select(*columns).limit(most).collect()])
