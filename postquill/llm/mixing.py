"""Mixing sources to target weights by Sainte-Lague apportionment.

DataFrame operations only. The mix has as many blocks of ``block`` words as the
corpus; sources get them by highest quotients of their targets, the shards of a
source by highest quotients of their words, and in a shard the blocks are filled
in the order of a seeded hash of the documents.

Defined results: a null or empty text has size 0 and nothing is taken of it; the
null source is a source and comes last; repeated rows are rows of their own, and
ties in the seeded order go by document id, then size; without any words all
targets are 0; an empty table gives no rows; columns of the input whose names
clash with those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, table

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 128
SHARD_ROWS = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def sainte_lague(items: DataFrame, group: list[str], item: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the integer seats of each item when its group's ``seats`` go to
    the highest quotients ``weight / (2k + 1)``, ties to the smaller item.

    Only quotients near the fair share are listed: the sum of rounded fair shares
    is off by at most half an item each, which bounds how far any item's seats can
    be from its own; about four rows per item are sorted.
    """
    whole = Window.partitionBy(*group)
    fair = F.col("__total") > 0
    near = (
        items.withColumns({"__total": F.sum(weight).over(whole), "__n": F.count(F.lit(1)).over(whole)})
        .withColumn("__fair", F.when(fair, F.round(F.col(weight) * F.col(seats) / F.col("__total"))).otherwise(0).cast("long"))
        .withColumn("__reach", F.when(fair, F.ceil(1.5 * F.col("__n") * F.col(weight) / F.col("__total")) + 2).otherwise(0).cast("long"))
        .withColumn("__low", F.greatest(F.lit(0).cast("long"), F.col("__fair") - F.col("__reach")))
        .withColumn("__open", F.col(seats) - F.sum("__low").over(whole))
    )
    seat = near.withColumn("__k", F.explode(F.sequence(F.col("__low"), F.col("__fair") + F.col("__reach") + 1)))
    quotient = F.col(weight) / (2 * F.col("__k") + 1)
    order = Window.partitionBy(*group).orderBy(quotient.desc(), *[F.col(c).asc_nulls_last() for c in item], F.col("__k"))
    won = seat.withColumn("__won", ((F.row_number().over(order) <= F.col("__open")) & fair).cast("long"))
    kept = [c for c in items.columns]
    return won.groupBy(*kept).agg((F.first("__low") + F.sum("__won")).cast("long").alias(out))


def n_words(text: str) -> Column:
    """Number of words, 0 for null. Each word becomes one letter, so that a long text
    makes one short string and no array of its words."""
    letters = F.regexp_replace(F.col(text), rf"{SPACE}*{WORD}{SPACE}*", "x")
    return F.when(F.col(text).rlike(WORD), F.char_length(letters)).otherwise(0).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: words, weight and target. The targets share the words of all by
    weight, stop at CAP times the source's own and pass the excess on by weight."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    named = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    weighed = (
        by_source.withColumn("source_no", F.row_number().over(named).cast("long"))
        .withColumn("weight", F.element_at(weights, ((F.col("source_no") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * CAP)
    )
    by_ratio = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "source_no")
    every = Window.partitionBy(F.lit(1))
    wide = "decimal(38,0)"
    filled = (
        weighed.withColumns({
            "__words": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "__weights": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        })
        .withColumn("capped", F.col("cap").cast(wide) * F.col("__weights").cast(wide) <= F.col("__words").cast(wide) * F.col("weight").cast(wide))
        .withColumns({
            "__rest": F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)),
            "__open": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every),
        })
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("__rest") * F.col("weight")).cast("double") / F.col("__open").cast("double")))
    )
    return filled.select("source", "source_no", "source_size", "source_rows", "weight", "target")


def mix(docs: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: str = SEED, keep: tuple[str, ...] = ("doc_id", "source"), cut: bool = True) -> DataFrame:
    """Each row of ``docs`` (columns ``keep``) with size, source_size, target and taken.

    ``cut`` writes the sizes to the shared folder once; without it they are worked
    out again wherever they are used, for an input that carries its texts along.
    """
    keep = tuple(c for c in keep if c not in ("size", "source_size", "target", "taken"))
    order_key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select(*keep, n_words("text").alias("size"), order_key.alias("__key"))
    if cut:
        sized = materialise(sized, "mix-sizes")
    targets = source_targets(sized)
    number = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    targets = (
        targets.withColumn("__blocks", F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(1))) / F.lit(block) + 0.5).cast("long"))
        .withColumn("__shards", F.ceil(F.col("source_rows") / F.lit(shard_rows)).cast("long"))
        .withColumn("__all", F.lit(1))
    )
    quotas = sainte_lague(targets, ["__all"], ["source_no"], "target", "__blocks", "__quota")
    quotas = quotas.select(F.col("source").alias("__source"), "source_no", "source_size", "target", "__shards", "__quota")
    dealt = sized.join(quotas, F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("__shard", number % F.col("__shards"))
    shards = dealt.groupBy("source_no", "__shard", "__quota").agg(F.sum("size").alias("__words"))
    shards = sainte_lague(shards, ["source_no"], ["__shard"], "__words", "__quota", "__share")
    budget = F.least(F.col("__share") * block, F.col("__words") * CAP)
    shards = shards.select(
        F.col("source_no").alias("__no"), F.col("__shard").alias("__sh"),
        F.when(F.col("__words") > 0, F.floor(budget / F.col("__words"))).otherwise(0).cast("long").alias("__epochs"),
        F.when(F.col("__words") > 0, budget % F.col("__words")).otherwise(0).cast("long").alias("__rest"),
    )
    filled = dealt.join(shards, (F.col("source_no") == F.col("__no")) & (F.col("__shard") == F.col("__sh")))
    seen = Window.partitionBy("source_no", "__shard").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("__rest") - F.coalesce(F.sum("size").over(seen), F.lit(0))))
    return filled.withColumn("taken", F.col("__epochs") * F.col("size") + part).select(*keep, "size", "source_size", "target", "taken")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


OP10_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM by_source),
weighed AS (SELECT *, [5, 2, 1][(no - 1) % 3 + 1]::BIGINT AS w, 3 * source_size AS cap FROM named),
ranked AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words,
           sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM weighed),
marked AS (SELECT *, cap::HUGEINT * ws <= words::HUGEINT * w AS capped FROM ranked),
aimed AS (SELECT source, no, source_size, n,
          CASE WHEN capped THEN cap::DOUBLE ELSE ((sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * w)::DOUBLE
               / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target FROM marked),
seats AS (SELECT no, k, target / (2 * k + 1) AS q FROM aimed, generate_series(0, (SELECT floor(sum(source_size) / {BLOCK} + 0.5)::BIGINT FROM by_source)) g(k) WHERE target > 0),
won AS (SELECT no, count(*) AS quota FROM (SELECT *, row_number() OVER (ORDER BY q DESC, no, k) AS r FROM seats)
        WHERE r <= (SELECT floor(sum(source_size) / {BLOCK} + 0.5)::BIGINT FROM by_source) GROUP BY no),
dealt AS (SELECT s.*, a.no, a.source_size, a.target, coalesce(w.quota, 0) AS quota, ('0x' || substr(s.k, 1, 8))::BIGINT % ceil(a.n / {SHARD_ROWS})::BIGINT AS shard
          FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source LEFT JOIN won w ON w.no = a.no),
shards AS (SELECT no, shard, quota, sum(size)::BIGINT AS words FROM dealt GROUP BY ALL),
sseats AS (SELECT no, shard, words, quota, k, row_number() OVER (PARTITION BY no ORDER BY words / (2 * k + 1) DESC, shard, k) AS r
           FROM shards, generate_series(0, (SELECT max(quota) FROM dealt)) g(k) WHERE words > 0 AND k <= quota),
shares AS (SELECT s.no, s.shard, s.words, count(q.k) AS share FROM shards s LEFT JOIN sseats q ON q.no = s.no AND q.shard = s.shard AND q.r <= q.quota GROUP BY ALL),
filled AS (SELECT d.*, h.words, least(h.share * {BLOCK}, 3 * h.words) AS budget,
           coalesce(sum(d.size) OVER (PARTITION BY d.no, d.shard ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
           FROM dealt d JOIN shares h ON h.no = d.no AND h.shard = d.shard)
SELECT doc_id, source, size, source_size, target,
       (CASE WHEN words > 0 THEN budget // words * size + greatest(0, least(size, budget % words - seen)) ELSE 0 END)::BIGINT AS taken
FROM filled
"""
