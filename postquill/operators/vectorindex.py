"""A vector index with compressed codes: cells, residual product quantisation, exact rescoring.

A vector belongs to the cell of its nearest centre. What the centre leaves of it is cut into
``parts`` pieces, and each piece is written as the number of its nearest codeword, one byte. A
search scores the codes of the probed cells by products with what they stand for, and reads the
vectors of its short list alone, which it scores exactly.

Queries meet codes, and later vectors, in tiles (see ``tiles``): a task holds the queries of one
group, reads the codes of one part and passes on a short list a query. Pairs of the short list
travel as ids; a task that has their vectors and queries scores them, so no pair carries a vector.

Both tables are stored by cell, so cells that no query probes are not read. Codes lie in blocks
of at most ``BLOCK`` rows, dealt within a cell, so a cell of any size is many tasks. Centres and
codewords come from a bounded sample in the order of a hash; every vector is placed.

Defined results: vectors that are null, of another length than the sample's, or hold a null or
non-finite component take no part; repeated ids are rows of their own; an empty table makes an
index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..sources import versions
from . import tiles
from .lexical import ranked

CELLS, PARTS, WORDS = 16, 16, 256
SAMPLE = 10_000
BLOCK = 8192
QUERY_BATCH = 256
#: Queries and codes of a tile at most, about; queries and vectors of one that scores exactly.
QUERY_GROUP, PART_ROWS = 2048, 1_000_000
EXACT_GROUP, EXACT_ROWS = 16384, 32768
#: Rows of the short list for each row wanted.
REACH = 10
VECTORS = "id long, embedding array<double>, code binary, cell int"
CODES = "ids array<long>, codes binary, cell int"


@dataclass(frozen=True)
class Codebook:
    """``centres`` (cells, dim) and ``words`` (parts, words, dim / parts)."""

    centres: np.ndarray
    words: np.ndarray

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = _nearest(x, self.centres)
        left = x - self.centres[cell]
        width = self.words.shape[2]
        code = [_nearest(left[:, m * width : (m + 1) * width], self.words[m]) for m in range(len(self.words))]
        return cell, np.stack(code, axis=1).astype(np.uint8)

    def decoded(self, cell: int, code: np.ndarray) -> np.ndarray:
        """What the codes of a cell stand for."""
        return self.centres[cell] + np.concatenate([words[code[:, m]] for m, words in enumerate(self.words)], axis=1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of every query with every codeword: (queries, parts, words)."""
        return np.einsum("qmw,mcw->qmc", queries.reshape(len(queries), len(self.words), -1), self.words)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def train(sample: np.ndarray, cells: int = CELLS, parts: int = PARTS, words: int = WORDS, seed: int = 7) -> Codebook:
    if sample.shape[1] % parts:
        raise ValueError(f"{sample.shape[1]} components cannot be cut into {parts} equal pieces")
    rng = np.random.default_rng(seed)
    centres = _means(sample, cells, rng, 12)
    left = sample - centres[_nearest(sample, centres)]
    width = sample.shape[1] // parts
    made = [_means(left[:, m * width : (m + 1) * width], words, rng, 8) for m in range(parts)]
    return Codebook(centres, np.stack(made))


def _usable(rows: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    v = F.col(vector)
    whole = v.isNotNull() & (F.size(v) > 0 if dim is None else F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.withColumn(vector, v.cast("array<double>")).where(whole)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _placing(shared, dim: int, lots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, code = shared.value.place(_matrix(batch.column(1), dim))
            lot = (batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) * 2654435761 >> 16) % lots
            codes = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(lot.astype(np.int32)), codes], names=["id", "embedding", "cell", "lot", "code"])

    return run


def _packed(rows: int):
    """Codes sorted by cell as (cell, ids, codes) of at most ``rows`` each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
            for lo, hi in zip(edges, [*edges[1:], len(cell)]):
                for a in range(lo, hi, rows):
                    part = batch.slice(a, min(hi, a + rows) - a)
                    yield pa.RecordBatch.from_arrays([pa.array([cell[a]], pa.int32()), pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(part.column(2).to_pylist())], pa.binary())], names=["cell", "ids", "codes"])

    return run


def build(vectors: DataFrame, root: str, cells: int = CELLS, parts: int = PARTS, words: int = WORDS, sample: int = SAMPLE, seed: int = 7) -> str:
    """Writes the index of (id, embedding) as a new version at ``root`` and returns its folder."""
    spark, version = vectors.sparkSession, versions.new_version()
    at = f"{root}/{version}"
    rows = _usable(vectors.select(F.col("id").cast("long").alias("id"), "embedding"), "embedding")
    few = rows.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toArrow().column(0).to_pylist()  # a bounded sample
    dim = max((len(x) for x in few), key=[len(x) for x in few].count, default=parts)
    few = np.array([x for x in few if len(x) == dim] or np.zeros((1, dim)), np.float64)
    book = train(few, cells, parts, words, seed)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(book.centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{at}/centres")
    flat = [(m, i, w.tolist()) for m, piece in enumerate(book.words) for i, w in enumerate(piece)]
    spark.createDataFrame(flat, "part int, word int, value array<double>").coalesce(1).write.parquet(f"{at}/words")
    rows = _usable(vectors.select(F.col("id").cast("long").alias("id"), "embedding"), "embedding", dim)
    lots = max(1, rows.count() // (BLOCK * len(book.centres)))
    shared = spark.sparkContext.broadcast(book)
    placed = rows.mapInArrow(_placing(shared, dim, lots), "id long, embedding array<double>, cell int, lot int, code binary")
    placed = placed.repartition("cell", "lot").sortWithinPartitions("cell", "id")
    placed.select("id", "embedding", "code", "cell").write.option("compression", "zstd").partitionBy("cell").parquet(f"{at}/vectors")
    kept = spark.read.schema(VECTORS).parquet(f"{at}/vectors").select("cell", "id", "code").sortWithinPartitions("cell")
    kept.mapInArrow(_packed(BLOCK), "cell int, ids array<long>, codes binary").write.option("compression", "zstd").partitionBy("cell").parquet(f"{at}/codes")
    versions.publish(spark, root, version)
    return at


def load(spark: SparkSession, root: str) -> tuple[str, Codebook]:
    at = versions.current(spark, root)
    if at is None:
        raise FileNotFoundError(f"no index at {root}")
    centres = [r["centre"] for r in spark.read.parquet(f"{at}/centres").orderBy("cell").collect()]  # one row a cell
    words = spark.read.parquet(f"{at}/words").orderBy("part", "word").collect()  # parts * words rows
    parts = 1 + max(r["part"] for r in words)
    return at, Codebook(np.array(centres), np.array([r["value"] for r in words]).reshape(parts, -1, len(centres[0]) // parts))


def _probing(shared, dim: int, probes: int, qid: str):
    """(cell, qids, queries) of a batch: each query at its nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.centres
        for batch in batches:
            for a in range(0, len(batch), QUERY_BATCH):
                part = batch.slice(a, QUERY_BATCH)
                q = _matrix(part.column(1), dim)
                near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
                for cell in range(len(centres)):
                    who = np.flatnonzero((near == cell).any(axis=1))
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([part.column(0).take(pa.array(who)).to_pylist()], pa.list_(part.schema.field(0).type)), pa.array([q[who].tobytes()], pa.binary())], names=["cell", "qids", "queries"])

    return run


def _scoring(shared, dim: int, short: int, probes: int):
    """The ``short`` best codes of a tile for each of its queries, of cells that the query probes."""

    def found(qid: pa.Array, ids: list, cells: list, best: tiles._Best) -> Iterator[pa.RecordBatch]:
        query, score, row = best.settle()
        id_, cell = np.concatenate(ids), np.concatenate(cells)
        for a in range(0, len(query), 65536):
            b = slice(a, a + 65536)
            yield pa.RecordBatch.from_arrays([qid.take(pa.array(query[b])), pa.array(cell[row[b]]), pa.array(id_[row[b]]), pa.array(score[b])], names=["qid", "cell", "id", "about"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        asked, best, ids, cells, seen = [], None, [], [], 0
        for batch in batches:  # a partition is one tile, queries first
            mine = batch.filter(pc.equal(batch.column("kind"), 0))
            if len(mine):
                asked.append(mine.select(["qid", "values"]))
            blocks = batch.filter(pc.equal(batch.column("kind"), 1))
            if not asked or not len(blocks):
                continue
            if best is None:
                told = pa.Table.from_batches(asked).combine_chunks()
                qid, q = told.column(0).combine_chunks(), _matrix(told.column(1).combine_chunks(), dim)
                near = np.zeros((len(q), len(book.centres)), bool)
                np.put_along_axis(near, np.argsort(-(q @ book.centres.T), axis=1, kind="stable")[:, :probes], True, axis=1)
                best, matrix, step = tiles._Best(len(q), short, -np.inf), q.T.astype(np.float32), max(1, tiles.HELD // len(q))
            for i, cell in enumerate(blocks.column("cell").to_pylist()):
                if not near[:, cell].any():
                    continue
                code = np.frombuffer(blocks.column("codes")[i].as_buffer(), np.uint8).reshape(-1, len(book.words))
                x = book.decoded(cell, code).astype(np.float32)
                apart = ~near[:, cell]
                for a in range(0, len(x), step):
                    score = x[a : a + step] @ matrix
                    if apart.any():
                        score[:, apart] = -np.inf
                    best.add(np.arange(seen + a, seen + a + len(score)), score)
                ids.append(blocks.column("ids")[i].values.to_numpy())
                cells.append(np.full(len(x), cell, np.int32))
                seen += len(x)
        if best is not None and seen:
            yield from found(qid, ids, cells, best)

    return run


def _groups(n_asked: int) -> int:
    return max(1, -(-n_asked // QUERY_GROUP), min(tiles.LEAST, -(-n_asked // QUERY_BATCH)))


def short_list(spark: SparkSession, root: str, queries: DataFrame, short: int, probes: int | None = None) -> DataFrame:
    """(qid, cell, id) of the ``short`` best codes in the ``probes`` nearest cells (all) of every query (qid, vector)."""
    at, book = load(spark, root)
    dim, kind, probes = book.centres.shape[1], queries.schema["qid"].dataType.simpleString(), probes or len(book.centres)
    shared = spark.sparkContext.broadcast(book)
    asked = _usable(queries.select("qid", "vector"), "vector", dim)
    codes = spark.read.schema(CODES).parquet(f"{at}/codes")
    if probes < len(book.centres):
        met = asked.mapInArrow(_probing(shared, dim, probes, "qid"), f"cell int, qids array<{kind}>, queries binary").select("cell").distinct()
        codes = codes.where(F.col("cell").isin([r["cell"] for r in met.collect()]))  # at most one row a cell
    groups = _groups(queries.count())
    n = codes.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    parts = max(1, -(-n // PART_ROWS), min(-(-n // BLOCK), -(-tiles.LEAST // groups)))
    part = F.pmod(F.xxhash64("cell", F.col("ids")[0]), F.lit(parts)).cast("int")
    each = lambda many: F.sequence(F.lit(0), F.lit(many - 1))
    theirs = asked.select(
        F.explode(F.transform(each(parts), lambda p: F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int") * parts + p)).alias("tile"), F.lit(0).alias("kind"), "qid", F.col("vector").alias("values"),
        F.lit(None).cast("int").alias("cell"), F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("codes"),
    )
    mine = codes.select(
        F.explode(F.transform(each(groups), lambda g: g * parts + part)).alias("tile"), F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("qid"), F.lit(None).cast("array<double>").alias("values"), "cell", "ids", "codes",
    )
    dealt = theirs.unionByName(mine).repartitionById(groups * parts, F.col("tile")).sortWithinPartitions("kind", "cell", F.col("ids")[0], "qid")
    found = dealt.mapInArrow(_scoring(shared, dim, short, probes), f"qid {kind}, cell int, id long, about double").where("about > double('-inf')")
    return ranked(found.select("qid", F.struct("id", "cell").alias("id"), F.col("about").alias("score")), short, "codes").select("qid", "id.cell", "id.id")


def _rescoring(dim: int):
    """Products of the pairs of a tile (kind 2) of its queries (0) and vectors (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[list] = [[], [], []]
        for batch in batches:
            for kind, names in enumerate((["qid", "values"], ["id", "cell", "values"], ["qid", "id", "cell"])):
                some = batch.filter(pc.equal(batch.column("kind"), kind))
                if len(some):
                    kinds[kind].append(some.select(names))
        if not all(kinds):
            return
        asked, held, pairs = (pa.Table.from_batches(x).combine_chunks() for x in kinds)
        qid, q = asked.column("qid").combine_chunks(), _matrix(asked.column("values").combine_chunks(), dim)
        x = _matrix(held.column("values").combine_chunks(), dim)
        ids, cell = held.column("id").to_numpy(), held.column("cell").to_numpy().astype(np.int64)
        known, wide = np.unique(ids), cell.max() + 1
        key = np.searchsorted(known, ids) * wide + cell
        order = np.argsort(key, kind="stable")
        key = key[order]
        who = pc.fill_null(pc.index_in(pairs.column("qid"), value_set=qid), -1).to_numpy().astype(np.int64)
        wanted = pairs.column("id").to_numpy()
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        there = (who >= 0) & (known[at] == wanted)
        # a pair counts once for each row of its id
        who, at = np.divmod(np.unique((who * (len(known) * wide) + at * wide + pairs.column("cell").to_numpy())[there]), len(known) * wide)
        lo, hi = np.searchsorted(key, at, "left"), np.searchsorted(key, at, "right")
        many = hi - lo
        who, row = np.repeat(who, many), np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        row = order[row]
        for a in range(0, len(who), 16384):
            b = slice(a, a + 16384)
            yield pa.RecordBatch.from_arrays([qid.take(pa.array(who[b])), pa.array(ids[row[b]]), pa.array(np.einsum("ij,ij->i", x[row[b]], q[who[b]]))], names=["qid", "id", "score"])

    return run


def search(spark: SparkSession, root: str, queries: DataFrame, k: int, probes: int | None = None, short: int | None = None, listed: DataFrame | None = None) -> DataFrame:
    """The ``k`` best of every query's short list (``REACH * k``, or ``listed``), scored exactly."""
    if listed is None:
        listed = materialise(short_list(spark, root, queries, short or REACH * k, probes), "short")
    at, book = load(spark, root)
    dim, kind = book.centres.shape[1], queries.schema["qid"].dataType.simpleString()
    full = spark.read.schema(VECTORS).parquet(f"{at}/vectors").select("cell", "id", "embedding")
    n, pairs = full.count(), listed.count()
    if pairs < n:
        full, n = full.join(listed.select("cell", "id").distinct(), ["cell", "id"], "left_semi"), pairs
    groups = max(1, -(-queries.count() // EXACT_GROUP))
    parts = max(1, -(-n // EXACT_ROWS), min(-(-n // tiles.SMALL), -(-tiles.LEAST // groups)))
    group, part = (F.pmod(F.xxhash64(c), F.lit(many)).cast("int") for c, many in (("qid", groups), ("id", parts)))
    each = lambda many: F.sequence(F.lit(0), F.lit(many - 1))
    row = lambda tile, number, **have: [tile.alias("tile"), F.lit(number).alias("kind"), *(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("qid", kind), ("id", "long"), ("cell", "int"), ("values", "array<double>")))]
    qid, id_, cell = F.col("qid"), F.col("id"), F.col("cell")
    asked = _usable(queries.select("qid", "vector"), "vector", dim).select(*row(F.explode(F.transform(each(parts), lambda p: group * parts + p)), 0, qid=qid, values=F.col("vector")))
    held = full.select(*row(F.explode(F.transform(each(groups), lambda g: g * parts + part)), 1, id=id_, cell=cell, values=F.col("embedding")))
    pairs = listed.select(*row(group * parts + part, 2, qid=qid, id=id_, cell=cell))
    found = asked.unionByName(held).unionByName(pairs).repartitionById(groups * parts, F.col("tile")).mapInArrow(_rescoring(dim), f"qid {kind}, id long, score double")
    return ranked(found, k, "codes")


def reading(spark: SparkSession, root: str, queries: DataFrame, short: int, probes: int | None = None, listed: DataFrame | None = None) -> DataFrame:
    """Of a short list, or ``listed``, one row: the share of the rows whose vectors a query reads, and of those whose codes, on average."""
    at, book = load(spark, root)
    n = spark.read.schema(VECTORS).parquet(f"{at}/vectors").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    dim, shared = book.centres.shape[1], spark.sparkContext.broadcast(book)
    kind = queries.schema["qid"].dataType.simpleString()
    asked = _usable(queries.select("qid", "vector"), "vector", dim).mapInArrow(_probing(shared, dim, probes or len(book.centres), "qid"), f"cell int, qids array<{kind}>, queries binary")
    codes = asked.select("cell", F.explode("qids").alias("qid")).join(n, "cell").groupBy("qid").agg(F.sum("n").alias("codes")).agg(F.avg("codes").alias("codes"))
    listed = short_list(spark, root, queries, short, probes) if listed is None else listed
    rows = listed.groupBy("qid").agg(F.count(F.lit(1)).alias("rows")).agg(F.avg("rows").alias("rows"))
    one = F.lit(1).alias("__k")
    both = total.select("*", one).join(codes.select("*", one), "__k").join(rows.select("*", one), "__k")
    return both.select((F.col("rows") / F.col("total")).alias("rows_read"), (F.col("codes") / F.col("total")).alias("codes_read"))
