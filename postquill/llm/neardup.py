"""Near-duplicate classes of documents.

Shingles are five consecutive words. A shingle weighs its count in the document
times the mean inverse document frequency of its words; frequencies are counted
over all documents, words hashed to ``DF_BUCKETS``. Improved consistent weighted
sampling draws ``BANDS * ROWS`` samples a document, whose bands give candidates;
candidates are verified by exact weighted Jaccard similarity of whole texts.

Identical texts form a class before any sampling, and one row stands for them. In
a band's bucket everyone is first compared with two of its members. Where a bucket
then holds several components, the members outside its largest component are compared
with all its members, by matrix products over blocks of ``BLOCK``, and only the links
that join components leave a block. So no candidate pair that could join two
components is left out, and none is written. Buckets and texts of very many rows
(at most ``HOT_KEYS`` of them) meet their rows by a broadcast, the rest by a shuffle, so
no key fills one task. The result is one row per document.

Defined results: a null text is empty; documents without words are alike only if
their texts are identical; one with fewer than five words is a single shingle;
repeated rows stay rows, and rows of different texts may share an id; rows without an
id are searched like all others, but a null id never stands for a class while another
member has one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import discard, materialise, table
from .bytekit import U64, buffers, fold_case, mix64, prefix_hash, slices, span_hash, tidy, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: Members of a bucket whose pairs one task compares.
BLOCK = 1024
#: Most keys that are broadcast: those of more than a ``HOT_KEYS``-th of all rows.
HOT_KEYS = 1000
DF_BITS = 16
DF_BUCKETS = 1 << DF_BITS
DF_PARTS = 64
_STEP = U64(0x9E3779B97F4A7C15)
_EXACT = 1e-9


def _word_buckets(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - DF_BITS)).astype(np.int64)


def _count_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(DF_BUCKETS, np.int64)
    for batch in batches:
        buf, offsets = buffers(batch.column(0))
        for a, b in slices(offsets):
            folded = fold_case(buf[offsets[a] : offsets[b]])
            start, end, text = words(folded, offsets[a : b + 1] - offsets[a])
            bucket = _word_buckets(span_hash(prefix_hash(folded), start, end))
            pair = np.sort(text * DF_BUCKETS + bucket)
            if len(pair):
                df += np.bincount(pair[np.r_[True, pair[1:] != pair[:-1]]] % DF_BUCKETS, minlength=DF_BUCKETS)
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(df[used])], names=["bucket", "n"])


def inverse_frequencies(texts: DataFrame, n_docs: int) -> np.ndarray:
    """The idf of every bucket of words: ``1 + log((1 + N) / (1 + df))``."""
    counted = texts.select("text").mapInArrow(_count_df, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).toArrow()  # at most DF_BUCKETS rows
    df = np.zeros(DF_BUCKETS)
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return 1 + np.log((1 + n_docs) / (1 + np.minimum(df, n_docs)))


def counted_shingles(buf: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, text after text: text, hash, idf, count."""
    folded = fold_case(buf)
    start, end, text = words(folded, offsets)
    h = span_hash(prefix_hash(folded), start, end)
    value = np.r_[0, np.cumsum(idf[_word_buckets(h)])]
    n = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    many = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), many)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(SHINGLE, n[owner])
    key = np.zeros(len(at), U64)
    for i in range(SHINGLE):
        inside = i < size
        key = np.where(inside, mix64(key * _STEP + h[np.where(inside, at + i, 0)] if len(h) else key), key)
    mean = (value[at + size] - value[at]) / np.maximum(size, 1)
    order = np.lexsort((key, owner))
    owner, key, mean = owner[order], key[order], mean[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])] if len(key) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    count = np.diff(np.r_[edge, len(key)])
    return owner[edge], key[edge], np.round(mean[edge], 6), count


def shingles(buf: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, text after text: text, hash, weight."""
    owner, key, mean, count = counted_shingles(buf, offsets, idf)
    return owner, key, mean * count


_UNIT = np.float32(2.0**-24)
_BITS24 = U64((1 << 24) - 1)


def _hashed(key: np.ndarray, salt: int) -> np.ndarray:
    h = (key + U64(salt * int(_STEP) % (1 << 64))) * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from 24 bits, in single precision."""
    return (bits.astype(np.float32) + np.float32(0.5)) * _UNIT


def consistent_samples(key: np.ndarray, log_weight: np.ndarray, first: np.ndarray, salts: range) -> np.ndarray:
    """Improved consistent weighted sampling: one hashed (shingle, level) per text and
    salt. ``first`` are the places where texts begin. The five uniform numbers of a
    shingle and salt come from two hashes."""
    out = np.empty((len(first), len(salts)), U64)
    sizes = np.diff(np.r_[first, len(key)])
    for j, salt in enumerate(salts):
        h1, h2 = _hashed(key, 2 * salt + 1), _hashed(key, 2 * salt + 2)
        r = -np.log(_uniform(h1 >> U64(40)) * _uniform((h1 >> U64(16)) & _BITS24))
        beta = _uniform(((h1 & U64(0xFFFF)) << U64(8)) | (h2 & U64(0xFF)))
        log_y = r * (np.floor(log_weight / r + beta) - beta)
        log_a = np.log(-np.log(_uniform(h2 >> U64(40)) * _uniform((h2 >> U64(16)) & _BITS24))) - log_y - r
        least = np.minimum.reduceat(log_a, first)
        hit = np.flatnonzero(log_a == np.repeat(least, sizes))
        text = np.searchsorted(first, hit, side="right") - 1
        one = hit[np.r_[True, text[1:] != text[:-1]]]
        level = np.floor(log_weight[one] / r[one] + beta[one])
        out[:, j] = mix64(key[one] + level.astype(np.int64).astype(U64) * _STEP)
    return out


def _sign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            buf, offsets = buffers(batch.column(2))
            weight = np.zeros(len(batch))
            bands: list = [[]] * len(batch)
            for a, b in slices(offsets):
                owner, key, w = shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], idf)
                if not len(key):
                    continue
                found, first = np.unique(owner, return_index=True)
                weight[a + found] = np.add.reduceat(w, first)
                signs = consistent_samples(key, np.log(w).astype(np.float32), first, range(BANDS * ROWS))
                for band in range(BANDS):
                    h = np.full(len(found), band + 1, U64)
                    for row in range(ROWS):
                        h = mix64(h * _STEP + signs[:, band * ROWS + row])
                    signs[:, band] = h
                for i, text in enumerate(found.tolist()):
                    bands[a + text] = signs[i, :BANDS].astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "same", "weight", "bands"])

    return run


def weighted_jaccard(key_a: np.ndarray, w_a: np.ndarray, key_b: np.ndarray, w_b: np.ndarray) -> float:
    _, ia, ib = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    both = np.minimum(w_a[ia], w_b[ib]).sum()
    total = w_a.sum() + w_b.sum() - both
    return float(both / total) if total > 0 else 0.0


def _verify(shared, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            left, right = buffers(batch.column(2)), buffers(batch.column(3))
            keep = np.zeros(len(batch), bool)
            at = 0
            while at < len(batch):  # texts of both sides, a bounded number of bytes at a time
                to = at + 1
                while to < len(batch) and (left[1][to + 1] - left[1][at]) + (right[1][to + 1] - right[1][at]) < (4 << 20):
                    to += 1
                sides = []
                for buf, off in (left, right):
                    owner, key, w = shingles(buf[off[at] : off[to]], off[at : to + 1] - off[at], idf)
                    sides.append((key, w, np.searchsorted(owner, np.arange(to - at + 1))))
                (ka, wa, ea), (kb, wb, eb) = sides
                for i in range(to - at):
                    a, b = slice(ea[i], ea[i + 1]), slice(eb[i], eb[i + 1])
                    keep[at + i] = weighted_jaccard(ka[a], wa[a], kb[b], wb[b]) >= similarity - _EXACT
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], names=["a", "b"])

    return run


def block_links(texts: list[str], parts: np.ndarray, idf: np.ndarray, similarity: float, lead: int | None = None) -> list[tuple[int, int]]:
    """Pairs of places that join all components of ``parts`` which some pair of alike
    texts joins: each of the first ``lead`` texts (all) is compared with all, by matrix
    products. A shingle that occurs c times counts as c shingles, so that shared weight
    is an inner product."""
    lead = len(texts) if lead is None else lead
    buf, offsets = buffers(pa.array(texts, pa.large_string()))
    cut = [counted_shingles(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], idf) for a, b in slices(offsets)]
    owner = np.concatenate([c[0] + a for c, (a, _) in zip(cut, slices(offsets))])
    key, mean, count = (np.concatenate([c[i] for c in cut]) for i in (1, 2, 3))
    which = np.repeat(np.arange(len(key)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    owner, weight = owner[which], mean[which]
    _, column, held = np.unique(mix64(key[which]) + nth.astype(U64), return_inverse=True, return_counts=True)
    total = np.bincount(owner, weight, minlength=len(texts))
    shared = held[column.ravel()] > 1
    columns, column = np.unique(column.ravel()[shared], return_inverse=True)
    owner, weight, column = owner[shared], np.sqrt(weight[shared]), column.ravel()
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    tile = max(1, min(512, (4 << 20) // max(1, len(columns))))

    def rows(a: int, b: int) -> np.ndarray:
        part = slice(first[a], first[b])
        out = np.zeros((b - a, len(columns)))
        out[owner[part] - a, column[part]] = weight[part]
        return out

    root = {p: p for p in parts.tolist()}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    found = []
    for a in range(0, lead, tile):
        left = rows(a, min(a + tile, lead))
        for b in range(a, len(texts), tile):
            both = left @ rows(b, min(b + tile, len(texts))).T
            every = total[a : min(a + tile, lead), None] + total[None, b : b + tile] - both
            alike = (both >= (similarity - _EXACT) * every) & (every > 0)
            alike &= parts[a : min(a + tile, lead), None] != parts[None, b : b + tile]
            for i, j in zip(*(x.tolist() for x in np.nonzero(alike))):
                p, q = find(int(parts[a + i])), find(int(parts[b + j]))
                if p != q:
                    root[p] = q
                    found.append((a + i, b + j))
    return found


def _block(shared, similarity: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("inner", "ascending"), ("id", "ascending")])  # those outside the largest component first
        ids = group.column("id").to_numpy()
        lead = group.num_rows - int(group.column("inner").to_numpy().sum())
        pairs = block_links(group.column("text").to_pylist(), group.column("part").to_numpy(), shared.value, similarity, lead)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in pairs], pa.int64()), "b": pa.array([int(ids[j]) for _, j in pairs], pa.int64())})

    return run


def by_key(rows: DataFrame, known: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``known`` (one row for each ``key``, with the number ``n`` of
    its rows). Keys of more than ``total / HOT_KEYS`` rows, of which there are fewer than
    ``HOT_KEYS``, are broadcast; the others are merged, in the same way at every size."""
    limit = max(total // HOT_KEYS, 256)
    known = known.withColumnRenamed(key, "__key")
    hot, cold = known.where(F.col(n) > limit), known.where(F.col(n) <= limit)
    many = rows.join(F.broadcast(hot), F.col(key) == F.col("__key"))
    few = rows.join(F.broadcast(hot.select("__key")), F.col(key) == F.col("__key"), "left_anti").join(cold.hint("merge"), F.col(key) == F.col("__key"))
    return many.unionByName(few).drop("__key")


def _same(text: str = "text") -> Column:
    """16 bytes that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, same) of every row; of every distinct text (same, lead, copies, class_key,
    class_id), where ``lead`` is its smallest id; the number of rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _same().alias("same"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.count()
    idf = spark.sparkContext.broadcast(inverse_frequencies(rows, total))
    signed = materialise(rows.mapInArrow(tidy(_sign(idf)), "doc_id long, same binary, weight double, bands array<long>"), "near-signs")

    # identical texts: one row stands for each; the number it gets holds from here on, as the table is written
    lead = signed.groupBy("same").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    lead = materialise(lead.withColumn("id", F.monotonically_increasing_id()), "near-leads")
    banded = lead.select("id", "weight", F.explode("bands").alias("bucket"))
    ends = [f(F.struct("id", "weight")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    hubs = materialise(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1"), "near-hubs")
    n_members = hubs.agg(F.sum("n")).first()[0] or 0
    members = materialise(by_key(banded, hubs, "bucket", "n", n_members), "near-members")
    wanted = lead.select("same", "copies", "id").join(members.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left_semi")
    texts = by_key(rows.select("same", "text"), wanted, "same", "copies", total).groupBy("id").agg(F.first("text").alias("text"))
    texts = materialise(texts, "near-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs`` (a, b, and their weights)."""
        close = F.least("wa", "wb") >= F.greatest("wa", "wb") * (similarity - 1e-6)
        fresh = pairs.where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        both = fresh.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        return materialise(both.mapInArrow(tidy(_verify(idf, similarity)), "a long, b long"), "near-links")

    # everyone in a bucket with its smallest and its largest member
    hub = members.select("id", "weight", F.explode(F.array("lo", "hi")).alias("hub"))
    links = verified(hub.select(F.col("id").alias("a"), F.col("hub.id").alias("b"), F.col("weight").alias("wa"), F.col("hub.weight").alias("wb")))
    parts = materialise(connected_components(links), "near-parts")

    # where a bucket still holds several components, those outside the largest one with all, in blocks
    now = members.select("id", "bucket").join(parts.select(F.col("id").alias("__id"), "component"), F.col("id") == F.col("__id"), "left")
    now = now.select("id", "bucket", F.coalesce("component", "id").alias("part"))
    sizes = now.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket")
    split = sizes.agg(F.sum("k").alias("m"), F.max(F.struct("k", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # the smallest and the largest were compared with everyone, so two parts that are both single need no more
    split = split.where("m > 2").select("bucket", "m", F.col("most.part").alias("big"), F.ceil(F.col("most.k") / F.lit(BLOCK)).cast("int").alias("bigs"), F.ceil((F.col("m") - F.col("most.k")) / F.lit(BLOCK)).cast("int").alias("outs"))
    apart = by_key(now, materialise(split, "near-split"), "bucket", "m", n_members)
    inner = (F.col("part") == F.col("big")).cast("int")
    apart = apart.withColumn("inner", inner).withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("inner") == 1, F.col("bigs")).otherwise(F.col("outs"))).cast("int"))
    among = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    with_big = F.transform(F.sequence(F.lit(0), F.col("bigs") - 1), lambda o: F.struct(F.col("own").alias("i"), (-1 - o).alias("j")))
    with_out = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda o: F.struct(o.alias("i"), (-1 - F.col("own")).alias("j")))
    apart = apart.withColumn("at", F.explode(F.when(F.col("inner") == 1, with_out).otherwise(F.concat(among, with_big)))).select("bucket", "at.i", "at.j", "inner", "id", "part")
    apart = apart.join(texts.select(F.col("id").alias("__id"), "text"), F.col("id") == F.col("__id")).drop("__id")
    more = materialise(apart.groupBy("bucket", "i", "j").applyInArrow(_block(idf, similarity), "a long, b long"), "near-more")
    discard(texts, members, hubs)
    if more.limit(1).count():
        old, parts = parts, materialise(connected_components(links.unionByName(more)), "near-parts")
        discard(old)

    light = lead.select("id", "same", "lead", "copies").join(parts.select(F.col("id").alias("__id"), "component"), F.col("id") == F.col("__id"), "left").drop("__id")
    linked = light.where(F.col("component").isNotNull())
    heads = linked.groupBy("component").agg(F.min("lead").alias("class_id"), F.count(F.lit(1)).alias("n"))
    linked = by_key(linked.withColumnRenamed("component", "class_key"), heads.withColumnRenamed("component", "class_key"), "class_key", "n", n_members)
    alone = light.where(F.col("component").isNull()).withColumn("class_key", F.col("id")).withColumn("class_id", F.col("lead"))
    columns = ["same", "lead", "copies", "class_key", "class_id"]
    found = materialise(linked.select(columns).unionByName(alone.select(columns)), "near-classes")
    discard(lead, parts, links, more)
    return signed.select("doc_id", "same"), found, total


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): the smallest id of the documents linked to it, itself if none."""
    rows, classes, total = _classes(docs, similarity)
    return by_key(rows, classes, "same", "copies", total).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stand for their classes, one for each: that of the smallest
    id, rows without an id last, ties to the smaller hash of the text. Repeated rows
    count once."""
    _, classes, _ = _classes(docs, similarity)
    best = classes.groupBy("class_key").agg(F.min(F.struct(F.col("lead").isNull().alias("none"), "lead", "same")).alias("best"))
    best = best.select(F.col("best.lead").alias("__lead"), F.col("best.same").alias("__same"))
    own = docs.withColumn("__own", _same()).withColumn("__id", F.col("doc_id").cast("long"))
    kept = own.join(best, (F.col("__own") == F.col("__same")) & F.col("__id").eqNullSafe(F.col("__lead")), "left_semi")
    return kept.dropDuplicates(["__id", "__own"]).select(*docs.columns)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
