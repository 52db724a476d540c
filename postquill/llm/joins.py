"""N-gram Jaccard join of documents by vertical partitioning.

A document's set holds its distinct shingles of four words. All shingles have one global
order, those of very many documents last, the others by their hash; it is cut into
``FRAGMENTS`` ranges. A pair's overlaps are counted in each fragment by itself and summed:
the first fragment of all candidates, and the others of those pairs that can still link
when each of the others held all that its smaller side has.

Candidates share one of the first ``n - ceil(0.85 n) + 1`` shingles of the order, as linked
sets of n must, have sizes that allow a link, and differ in no more bits than they may
differ in shingles: each shingle flips one of ``BITS`` bits of its document's parity sketch,
so two sketches never differ in more bits than the sets in shingles. Sets of more shingles
than ``BITS`` fill such a sketch; their pairs are tested again by sketches that grow with
the set, up to ``WIDE`` bits. The tests lose no link.

Equal sets are one node. In the list of a shingle, neighbours of like sizes are compared
first, others in each list; what they link are components. Where a list still has several, its members outside
the largest component meet all its members, in blocks of ``BLOCK``, by their sketches: a
pair leaves a block only if it could join two components. Of these the closest pair of each
two components is counted first, and all pairs only of components that are still apart. So
a list of copies writes no pairs, a group of near copies few, and a list of any length is
many tasks.

Defined results: null texts, and texts without a word, have no shingles and are linked with
nothing; with fewer words than four the whole sequence is the one shingle; repeated rows are
rows, and rows of different texts may share an id; a null id never stands for a component in
which another row has one; shingles are compared by 64-bit hashes; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import discard, materialise, release, table
from .bytekit import U64, buffers, inked, mix64, prefix_hash, slices, span_hash, tidy
from .neardup import by_key

WORDS = 4
#: Linked: PARTS * intersection >= SHARE * union.
SHARE, PARTS = 85, 100
#: Fragments of the order: 2 ** FRAGMENT_BITS ranges of hashes, and one of frequent shingles.
FRAGMENT_BITS = 3
FRAGMENTS = (1 << FRAGMENT_BITS) + 1
BITS = 512
#: The most bits of a sketch that grows with its set; and so many pairs are gathered for the closest.
WIDE = 1 << 15
GATHERED = 1 << 17
#: Texts of more keys than this are joined without a filter before; a filter has 16 to 32 bits a key.
FILTERED = 1 << 22
#: A shingle is frequent from this share of all rows on; at most so many are broadcast (the
#: most frequent ones; the others stay where their hash puts them, which costs time only).
FREQUENT = 1 / 4096
MOST_FREQUENT = 1 << 19
BLOCK = 1024
_STEP = U64(0x9E3779B97F4A7C15)
_LATE = U64(1 << 63)
_SALTS = (_STEP, U64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as (text, hash), ordered by both."""
    low = _LOWER[buf]
    start, end, text = inked(low, offsets)
    h = span_hash(prefix_hash(low), start, end)
    n = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    many = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), many)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(WORDS, n[owner])
    key = size.astype(U64)
    for i in range(WORDS):
        inside = i < size
        key = np.where(inside, mix64(key * _STEP + h[np.where(inside, at + i, 0)]), key) if len(h) else key
    order = np.argsort(key)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
    owner, key = owner[order], key[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])] if len(key) else np.zeros(0, bool)
    return owner[new], key[new]


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of ``n`` with any set that it links with."""
    return -(-SHARE * n // PARTS)


def leading(owner: np.ndarray, key: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which linked sets share one, as (text, hash), of sets ordered by hash."""
    late = placed(key, frequent) >= _LATE
    if late.any():
        order = np.argsort(owner * 2 + late, kind="stable")
        owner, key = owner[order], key[order]
    n = np.bincount(owner)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    kept = nth <= (n - needed(n))[owner]
    return owner[kept], key[kept]


def placed(key: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Places in the global order; frequent shingles (sorted hashes) come last."""
    if not len(frequent):
        return key >> U64(1)
    at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
    return np.where(frequent[at] == key, _LATE | (key >> U64(1)), key >> U64(1))


def sketches(owner: np.ndarray, key: np.ndarray, texts: int) -> np.ndarray:
    """Parity sketches, a row of ``BITS // 64`` words for each text."""
    out = np.zeros((texts, BITS // 64), U64)
    if len(key):
        spot = mix64(key + _STEP) % U64(BITS)
        bit = U64(1) << (spot & U64(63))
        found, first = np.unique(owner, return_index=True)
        for w in range(BITS // 64):
            out[found, w] = np.bitwise_xor.reduceat(np.where(spot >> U64(6) == w, bit, U64(0)), first)
    return out


def wide_sketch(key: np.ndarray) -> bytes:
    """The parity sketch of a set in as many bits as it has shingles, a power of two to ``WIDE``."""
    bits = min(WIDE, 1 << (len(key) - 1).bit_length())
    odd = np.bincount((mix64(key + _STEP) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def wide_differ(a: bytes, b: bytes) -> int:
    """Bits in which two such sketches differ, the longer folded to the shorter."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that a task meets more than once among the leading ones by hash, and how
    often; beyond 2 * MOST_FREQUENT kept shingles the rare ones are forgotten."""
    none = np.zeros(0, U64)
    keys, counts, floor = none, np.zeros(0, np.int64), 0
    for batch in batches:
        buf, offsets = buffers(batch.column(0))
        for a, b in slices(offsets):
            _, key = leading(*shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), none)
            new, n = np.unique(key, return_counts=True)
            whole, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at.ravel(), np.concatenate([counts, n]), minlength=len(whole)).astype(np.int64)
            keys = whole
            if len(keys) > 2 * MOST_FREQUENT:
                floor += 1
                keys, counts = keys[counts > floor], counts[counts > floor]
    kept = counts > 1
    yield pa.RecordBatch.from_arrays([pa.array(keys[kept].astype(np.int64)), pa.array(counts[kept])], names=["key", "n"])


def frequent_shingles(rows: DataFrame, total: int, share: float = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Sorted hashes of shingles of very many rows, at most ``most``. Only speed depends on them."""
    counted = rows.select("text").mapInArrow(tidy(_count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= max(16, total * share)).orderBy(F.col("n").desc(), "key").limit(most).select("key").toArrow()
    return np.sort(found.column(0).to_numpy().astype(U64))


SIGNED = "doc_id long, same binary, sig binary, n int, sketch binary, wide binary, lead array<long>"


def _sign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            buf, offsets = buffers(batch.column(2))
            n = np.zeros(len(batch), np.int32)
            sig, sketch = np.zeros((len(batch), 2), U64), np.zeros((len(batch), BITS // 64), U64)
            lists: list = [[]] * len(batch)
            wide: list = [None] * len(batch)
            for a, b in slices(offsets):
                owner, key = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(key):
                    continue
                found, first, size = np.unique(owner, return_index=True, return_counts=True)
                n[a + found] = size
                for i in range(2):
                    sig[a + found, i] = np.add.reduceat(mix64(key ^ _SALTS[i]), first)
                sketch[a:b] = sketches(owner, key, b - a)
                of, lead = leading(owner, key, frequent)
                edge = np.searchsorted(of, np.r_[found, found[-1] + 1])
                lead = lead.astype(np.int64)
                for i, text in enumerate(found.tolist()):
                    lists[a + text] = lead[edge[i] : edge[i + 1]]
                    if size[i] > BITS:
                        wide[a + text] = wide_sketch(key[first[i] : first[i] + size[i]])
            flat = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (sig, sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat[0], pa.array(n), flat[1], pa.array(wide, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "same", "sig", "n", "sketch", "wide", "lead"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, n, id), sorted, those whose token another row has; a task's first and
    last token may go on elsewhere. ``prev`` is the row before in the token's list."""
    last: tuple | None = None  # the row not yet told: token, n, id, prev, whether its token came before
    for batch in batches:
        if not len(batch):
            continue
        token, n, id_ = (batch.column(i).to_numpy() for i in range(3))
        prev = np.full(len(token), -1, np.int64)
        if last is not None:
            token, n, id_, prev = np.r_[last[0], token], np.r_[last[1], n], np.r_[last[2], id_], np.r_[last[3], prev]
        same = token[1:] == token[:-1]
        prev[1:][same] = id_[:-1][same]
        joins = np.r_[True if last is None else last[4], same]  # the first of all may belong to the task before
        kept = (joins | np.r_[same, True])[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][kept]) for x in (token, n, id_, prev)], names=["token", "n", "id", "prev"])
        last = (token[-1], n[-1], id_[-1], prev[-1], bool(joins[-1]))
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in last[:4]], names=["token", "n", "id", "prev"])


def _possible(na: str, nb: str) -> Column:
    """Whether sets of these sizes can link."""
    return PARTS * F.least(na, nb) >= SHARE * F.greatest(na, nb)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(-1, BITS // 64)


def alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sets with these sketches and sizes can link."""
    most = (PARTS - SHARE) * (na.astype(np.int64) + nb)
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) * (PARTS + SHARE) <= most


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
        kept = pa.array(alike(_words(batch.column("sa")), _words(batch.column("sb")), na, nb))
        yield pa.RecordBatch.from_arrays([pa.array(x).filter(kept) for x in (a, b, na, nb)], names=["a", "b", "na", "nb"])


def _screen_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        most = (PARTS - SHARE) * (batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy())
        differ = np.array([wide_differ(a.as_py(), b.as_py()) for a, b in zip(batch.column("wa"), batch.column("wb"))], np.int64)
        yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(differ * (PARTS + SHARE) <= most))


def _among(shared):
    """Of rows (spot, same, text), those whose spot is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            spot = batch.column(0).to_numpy()
            yield batch.select([1, 2]).filter(pa.array((marks[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1))

    return run


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of ``wanted`` (id, same), from ``rows`` (same, text): most other texts are
    left out by a bit for each key before any text is shuffled, the rest by the join."""
    spark, many = rows.sparkSession, wanted.count()
    few = rows.select("same", "text")
    if many <= FILTERED:
        bits = max(1 << 16, 1 << (16 * many).bit_length())
        spot = F.pmod(F.xxhash64("same"), F.lit(bits)).cast("int").alias("spot")
        marks = np.zeros(bits // 8, np.uint8)
        at = wanted.select(spot).distinct().toArrow().column(0).to_numpy()
        np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
        few = few.select(spot, "same", "text").mapInArrow(_among(spark.sparkContext.broadcast(marks)), "same binary, text string")
    one = few.groupBy("same").agg(F.first("text").alias("text"))
    return one.join(wanted.select("id", F.col("same").alias("__same")).hint("merge"), F.col("same") == F.col("__same")).select("id", "text")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of batches sorted by ``key``, no group of a key in two tables."""
    kept: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if kept is None else pa.concat_tables([kept, now])
        values = now.column(key).to_numpy()
        edge = int(np.flatnonzero(np.r_[True, values[1:] != values[:-1]])[-1]) if len(values) else 0
        if edge:
            yield now.slice(0, edge).combine_chunks()
        kept = now.slice(edge)
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks()


PAIR = "a long, b long, na int, nb int"
MET = f"{PAIR}, p long, q long, d int"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block (group) that could join two components (part; p and q, the smaller
    first), of different sides unless the block has one, with the bits d that they differ in:
    every row with those after it, in the order of sizes, until sizes forbid a link. All
    blocks of a table go on together."""
    for rows in whole_groups(batches, "group"):
        group, n, id_, part, side = (rows.column(c).to_numpy() for c in ("group", "n", "id", "part", "side"))
        n, sketch = n.astype(np.int64), _words(rows.column("sketch").combine_chunks() if isinstance(rows.column("sketch"), pa.ChunkedArray) else rows.column("sketch"))
        at, lag = np.arange(len(group)), 0
        while len(at):
            lag += 1
            at = at[at + lag < len(group)]
            to = at + lag
            at = at[(group[at] == group[to]) & (PARTS * n[at] >= SHARE * n[to])]
            to = at + lag
            pick = (part[at] != part[to]) & ((side[at] != side[to]) | (side[at] < 0))
            i, j = at[pick], to[pick]
            pick = alike(sketch[i], sketch[j], n[i], n[j])
            i, j = i[pick], j[pick]
            if len(i):
                turn = id_[i] > id_[j]
                i, j = np.where(turn, j, i), np.where(turn, i, j)
                p, q = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
                d = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (id_[i], id_[j], n[i].astype(np.int32), n[j].astype(np.int32), p, q, d)], names=["a", "b", "na", "nb", "p", "q", "d"])


def _closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs that meet, the closest of each two components; of many components, some are told twice."""
    kept: list[pa.RecordBatch] = []
    for batch in _meet(batches):
        kept.append(batch)
        if sum(map(len, kept)) > GATHERED:
            kept = [_nearest(kept)]
            if len(kept[0]) > GATHERED // 2:
                yield kept.pop()
    if kept:
        yield _nearest(kept)


def _nearest(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    all_ = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    a, b, p, q, d = (all_.column(c).to_numpy() for c in ("a", "b", "p", "q", "d"))
    order = np.lexsort((b, a, d, q, p))
    p, q = p[order], q[order]
    return all_.take(pa.array(order[np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]]))


SEGMENT = "id long, fragment int, sizes array<int>, shingles array<long>"


def _cut(shared):
    """Fragments of sets: a row for each of (id, text), with the sizes of all its fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            buf, offsets = buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for a, b in slices(offsets):
                owner, key = shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                place = placed(key, frequent)
                fragment = np.where(place >= _LATE, U64(FRAGMENTS - 1), place >> U64(63 - FRAGMENT_BITS)).astype(np.int64)
                cell = owner * FRAGMENTS + fragment
                order = np.argsort(cell, kind="stable")
                edges = np.searchsorted(cell[order], np.arange((b - a) * FRAGMENTS + 1))
                sizes = np.repeat(np.diff(edges).reshape(-1, FRAGMENTS), FRAGMENTS, axis=0).ravel().astype(np.int32)
                many = (b - a) * FRAGMENTS
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids[a:b], FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), b - a)),
                    pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * FRAGMENTS), pa.array(sizes)),
                    pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(key[order].astype(np.int64))),
                ], names=["id", "fragment", "sizes", "shingles"])

    return run


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``pairs`` (a, b, fragment, ...) with ``part``: the overlap in their fragment; and the
    sizes of both sides' fragments."""
    left = segments.select(F.col("id").alias("__a"), F.col("fragment").alias("__fa"), F.col("sizes").alias("sizes_a"), F.col("shingles").alias("in_a"))
    right = segments.select(F.col("id").alias("__b"), F.col("fragment").alias("__fb"), F.col("sizes").alias("sizes_b"), F.col("shingles").alias("in_b"))
    both = pairs.join(left, (F.col("a") == F.col("__a")) & (F.col("fragment") == F.col("__fa"))).join(right, (F.col("b") == F.col("__b")) & (F.col("fragment") == F.col("__fb")))
    return both.withColumn("part", F.size(F.array_intersect("in_a", "in_b"))).drop("__a", "__b", "__fa", "__fb", "in_a", "in_b")


def linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The links (a, b) among ``pairs`` (a, b, na, nb): overlaps counted fragment by fragment, and summed."""
    enough = lambda overlap: (PARTS + SHARE) * overlap >= SHARE * (F.col("na") + F.col("nb"))
    first = _overlaps(pairs.withColumn("fragment", F.lit(0)), segments)
    most = F.aggregate(F.zip_with(F.slice("sizes_a", 2, FRAGMENTS), F.slice("sizes_b", 2, FRAGMENTS), lambda x, y: F.least(x, y)), F.col("part"), lambda x, y: x + y)
    open_ = materialise(first.where(enough(most)).select("a", "b", "na", "nb", F.col("part").alias("begun")), "join-open")
    rest = open_.withColumn("fragment", F.explode(F.sequence(F.lit(1), F.lit(FRAGMENTS - 1))))
    summed = _overlaps(rest, segments).groupBy("a", "b", "na", "nb", "begun").agg(F.sum("part").alias("rest"))
    return summed.where(enough(F.col("begun") + F.col("rest"))).select("a", "b")


def jaccard_components(docs: DataFrame, block: int = BLOCK, share: float = FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("same"), text.alias("text"))
    total = rows.count()
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows, total, share))
    signed = materialise(rows.mapInArrow(tidy(_sign(frequent)), SIGNED), "join-signs")

    # one node for each set; its number holds from here on, as the table is written
    one = [F.first(c).alias(c) for c in ("n", "sketch", "wide", "lead")]
    nodes = signed.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("same").alias("same"), *one)
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "join-nodes")
    whole_rows, signed = signed, materialise(signed.select("doc_id", "n", "sig"), "join-rows")
    discard(whole_rows)
    release(spark)
    count = nodes.select(F.sum(F.size("lead"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // 1_000_000)
    lists = nodes.select(F.explode("lead").alias("token"), "n", "id")
    # in another order for each shingle among sets of like sizes, so that the neighbours differ from list to list
    order = ["token", F.floor(F.log("n") * 12), F.xxhash64("token", "id")]
    lists = lists.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lists = materialise(lists.mapInArrow(_shared, "token long, n int, id long, prev long"), "join-lists")
    whole_nodes, nodes = nodes, materialise(nodes.drop("lead"), "join-sets")
    discard(whole_nodes)
    release(spark)

    sizes = nodes.select("id", "n", "sketch")
    done: list[DataFrame] = []

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs``; only the texts that they need are read again."""
        met = materialise(pairs, "join-met")
        long_ = F.least("na", "nb") > BITS
        wide_a, wide_b = (nodes.where(F.col("n") > BITS).select(F.col("id").alias(f"__{c}"), F.col("wide").alias(f"w{c}")) for c in "ab")
        wide = met.where(long_).join(wide_a, F.col("a") == F.col("__a")).join(wide_b, F.col("b") == F.col("__b"))
        pairs = materialise(met.where(~long_).unionByName(wide.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_screen_wide, PAIR)), "join-pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("__id")).distinct()
        wanted = materialise(nodes.select("id", "same").join(wanted, F.col("id") == F.col("__id"), "left_semi"), "join-wanted")
        segments = materialise(texts_of(rows, wanted).mapInArrow(tidy(_cut(frequent)), SEGMENT), "join-segments")
        discard(met, wanted)
        release(spark)
        found = materialise(linked(pairs, segments), "join-links")
        discard(segments, pairs)
        release(spark)
        return found

    # neighbours in the lists first
    near = lists.where("prev >= 0").select(F.least("id", "prev").alias("a"), F.greatest("id", "prev").alias("b")).distinct()
    left, right = (sizes.select(F.col("id").alias(f"__{c}"), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    near = near.join(left, F.col("a") == F.col("__a")).join(right, F.col("b") == F.col("__b")).where(_possible("na", "nb"))
    links = verified(near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_screen, PAIR))
    parts_of = materialise(connected_components(links), "join-parts")

    def placed_in(parts_of: DataFrame) -> DataFrame:
        """(__id, sketch, part) of every set; a set without links is a part by itself."""
        own = nodes.select("id", "sketch").join(parts_of.select(F.col("id").alias("__id"), "component"), F.col("id") == F.col("__id"), "left")
        return own.select(F.col("id").alias("__id"), "sketch", F.coalesce("component", "id").alias("part"))

    def meeting(own: DataFrame) -> DataFrame:
        """Where a list holds several components, those outside the largest with all, by blocks."""
        members = lists.select("token", "n", "id").join(own.select("__id", "part"), F.col("id") == F.col("__id")).drop("__id")
        split = members.groupBy("token", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("token")
        split = split.agg(F.sum("k").alias("m"), F.max(F.struct("k", "part")).alias("most"), F.count(F.lit(1)).alias("__parts")).where("__parts > 1")
        blocks = lambda rows_: F.ceil(rows_ / F.lit(block)).cast("int")
        split = materialise(split.select("token", "m", F.col("most.part").alias("big"), blocks(F.col("most.k")).alias("bigs"), blocks(F.col("m") - F.col("most.k")).alias("outs")), "join-split")
        apart = by_key(members, split, "token", "m", count)
        inner = F.col("part") == F.col("big")
        spread = F.pmod(F.xxhash64("id", F.lit(1)), F.when(inner, F.col("bigs")).otherwise(F.col("outs"))).cast("int")
        apart = apart.withColumn("own", spread)
        whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side")))
        outs = F.sequence(F.lit(0), F.col("outs") - 1)
        among = F.transform(outs, lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(o == F.col("own"), -1).when(F.col("own") < o, 0).otherwise(1).alias("side")))
        with_big = F.transform(F.sequence(F.lit(0), F.col("bigs") - 1), lambda o: F.struct(F.col("own").alias("i"), (-1 - o).alias("j"), F.lit(0).alias("side")))
        from_big = F.transform(outs, lambda o: F.struct(o.alias("i"), (-1 - F.col("own")).alias("j"), F.lit(1).alias("side")))
        at = F.when(F.col("m") <= block, whole).when(inner, from_big).otherwise(F.concat(among, with_big))
        apart = apart.withColumn("at", F.explode(at)).select(F.xxhash64("token", "at.i", "at.j").alias("group"), "n", "id", "part", "at.side")
        apart = apart.join(own.select("__id", "sketch"), F.col("id") == F.col("__id")).drop("__id")
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        done.append(split)
        return apart.repartition(tasks, "group").sortWithinPartitions("group", "n", "id")

    # first the closest pair of each two components
    closest = meeting(placed_in(parts_of)).mapInArrow(_closest, MET).groupBy("p", "q").agg(F.min(F.struct("d", "a", "b", "na", "nb")).alias("pair"))
    closest = materialise(closest.select("pair.a", "pair.b", "pair.na", "pair.nb"), "join-closest")
    more = verified(closest)
    done += [closest, more]
    if more.limit(1).count():
        done += [parts_of, links]
        links = materialise(links.unionByName(more), "join-links")
        parts_of = materialise(connected_components(links), "join-parts")

    # then all pairs of components that have met and are still apart
    own = placed_in(parts_of)
    part_a, part_b = (own.select(F.col("__id").alias(f"__{c}"), F.col("part").alias(f"p{c}")) for c in "ab")
    apart = closest.join(part_a, F.col("a") == F.col("__a")).join(part_b, F.col("b") == F.col("__b")).where("pa <> pb")
    apart = materialise(apart.select(F.explode(F.array("pa", "pb")).alias("__part")).distinct(), "join-apart")
    rest = meeting(own.join(apart, F.col("part") == F.col("__part"), "left_semi")).mapInArrow(_meet, MET)
    more = verified(rest.select("a", "b", "na", "nb").distinct())
    done += [apart, more]
    if more.limit(1).count():
        done += [parts_of, links]
        links = materialise(links.unionByName(more), "join-links")
        parts_of = materialise(connected_components(links), "join-parts")

    # rows get the smallest id of their component's sets
    light = nodes.select("id", "sig", "least", "copies").join(parts_of.select(F.col("id").alias("__id"), "component"), F.col("id") == F.col("__id"), "left").drop("__id")
    light = light.withColumn("component", F.coalesce("component", "id"))
    heads = light.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    named = materialise(by_key(light, heads, "component", "k", total).select("sig", "copies", "component_id"), "join-named")
    discard(nodes, lists, links, parts_of, *done)
    release(spark)
    full = by_key(signed.where("n > 0").select("doc_id", "n", "sig"), named, "sig", "copies", total).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return full.unionByName(signed.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the links between all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i : i + {WORDS} - 1], ' '))) END AS s FROM worded),
grams AS (SELECT doc_id, unnest(s) AS g FROM cut),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN cut a ON a.doc_id = x JOIN cut b ON b.doc_id = y WHERE {PARTS} * c >= {SHARE} * (len(a.s) + len(b.s) - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT x, x FROM ends UNION SELECT r.a, e.y FROM reach r JOIN ends e ON e.x = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id FROM cut LEFT JOIN least ON a = doc_id
"""
