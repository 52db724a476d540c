"""A lexical index of immutable segments, searched no further than a bound allows.

A change writes a segment of the new texts and tombstones for the rows that it replaces or
removes; nothing that was written is rewritten, so the work follows the change. Segments of
like size are merged once there are ``fan`` of them, without their dead rows, so a row is
written again about as often as the logarithm of the index. A new one that would be merged at
once takes the others in as it is written. Document frequencies and lengths
are those of the living: counts of all segments less those of the tombstones, joined at search.

Postings lie in blocks, one for a term and a stripe of documents; the documents of a stripe
have like lengths. Beside a block stand its number of rows, its largest term frequency and its
shortest length, which bound what any of its rows can add to a score, whatever the statistics
are by then. A search adds up these heads by stripe, in tiles of stripes and questions, and
scores the stripes with the largest bounds for each question. The ``k``-th score found is what
a row must reach: a stripe stays whose bound reaches that of some question, and its living rows
are put together and scored, in tiles again. The others cannot enter a run and are not read.
No table holds pairs of a question and a block or a document.

So many questions at once that every stripe is open to some of them have nothing from bounds:
``scan`` reads each living row once, with the words that are asked for, and scores it in tiles.

A manifest that is replaced as a whole names what is in force, so a reader sees a change
entirely or not at all, and a writer that dies leaves files that nobody reads.

Defined results: the last of a batch's rows with one id counts by ``gone``, then text; removing
an unknown id does nothing; a null text is empty; an empty text is a row of length 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from ..sources import versions
from ..sources.tables import read_if_there
from . import lexical, tiles

FAN = 4
#: Documents of a stripe, about.
STRIPE = 16
#: Stripes that a query scores before it has a bound.
FIRST = 32
#: Up to this many keys are pushed to a scan as a filter, more are joined.
PUSHED = 1000
#: Words that a task puts into blocks, about, and postings that it holds at a time.
PACKED, HELD = 1_500_000, 4_000_000
#: Up to this many asked words are known to the tasks that read documents; beyond, all words travel.
KNOWN = 500_000
_SLACK = 2e-6

MANIFEST = "kind string, name string, n long, dl long"
POSTINGS = "term string, stripe long, n int, tf_max int, dl_min int, items array<struct<id: string, tf: int, dl: int>>, segment string"
DOCS = "id string, dl int, terms array<string>, tfs array<int>, segment string"
DEAD = "in_segment string, id string, dl int, terms array<string>, batch string"


def _manifest(spark: SparkSession, root: str) -> list:
    """What is in force: a row for each segment and each batch of tombstones."""
    return versions.read(spark, f"{root}/manifest", MANIFEST).collect()


def _publish(spark: SparkSession, root: str, rows: list) -> None:
    versions.replace(spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{root}/manifest")


def _read(spark: SparkSession, root: str, name: str, schema: str, part: str, kept: list[str]) -> DataFrame:
    return read_if_there(spark, f"{root}/{name}", schema).where(F.col(part).isin(kept) if kept else F.lit(False))


def _state(spark: SparkSession, root: str) -> tuple[list, list[str], DataFrame]:
    rows = _manifest(spark, root)
    live = [r["name"] for r in rows if r["kind"] == "segment"]
    dead = _read(spark, root, "dead", DEAD, "batch", [r["name"] for r in rows if r["kind"] == "dead"])
    return rows, live, dead.where(F.col("in_segment").isin(live) if live else F.lit(False))


def _band() -> Column:
    return F.floor(F.log2(F.col("dl") + F.lit(1.0)) * 8).cast("long")


def _striped(docs: DataFrame, sizes: list) -> DataFrame:
    """docs with a stripe: lengths of a class of an eighth of an octave, dealt by the hash of the
    id. Stripes go in order to parts of like length. ``sizes`` are (class, first stripe, stripes,
    words before, words)."""
    known = docs.sparkSession.createDataFrame(sizes, "__band long, __first long, __many long, __before long, __words long")  # a row for each class of lengths, of which there are a few hundred
    placed = docs.withColumn("__band", _band()).join(F.broadcast(known), "__band")
    nth = F.pmod(F.xxhash64("id"), F.col("__many"))
    part = F.floor((F.col("__before") + F.col("__words") * (nth / F.col("__many"))) / F.lit(PACKED)).cast("int")
    return placed.select("id", "dl", "terms", "tfs", (F.col("__first") + nth).cast("long").alias("stripe"), part.alias("part"))


_WORD = np.zeros(256, bool)
_WORD[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_", np.uint8)] = True


def _worded(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``lexical.terms`` of lowered texts, stop words among them: (row, word), text by text."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    word = _WORD[data]
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    before[ends[:-1][ends[:-1] < len(data)]] = False  # no word goes on into the next text
    after[ends[1:][ends[1:] > 0] - 1] = False
    begin, end = np.flatnonzero(word & ~before[: len(word)]), np.flatnonzero(word & ~after[: len(word)]) + 1
    size = end - begin
    word[begin[size < 2]] = False
    begin, size = begin[size > 1], size[size > 1]
    row = np.searchsorted(ends, begin, "right") - 1
    return row, pa.StringArray.from_buffers(len(size), pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(data[word].tobytes()))


def _read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, terms, tfs) from (id, lowered text)."""
    for batch in batches:
        row, words = _worded(batch.column(1))
        words = words.dictionary_encode()
        here = words.indices.to_numpy(zero_copy_only=False)
        kept = ~pc.is_in(words.dictionary, value_set=pa.array(lexical.STOPWORDS)).to_numpy(zero_copy_only=False)[here] if len(here) else np.zeros(0, bool)
        yield _rows(batch.column(0), row[kept], here[kept], words.dictionary)


def _rows(ids: pa.Array, row: np.ndarray, word: np.ndarray, dictionary: pa.Array) -> pa.RecordBatch:
    size, many = np.bincount(row, minlength=len(ids)), max(len(dictionary), 1)
    cell, tf = np.unique(row * many + word, return_counts=True)
    row, term = np.divmod(cell, many)
    ends = pa.array(np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32))
    terms, tfs = pa.ListArray.from_arrays(ends, dictionary.take(pa.array(term))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))
    return pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int32)), terms, tfs], names=["id", "dl", "terms", "tfs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, terms, tfs) from (id, tokens): a row's distinct terms and how often it has each."""
    for batch in batches:
        lists = batch.column(1)
        size = pc.list_value_length(lists).to_numpy()
        words = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(batch)), size)
        yield _rows(batch.column(0), row, words.indices.to_numpy(), words.dictionary)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (term, stripe, n, tf_max, dl_min, items) by term and stripe, from (id, dl, terms, tfs,
    stripe) by stripe and id. About ``HELD`` postings are held at a time; a stripe is never cut."""
    held, many = [], 0
    for batch in batches:
        for a in range(0, len(batch), 1024):
            some = batch.slice(a, 1024)
            held.append(some)
            many += pc.sum(pc.list_value_length(some.column(2))).as_py() or 0
            if many >= HELD:
                whole = pa.Table.from_batches(held)
                stripe = whole.column(4).to_numpy()
                cut = int(np.searchsorted(stripe, stripe[-1]))
                yield from _blocks(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                many = sum(pc.sum(pc.list_value_length(x.column(2))).as_py() or 0 for x in held)
    if held:
        yield from _blocks(pa.Table.from_batches(held))


def _blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    if not len(rows):
        return
    ids, dl, terms, tfs, stripe = (rows.column(i).combine_chunks() for i in range(5))
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(terms).to_numpy())
    if not len(row):
        return
    words = terms.flatten().dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    stripe = stripe.to_numpy()
    first, wide = stripe[0], stripe[-1] - stripe[0] + 1
    key = place[words.indices.to_numpy()] * wide + stripe[row] - first
    by = np.argsort(key, kind="stable")  # rows of a stripe stay in order of their ids
    key, row = key[by], row[by]
    tf, dl = tfs.flatten().to_numpy()[by], dl.to_numpy()[row]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[begin, len(key)])
    term, at = np.divmod(key[begin], wide)
    tf_max, dl_min = np.maximum.reduceat(tf, begin), np.minimum.reduceat(dl, begin)
    begin = np.r_[begin, len(key)]
    for a in range(0, len(n), 65536):
        b = min(a + 65536, len(n))
        x, y = begin[a], begin[b]
        items = pa.StructArray.from_arrays([ids.take(pa.array(row[x:y])), pa.array(tf[x:y]), pa.array(dl[x:y])], names=["id", "tf", "dl"])
        yield pa.RecordBatch.from_arrays([
            words.dictionary.take(pa.array(order[term[a:b]])), pa.array(at[a:b] + first), pa.array(n[a:b].astype(np.int32)), pa.array(tf_max[a:b]), pa.array(dl_min[a:b]),
            pa.ListArray.from_arrays(pa.array((begin[a : b + 1] - x).astype(np.int32)), items),
        ], names=["term", "stripe", "n", "tf_max", "dl_min", "items"])


def _write(docs: DataFrame, root: str, stripe: int) -> tuple[str, int, int]:
    """A segment from docs (id, dl, terms, tfs); its name, rows and length. Documents are dealt
    by stripe; a file of postings has all blocks of its stripes, by term."""
    name = uuid.uuid4().hex
    docs.write.option("compression", "zstd").parquet(f"{root}/docs/segment={name}")
    kept = docs.sparkSession.read.schema("id string, dl int, terms array<string>, tfs array<int>").parquet(f"{root}/docs/segment={name}")
    sizes, first, words = [], 0, 0
    lengths = kept.groupBy(_band().alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")).orderBy("band").collect()  # a few hundred
    for r in lengths:
        sizes.append((r["band"], first, -(-r["n"] // stripe), words, r["dl"]))
        first, words = first + sizes[-1][2], words + r["dl"]
    if sizes:
        placed = _striped(kept, sizes).repartitionById(words // PACKED + 1, F.col("part")).sortWithinPartitions("stripe", "id")
        placed.drop("part").mapInArrow(_packed, "term string, stripe long, n int, tf_max int, dl_min int, items array<struct<id: string, tf: int, dl: int>>").write.option("compression", "zstd").parquet(f"{root}/postings/segment={name}")
    return name, sum(r["n"] for r in lengths), words


def apply(changes: DataFrame, root: str, fan: int = FAN, stripe: int = STRIPE, tokens: Callable[[Column], Column] = lexical.terms) -> None:
    """Puts the texts of ``changes`` (id, text, gone) in place of what their ids had, and removes
    those that are ``gone``."""
    spark = changes.sparkSession
    rows, live, dead = _state(spark, root)
    kept = materialise(changes.select(F.col("id").cast("string").alias("id"), F.coalesce("gone", F.lit(False)).alias("gone"), F.coalesce("text", F.lit("")).alias("text")), "segment-change")
    once, twice = lexical._by_id(kept)  # texts stay where they are, except those of ids that are there twice
    last = twice.groupBy("id").agg(F.max(F.struct("gone", "text")).alias("last")).select("id", "last.*")
    texts = once.unionByName(last).where("not gone")
    n_new, new, held, absorbed = texts.count(), [], None, []
    docs = _read(spark, root, "docs", DOCS, "segment", live)
    out = dead.select(F.col("in_segment").alias("segment"), "id")
    if live:
        held = docs.select("segment", "id").join(kept.select("id"), "id", "left_semi")  # ids alone are read of all
        held = materialise(held.join(out, ["segment", "id"], "left_anti"), "segment-held")
        absorbed = _absorbed(rows, n_new, out.unionByName(held), fan) if n_new else []
    if n_new:
        if tokens is lexical.terms:
            counted = texts.select("id", F.lower("text").alias("text")).mapInArrow(_read_words, "id string, dl int, terms array<string>, tfs array<int>")
        else:
            counted = texts.select("id", tokens(F.col("text")).alias("tokens")).mapInArrow(_counted, "id string, dl int, terms array<string>, tfs array<int>")
        if absorbed:
            old = docs.where(F.col("segment").isin(absorbed)).join(out.unionByName(held), ["segment", "id"], "left_anti")
            counted = counted.unionByName(old.select("id", "dl", "terms", "tfs"))
        name, n, dl = _write(counted, root, stripe)
        new.append(("segment", name, n, dl))
    if live:
        held = held.where(~F.col("segment").isin(absorbed)) if absorbed else held
        some = [r["id"] for r in held.select("id").limit(PUSHED + 1).collect()]
        if some:
            there = docs.where(F.col("id").isin(some)) if len(some) <= PUSHED else docs
            gone = there.join(held, ["segment", "id"], "left_semi").select(F.col("segment").alias("in_segment"), "id", "dl", "terms")
            batch = uuid.uuid4().hex
            gone.write.option("compression", "zstd").parquet(f"{root}/dead/batch={batch}")
            new.append(("dead", batch, len(some) if len(some) <= PUSHED else held.count(), 0))
    _publish(spark, root, _without(rows, dead, absorbed) + new)
    while merge(spark, root, fan, stripe):
        pass


def _absorbed(rows: list, n_new: int, gone: DataFrame, fan: int) -> list[str]:
    """Segments that would be merged with a new one of ``n_new`` rows as soon as it is there."""
    lost = {r["segment"]: r["count"] for r in gone.groupBy("segment").count().collect()}  # a row a segment
    left, found = [r for r in rows if r["kind"] == "segment"], []
    while True:
        same = [r for r in left if _tier(r["n"], fan) == _tier(n_new, fan)]
        if not same or len(same) + 1 < fan:
            return found
        found += [r["name"] for r in same]
        left = [r for r in left if r["name"] not in found]
        n_new += sum(r["n"] - lost.get(r["name"], 0) for r in same)


def _without(rows: list, dead: DataFrame, full: list[str]) -> list[tuple]:
    """What stays in force without the segments ``full``: others, and tombstones that name them."""
    if not full:
        return [tuple(r) for r in rows]
    here = {r[0] for r in dead.where(~F.col("in_segment").isin(full)).select("batch").distinct().collect()}  # batches are at most as many as changes
    return [tuple(r) for r in rows if r["name"] not in full and (r["kind"] == "segment" or r["name"] in here)]


def _tier(n: int, fan: int) -> int:
    tier = 0
    while n >= fan:
        n, tier = n // fan, tier + 1
    return tier


def merge(spark: SparkSession, root: str, fan: int = FAN, stripe: int = STRIPE) -> bool:
    """Merges the segments of the smallest tier that has ``fan`` of them; whether there was one."""
    rows, _, dead = _state(spark, root)
    tiers: dict[int, list] = {}
    for r in rows:
        if r["kind"] == "segment":
            tiers.setdefault(_tier(r["n"], fan), []).append(r["name"])
    full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan), None)
    if full is None:
        return False
    gone = dead.select(F.col("in_segment").alias("segment"), "id")
    docs = _read(spark, root, "docs", DOCS, "segment", full).join(gone, ["segment", "id"], "left_anti")
    name, n, dl = _write(docs.select("id", "dl", "terms", "tfs"), root, stripe)
    _publish(spark, root, _without(rows, dead, full) + ([("segment", name, n, dl)] if n else []))
    return True


def _asked_postings(spark: SparkSession, root: str, live: list[str], asked: DataFrame) -> DataFrame:
    postings = _read(spark, root, "postings", POSTINGS, "segment", live)
    words = [r["term"] for r in asked.select("term").distinct().limit(PUSHED + 1).collect()]
    if len(words) <= PUSHED:
        return postings.where(F.col("term").isin(words))
    return postings.join(asked.select("term").distinct(), "term", "left_semi")


def _totals(rows: list, dead: DataFrame) -> tuple:
    """Rows and length of the dead; number and mean length of the living."""
    gone = dead.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    n = sum(r["n"] for r in rows if r["kind"] == "segment") - gone["n"]
    return gone, n, (sum(r["dl"] for r in rows if r["kind"] == "segment") - gone["dl"]) / max(n, 1)


def _living_df(heads: DataFrame, dead: DataFrame, asked: DataFrame) -> DataFrame:
    lost = dead.select(F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("lost"))
    return heads.groupBy("term").agg(F.sum("n").alias("df")).join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df")).where("df > 0")


def _weight(asked: DataFrame, df: DataFrame, n: int) -> DataFrame:
    return asked.join(df, "term").select("qid", "term", "qtf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def _told(weight: DataFrame) -> DataFrame:
    return weight.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w")))).alias("s"))


def _shares(known, norm: Callable[[np.ndarray], np.ndarray]):
    """(segment, id, words, values): the words of a row that are known, all without ``known``, and
    what each adds to a score for a weight of 1; rows without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if known is None else pa.array(known.value)
        for batch in batches:
            lists = batch.column(3)
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
            words, tf = lists.flatten(), batch.column(4).flatten().to_numpy().astype(np.float64)
            if asked is not None:
                at = np.flatnonzero(pc.is_in(words, value_set=asked).to_numpy(zero_copy_only=False))
                row, words, tf = row[at], words.take(pa.array(at)), tf[at]
            value = tf / (tf + norm(batch.column(2).to_numpy().astype(np.float64))[row])
            there, begin = np.unique(row, return_index=True)
            ends = pa.array(np.r_[begin, len(row)].astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(ends, words), lexical._SEP)
            there = pa.array(there)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(there), batch.column(1).take(there), joined, pa.ListArray.from_arrays(ends, pa.array(value))], names=["segment", "id", "words", "values"])

    return run


def scan(spark: SparkSession, root: str, queries: DataFrame, k: int = 100, k1: float = lexical.K1, b: float = lexical.B, tokens: Callable[[Column], Column] = lexical.terms) -> DataFrame:
    """The run of ``search`` without bounds: each living row is read once and scored for all questions."""
    rows, live, dead = _state(spark, root)
    asked = materialise(lexical.asked_terms(queries, tokens), "segment-asked")
    gone, n, avgdl = _totals(rows, dead)
    df = _living_df(_asked_postings(spark, root, live, asked).select("term", "n"), dead, asked)
    told = materialise(_told(_weight(asked, df, n)), "segment-asked-weights")
    words = [r["term"] for r in asked.select("term").distinct().limit(KNOWN + 1).collect()]
    known = spark.sparkContext.broadcast(words) if len(words) <= KNOWN else None
    docs = _read(spark, root, "docs", DOCS, "segment", live).select("segment", "id", "dl", "terms", "tfs")
    per = k1 * b / max(avgdl, 1e-9)
    held = docs.mapInArrow(_shares(known, lambda dl: k1 * (1 - b) + per * dl), "segment string, id string, words string, values array<double>")
    if gone["n"]:
        held = held.join(dead.select(F.col("in_segment").alias("segment"), "id"), ["segment", "id"], "left_anti")
    shape = lambda rows, key, *of: rows.select(key, F.lit(0).alias("size"), *of)
    found = tiles.search(shape(held, "id", "words", "values"), max(n, 0), shape(told, "qid", F.array_join("s.term", lexical._SEP).alias("words"), F.col("s.w").alias("values")), told.count(), k, _lifted, lexical.PART_ROWS, lexical.QUERY_GROUP, floor=0.0)
    return lexical.ranked(found, k, "bm25")


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = 100, k1: float = lexical.K1, b: float = lexical.B, first: int = FIRST, tokens: Callable[[Column], Column] = lexical.terms) -> tuple[DataFrame, DataFrame]:
    """The run of ``lexical.bm25(..., keep_zero=False)`` over the living rows, and (qid,
    rows_read, rows_all): postings read for a query, and all of its terms."""
    rows, live, dead = _state(spark, root)
    asked = materialise(lexical.asked_terms(queries, tokens), "segment-asked")
    postings = _asked_postings(spark, root, live, asked)
    gone, n, avgdl = _totals(rows, dead)
    heads = materialise(postings.select("segment", "term", "stripe", "n", "tf_max", "dl_min"), "segment-heads")
    df = _living_df(heads, dead, asked)
    weight = _weight(asked, df, n)
    weight = materialise(weight, "segment-weights")
    share = lambda tf, dl: F.col(tf) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.lit(max(avgdl, 1e-9))))
    of = F.concat_ws(":", "segment", F.col("stripe").cast("string"))
    # what a block can add to a score at most, for a weight of 1: a row for each stripe
    lifts = F.sort_array(F.collect_list(F.struct("term", share("tf_max", "dl_min").alias("most"), "n")))
    stripes = materialise(heads.join(df.select("term"), "term", "left_semi").groupBy(of.alias("id")).agg(lifts.alias("s")), "segment-stripes")
    many = stripes.count()
    told = materialise(_told(weight), "segment-asked-weights")
    n_asked = told.count()

    def shaped(rows: DataFrame, key: str, *values: Column) -> DataFrame:
        return rows.select(key, F.lit(0).alias("size"), F.array_join("s.term", lexical._SEP).alias("words"), F.concat(*values).alias("values"))

    def scored(rows: DataFrame, n_rows: int, best: int) -> DataFrame:
        return tiles.search(shaped(rows, "id", F.col("s.most")), n_rows, shaped(told, "qid", F.col("s.w")), n_asked, best, _lifted, lexical.PART_ROWS, lexical.QUERY_GROUP, floor=0.0)

    def living(blocks: DataFrame) -> DataFrame:
        """(stripe, id, term, most) of the living rows of blocks (segment, stripe, term, items, of)."""
        held = blocks.select("segment", "of", "term", F.explode("items").alias("x")).select("segment", "of", "term", "x.*")
        held = held.join(F.broadcast(gone_ids) if gone["n"] <= PUSHED else gone_ids, ["segment", "id"], "left_anti")
        return held.select("of", "id", "term", share("tf", "dl").alias("most"))

    gone_ids = dead.select(F.col("in_segment").alias("segment"), "id")
    # the stripes of the largest bounds first: their scores tell what a row must reach
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    early = materialise(scored(stripes, many, first).withColumn("place", place).where(F.col("place") <= first).select("qid", F.col("id").alias("of"), "score"), "segment-early")
    blocks = postings.withColumn("of", of)
    begun = living(blocks.join(early.select("of").distinct(), "of", "left_semi")).join(early.select("qid", "of"), "of").join(weight, ["qid", "term"])
    begun = begun.groupBy("qid", "id").agg(F.sum(F.col("most") * F.col("qtf") * F.col("idf")).alias("score"))
    edge = lexical.ranked(begun, k, "bm25").where(F.col("rank") == k).select("qid", (F.col("score") - _SLACK).alias("edge"))
    told = materialise(told.join(edge, "qid", "left").withColumn("edge", F.coalesce("edge", F.lit(0.0))), "segment-told")
    pairs = tiles.dealt(shaped(stripes, "id", F.col("s.most"), F.col("s.n").cast("array<double>")), many, shaped(told, "qid", F.col("s.w"), F.array("edge")), n_asked, lexical.PART_ROWS, lexical.QUERY_GROUP)
    opened = materialise(pairs.mapInArrow(_opened, f"qid {told.schema['qid'].dataType.simpleString()}, of string, rows_read long, rows_all long"), "segment-open")
    open_ = opened.where("of IS NOT NULL").select("of").distinct()
    rows_ = living(blocks.join(open_, "of", "left_semi")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "most"))).alias("s"))  # an id lives once
    run = lexical.ranked(scored(rows_, max(n, 0), k), k, "bm25")
    # read early, but not open to the question by then
    shut = early.join(told.select("qid", "edge"), "qid").where(F.col("score") < F.col("edge"))
    shut = shut.join(heads.withColumn("of", of).select("of", "term", "n"), "of").join(weight, ["qid", "term"]).groupBy("qid").agg(F.sum("n").alias("rows_read"))
    reads = opened.where("of IS NULL").select("qid", "rows_read", "rows_all").unionByName(shut.select("qid", "rows_read", F.lit(0).cast("long").alias("rows_all")))
    return run, reads.groupBy("qid").agg(F.sum("rows_all").alias("rows_all"), F.sum("rows_read").alias("rows_read"))


def _lifted(words: pa.Array, values: pa.Array) -> Callable[[pa.Array, pa.Array], tiles.Scores]:
    """Sums of a row's values, one a word, by the weights that questions give to the words."""
    weights, known, words_of = _matrix(words, values.flatten().to_numpy())

    def scores(words: pa.Array, values: pa.Array) -> tiles.Scores:
        row, col, at = words_of(words)
        most = values.flatten().to_numpy()[at]
        numbers, begin = np.unique(row, return_index=True)
        begin, step, a = np.r_[begin, len(row)], max(1, tiles.HELD // weights.shape[1]), 0
        while a < len(numbers):
            b = max(a + 1, int(np.searchsorted(begin, begin[a] + step, "right")) - 1)
            these = slice(begin[a], begin[b])
            yield numbers[a:b], np.add.reduceat(weights[col[these]] * most[these, None], begin[a:b] - begin[a])
            a = b

    return scores


def _matrix(words: pa.Array, values: np.ndarray) -> tuple[np.ndarray, pa.Array, Callable]:
    """Weights (words x questions), the words, and what finds them in rows: (row, word, position)."""
    lists = pc.split_pattern(words, lexical._SEP)
    known = pc.unique(lists.flatten())
    weights = np.zeros((len(known), len(lists)))
    weights[pc.index_in(lists.flatten(), value_set=known).to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())] = values

    def words_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = pc.split_pattern(words, lexical._SEP)
        col = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        at = np.flatnonzero(col >= 0)
        return row[at], col[at], at

    return weights, known, words_of


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes whose bound reaches the edge of some question of the tile, then for each question
    the rows of its terms in the stripes that are open to it, and in all."""
    names, asked, weights = ["qid", "of", "rows_read", "rows_all"], [], None
    for batch in batches:
        mine = batch.filter(pc.equal(batch.column(2), 0))
        if len(mine):
            asked.append(mine)
        stripes = batch.filter(pc.equal(batch.column(2), 1))
        if not asked or not len(stripes):
            continue
        if weights is None:
            told = pa.Table.from_batches(asked).combine_chunks()
            qid, words, values = told.column("qid").combine_chunks(), told.column("words").combine_chunks(), told.column("values").combine_chunks()
            ends = np.cumsum(pc.list_value_length(values).to_numpy()) - 1  # the edge is the last of a question's values
            flat = values.flatten().to_numpy()
            edge = flat[ends]
            weights, _, words_of = _matrix(words, np.delete(flat, ends))
            read, every = np.zeros(len(qid)), np.zeros(len(qid))
        for a in range(0, len(stripes), 256):
            some = stripes.slice(a, 256)
            row, col, at = words_of(some.column(5))
            values = some.column(6)
            size = pc.list_value_length(values).to_numpy()  # a stripe's lifts, then as many numbers of rows
            half = size // 2
            begin = np.cumsum(size) - size
            at = at - (np.cumsum(half) - half)[row]
            flat = values.flatten().to_numpy()
            lift, n = flat[begin[row] + at], flat[begin[row] + half[row] + at]
            bound, rows = np.zeros((len(some), len(edge))), np.zeros((len(some), len(edge)))
            for r in np.unique(row):
                here = slice(*np.searchsorted(row, [r, r + 1]))
                bound[r], rows[r] = lift[here] @ weights[col[here]], n[here] @ (weights[col[here]] > 0)
            reach = (bound >= edge) & (rows > 0)
            read, every = read + (rows * reach).sum(axis=0), every + rows.sum(axis=0)
            of = some.column(4).filter(pa.array(reach.any(axis=1)))
            none = pa.nulls(len(of), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(of), qid.type), of, none, none], names=names)
    if weights is not None:
        met = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([qid.take(pa.array(met)), pa.nulls(len(met), pa.string()), pa.array(read[met].astype(np.int64)), pa.array(every[met].astype(np.int64))], names=names)
