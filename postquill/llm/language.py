"""Language identification by prediction by partial matching.

Every language has a byte context tree of orders 0 to ``ORDER``, kept as counts of
byte n-grams. Statistics are frozen after training; a byte's exact code length is
its share under the longest known context, after an escape (method C) for every
longer context that knows other bytes only. The lengths of all n-grams seen in any
language are worked out once per language, so scoring is a lookup per byte, with
shorter contexts for n-grams that no language has seen. The language that codes
the whole text in the fewest bits is predicted.

Training takes at most ``SAMPLE`` documents a language (drawn by a hash of the id,
of at most ``SAMPLE_BYTES`` bytes) among those that are not held out; a language
whose documents are all longer is learned from their first ``SAMPLE_BYTES`` characters.

Defined results: ``und`` with score 0 for a null text or one without a letter, and
for every text where nothing could be learned; ties go to the first language in
code-point order; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..session import table
from .bytekit import U64, HashIndex, buffers, fold_case, slices

ORDER = 4
SAMPLE, SAMPLE_BYTES = 300, 16_000
UNKNOWN = "und"
#: Evidence counts as if a text had at most so many bytes, so that scores stay below 1 for long.
EVIDENCE_BYTES = 32


def gram_keys(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte, itself and the ``ORDER`` bytes before it in its text (zeros
    before the start), as one number with the byte lowest."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.zeros(len(buf) + ORDER * n, np.uint8)
    at = np.arange(len(buf)) + ORDER * np.repeat(np.arange(1, n + 1), lengths)
    padded[at] = buf
    key = np.zeros(len(buf), U64)
    for back in range(ORDER + 1):
        key |= padded[at - back].astype(U64) << U64(8 * back)
    return key


def _low(keys: np.ndarray, count: int) -> np.ndarray:
    return keys & U64((1 << (8 * count)) - 1)


class ContextTrees:
    """Frozen code lengths in bits of all languages."""

    def __init__(self, languages: list[str], keys: list[np.ndarray]) -> None:
        self.languages = languages
        n = len(languages)
        self.grams: list[tuple[HashIndex, np.ndarray]] = []
        self.escapes: list[tuple[HashIndex, np.ndarray]] = []
        for order in range(ORDER + 1):
            found = [np.unique(_low(k, order + 1), return_counts=True) for k in keys]
            union = np.unique(np.concatenate([g for g, _ in found]))
            count = np.zeros((len(union), n))
            for i, (g, c) in enumerate(found):
                count[np.searchsorted(union, g), i] = c
            context, own = np.unique(union >> U64(8), return_inverse=True)
            own = own.ravel()
            total, distinct = np.zeros((len(context), n)), np.zeros((len(context), n))
            np.add.at(total, own, count)
            np.add.at(distinct, own, count > 0)
            known = total > 0
            escape = np.where(known, -np.log2(np.where(known, distinct, 1) / np.where(known, total + distinct, 1)), 0)
            shorter = self._bits(_low(union, order), order - 1)
            seen = -np.log2(np.where(count > 0, count, 1) / np.where(known, total + distinct, 1)[own])
            bits = np.where(count > 0, seen, escape[own] + shorter)
            self.grams.append((HashIndex(union), bits.astype(np.float32)))
            self.escapes.append((HashIndex(context), escape.astype(np.float32)))

    def _bits(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of n-grams of ``order + 1`` bytes, one column per language."""
        if order < 0:
            return np.full((len(keys), len(self.languages)), 8.0, np.float32)
        index, bits = self.grams[order]
        row = index.find(keys)
        out = bits[row]
        lost = np.flatnonzero(row < 0)
        if len(lost):
            index, escape = self.escapes[order]
            context = index.find(keys[lost] >> U64(8))
            paid = np.where((context >= 0)[:, None], escape[context], 0)
            out[lost] = paid + self._bits(_low(keys[lost], order), order - 1)
        return out

    def lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of every text (row) in every language (column)."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            bits = self._bits(gram_keys(fold_case(buf), offsets), ORDER)
            out[full] = np.add.reduceat(bits, offsets[full], axis=0, dtype=np.float64)
        return out


def train(languages: list[str], texts: list[list[str]]) -> ContextTrees | None:
    """Context trees of ``languages`` (ascending), or None without any."""
    if not languages:
        return None
    keys = []
    for own in texts:
        buf, offsets = buffers(pa.array(own, pa.large_string()))
        keys.append(gram_keys(fold_case(buf), offsets))
    return ContextTrees(languages, keys)


def has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letters = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    count = np.r_[0, np.cumsum(letters)]
    out = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        text = buf[offsets[i] : offsets[i + 1]]
        out[i] = bool((text > 127).any()) and any(map(str.isalpha, text.tobytes().decode("utf-8", "replace")))
    return out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            buf, offsets = buffers(batch.column(batch.schema.get_field_index("text")))
            pred, score = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for a, b in slices(offsets) if trees is not None else ():
                part, off = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                bits = trees.lengths(part, off)
                best = bits.argmin(axis=1)
                weight = np.maximum(1, np.diff(off) / EVIDENCE_BYTES)
                odds = 2.0 ** (-(bits - bits.min(axis=1, keepdims=True)) / weight[:, None])
                share = 1 / odds.sum(axis=1)
                for i in np.flatnonzero(has_letter(part, off)):
                    pred[a + i], score[a + i] = trees.languages[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names, "__lang", "__score"])

    return run


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, longest: int = SAMPLE_BYTES) -> ContextTrees | None:
    """Trains on the bounded sample; only counts per language come from all rows."""
    spark = docs.sparkSession
    size = F.octet_length("text")
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id") & (size >= 1))
    counts = {r["lang"]: (r["n"], r["short"]) for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(size <= longest).alias("short")).collect()}
    if not counts:
        return None
    # a language without short documents is learned from the starts of long ones
    rates = spark.createDataFrame([(lang, min(1.0, 1.3 * sample / (short or n)), not short) for lang, (n, short) in counts.items()], "__lang string, __rate double, __long boolean")
    lot = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000)) / 1_000_000
    taken = usable.join(F.broadcast(rates), F.col("lang") == F.col("__lang")).where((lot < F.col("__rate")) & ((size <= longest) | F.col("__long")))
    rows = taken.select("lang", lot.alias("lot"), "doc_id", F.substring("text", 1, longest).alias("text")).limit(2 * sample * len(counts)).toArrow()
    by_lang: dict[str, list[tuple]] = {}
    for lang, *row in zip(*(rows.column(c).to_pylist() for c in ("lang", "lot", "doc_id", "text"))):
        by_lang.setdefault(lang, []).append(tuple(row))
    languages = sorted(by_lang)
    return train(languages, [[t for *_, t in sorted(by_lang[x])[:sample]] for x in languages])


def identify(docs: DataFrame, trees: ContextTrees | None, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``columns`` of ``docs`` (text among them) with ``__lang`` and ``__score`` of
    every whole text, in place of columns of those names."""
    rows = docs.select(*[c for c in columns if c not in ("__lang", "__score")])
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    schema = StructType([*rows.schema.fields, StructField("__lang", StringType()), StructField("__score", DoubleType())])
    return rows.mapInArrow(_predict(shared), schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
