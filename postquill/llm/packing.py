"""Packing tokenised documents into fixed-length training sequences.

First-fit decreasing with a tournament tree of bin capacities, run independently
in randomised groups of documents. Texts never cross the network: each scan task
tokenises its own documents, cuts them into pieces of at most ``seq_len`` ids and
sends on a few numbers for each piece.

Defined results: a null text is empty and a document always ends with
``end_id``, so an empty one is a single piece of one id; repeated rows are packed
as often as they occur; ties in length go by document id, then place in it; an
empty table gives no rows. A document of any length is cut, never shortened.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bytekit import U64, mix64

SEQ_LEN = 2048
END_ID = 1
GROUP_DOCS = 4096
CACHE_WORDS = 300_000

#: Texts made only of these characters are split alike by this module and by the
#: tokenizer's own splitter; any other text goes to the tokenizer as a whole.
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _piece_encoder(path: str, tokenizer):
    """A function from one word piece to its ids. Where the file is a plain byte-level
    BPE whose ids follow its merges, merging by rank gives the same ids faster."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not spec.get("normalizer") and not model.get("ignore_merges")
    if plain and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
        import tiktoken

        letters = _byte_letters()
        ranks = {bytes(map(letters.__getitem__, w)): i for w, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda word: tokenizer.encode(word, add_special_tokens=False).ids


class _Words(dict):
    """Ids of one word piece as little-endian bytes, worked out on first use."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(word)).tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids


class TokenBytes:
    """Texts to ids, as the tokenizer file prescribes, through a cache of word pieces."""

    _known: dict[str, TokenBytes] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(_piece_encoder(path, self.tokenizer))
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]

    @classmethod
    def of(cls, path: str) -> TokenBytes:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __call__(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, _SPLIT.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("grp", pa.int64())])


def _pieces(path: str, seq_len: int, end_id: int, groups: int, seed: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenBytes.of(path)
        nameless = TaskContext.get().partitionId() << 40  # rows without an id are told apart by their place
        for batch in batches:
            cols: list[list[int]] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokens(text.as_py() or "") + end
                n = len(ids) // 4
                key = zlib.crc32(ids) << 32 | ((doc_id or 0) & 0xFFFFFFFF)
                if doc_id is None:
                    nameless += 1
                    key = (key + nameless * 0x9E3779B97F4A7C15) % (1 << 64)
                group = int(mix64(np.array([key ^ seed], U64))[0] % U64(groups))
                for at in range(0, n, seq_len):
                    part = ids[4 * at : 4 * (at + seq_len)]
                    for col, value in zip(cols, (doc_id, at, len(part) // 4, zlib.crc32(part), n, group)):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=PIECES)

    return run


class CapacityTree:
    """A tournament over bins: each inner node holds the larger free capacity below
    it, so the first bin with room is found in one walk from the root."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room; returns the bin and its room before."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        room, bin_ = free[at], at - self.leaves
        free[at] = room - size
        at //= 2
        while at:
            most = free[2 * at] if free[2 * at] >= free[2 * at + 1] else free[2 * at + 1]
            if free[at] == most:
                break
            free[at] = most
            at //= 2
        return bin_, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken in the order given (already decreasing)."""
    tree = CapacityTree(len(lengths), capacity)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        bins[i], room = tree.place(size)
        offsets[i] = capacity - room
    return bins, offsets


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(seq_len: int):
    def run(group: pa.Table) -> pa.Table:
        cols = [group.column(n).combine_chunks() for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp")]
        ids = cols[0].fill_null(-1).to_numpy(zero_copy_only=False)
        start, length, crc = (c.to_numpy(zero_copy_only=False) for c in cols[1:4])
        order = np.lexsort((crc, start, ids, -length))
        bins, offsets = first_fit_decreasing(length[order], seq_len)
        taken = pa.array(order)
        first = int(cols[5][0].as_py()) << 32
        out = [c.take(taken) for c in cols[:5]] + [pa.array(bins + first), pa.array(offsets)]
        return pa.Table.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = 9) -> DataFrame:
    """One row per piece: its place in its document and in its sequence.

    ``group_docs`` is the mean size of a group; groups are drawn by a seeded hash
    of the document, so they stay even however the rows were dealt out before.
    """
    groups = max(1, docs.count() // group_docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = rows.mapInArrow(_pieces(tokenizer, seq_len, end_id, groups, seed), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long")
    return pieces.groupBy("grp").applyInArrow(_pack(seq_len), PACKED)


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
