"""Removing repeated strings by a difference-cover algorithm of bounded depth.

A text is a sequence of symbols of one or more units: bytes, or words (runs of
anything but white space). A symbol goes if it is covered by a string of the unit's
``length`` that also starts elsewhere. Only the first ``length`` symbols of a suffix
matter, so comparison stops at that depth, and any order of names serves:

1. Sample suffixes and sort their tuples. In each document the positions whose
   remainder modulo ``v`` lies in a difference cover are sampled. For any two positions
   some shift below ``v`` takes both to sampled ones, so if two strings of ``length``
   are equal, two sampled suffixes inside them agree on ``length - v + 1`` symbols.
   That tuple's fingerprint is the suffix's name; names are sorted in ranges over all
   machines.
2. Drop what is settled. A name that occurs once is unlike all others; the suffixes up
   to ``v`` symbols before a repeated name are the only ones left. As names reach the
   depth that a match guarantees, sorting triples of names again cannot drop more.
3. Merge the remaining suffixes, sampled and not. Neighbouring ones that share the
   same smallest gram in their first ``length`` symbols form a run; equal runs take one
   place together, and one copy of each distinct run stands for it. Where several
   distinct runs share an anchor, every suffix of theirs is named at full depth and
   sorted in among the others.
4. Compare neighbours in the sorted ranges: equal prefixes are repeats.

This stands in for the textbook form (triples sorted by rank, recursion, merge by
rank), whose rows hold every symbol several times over. Names are 64-bit fingerprints
in step 1, where a collision only costs work, and in steps 3 and 4 pairs of 64-bit
fingerprints with independent bases, which stand for the bytes themselves.

What moves between machines is, per slice of about 1 MB of text, a block of names for
every range and two bits for every name back. Names that a slice holds more than once
are sent once, so a passage shared by any number of documents costs one name per
slice; a range that holds a passage of every slice grows with the number of slices.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing
unless covered from within; repeated rows repeat each other's symbols; extra columns
are kept as they are, but for those named like a result; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import discard, materialise, release, table
from .bytekit import U64, buffers, inked, prefix_hash, prefix_sums, slices, span_hash, tidy

LENGTH = 400
#: Passages of over 50 words.
WORDS = 51
#: Bytes of text handled together; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
RANGE_NAMES = 1 << 20
LEAST_RANGES = 64
_RANGE_BITS = 26


@cache
def difference_cover(most: int) -> tuple[int, np.ndarray]:
    """Modulus ``v <= most`` and residues that have every difference modulo ``v``.

    For a prime q the zeros of a third-order recurrence over GF(q) with full period
    form a perfect difference set of q + 1 residues modulo q * q + q + 1.
    """
    q = max((p for p in range(2, 200) if p * p + p + 1 <= most and all(p % d for d in range(2, p))), default=0)
    if not q:
        return 1, np.zeros(1, np.int64)
    v = q * q + q + 1
    for code in range(q**3):
        a, b, c = code % q, code // q % q, code // q // q + 1
        s = [0, 0, 1]
        while len(s) < v:
            s.append((a * s[-1] + b * s[-2] + c * s[-3]) % q)
        zeros = np.flatnonzero(np.array(s) == 0)
        if len(zeros) == q + 1 and len({int(x - y) % v for x in zeros for y in zeros}) == v:
            return v, zeros
    raise AssertionError("every prime order has such a recurrence")


def sampled(offsets: np.ndarray, v: int, cover: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions with ``depth`` bytes after them in their text, and their texts."""
    room = np.diff(offsets) - depth + 1
    most = max(0, int(room.max(initial=0)))
    places = (np.arange(0, most // v + 1)[:, None] * v + cover).ravel()
    many = np.searchsorted(places, np.maximum(room, 0), side="left")
    owner = np.repeat(np.arange(len(room)), many)
    return offsets[owner] + places[np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)], owner


def by_range(names: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The ranges of sorted ``names`` that are not empty, by their highest bits."""
    high = (names >> U64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(high) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.r_[edges[1:], len(high)]):
        yield int(high[a]), slice(int(a), int(b))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unipc(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as source:
        return source.read_next_batch()


def _packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


SLICE = "slice long, bytes long, cols binary, sizes binary, blob binary"


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents into slices; the text is the last column."""
    base, nth = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        buf, offsets = buffers(batch.column(batch.num_columns - 1))
        cols = batch.select(batch.schema.names[:-1])
        for a, b in slices(offsets, SLICE_BYTES):
            blob = buf[offsets[a] : offsets[b]].tobytes()
            sizes = np.diff(offsets[a : b + 1]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([base + nth]), pa.array([len(blob)]), pa.array([_ipc(cols.slice(a, b - a))], pa.binary()), pa.array([sizes], pa.binary()), pa.array([_packed(blob)], pa.binary())], names=["slice", "bytes", "cols", "sizes", "blob"])
            nth += 1


@dataclass(frozen=True)
class Unit:
    """What counts as a symbol, and how many of them make a repeat."""

    name: str
    length: int

    @cached_property
    def cover(self) -> tuple[int, np.ndarray]:
        return difference_cover(int(0.7 * self.length))

    @property
    def depth(self) -> int:
        return self.length - self.cover[0] + 1

    @property
    def gram(self) -> int:
        return min(32 if self.name == "byte" else 8, self.length)


class Symbols:
    """The symbols of a slice's documents in one unit."""

    def __init__(self, text: Text, unit: Unit) -> None:
        self.text, self.unit = text, unit
        if unit.name == "byte":
            self.offsets, self.n = text.offsets, len(text.buf)
        else:
            self.start, self.end, owner = inked(text.buf, text.offsets)
            self.offsets, self.n = np.searchsorted(owner, np.arange(len(text.offsets))), len(owner)

    def prefix(self, which: int = 0) -> np.ndarray:
        of_bytes = prefix_hash(self.text.buf, which)
        return of_bytes if self.unit.name == "byte" else prefix_sums(span_hash(of_bytes, self.start, self.end, which), which)

    def sampled_names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, documents and names of the sampled suffixes."""
        v, cover = self.unit.cover
        at, owner = sampled(self.offsets, v, cover, self.unit.depth)
        return at, owner, span_hash(self.prefix(), at, at + self.unit.depth)

    def bytes_of(self, gone: np.ndarray) -> np.ndarray:
        """The bytes of the given symbols, with the white space between two that go."""
        if self.unit.name == "byte":
            return gone
        next_gone = np.r_[gone[1:], False] if len(gone) else gone
        next_gone[self.offsets[1:][self.offsets[1:] > 0] - 1] = False  # the last word of a document
        to = np.where(next_gone, np.r_[self.start[1:], 0], self.end) if len(gone) else self.end
        return _spread(self.start[gone], to[gone], len(self.text.buf))


class Text:
    """A slice of documents, opened."""

    def __init__(self, sizes: bytes, blob: bytes) -> None:
        self.buf = np.frombuffer(_unpacked(blob), np.uint8)
        self.offsets = np.r_[0, np.cumsum(np.frombuffer(sizes, "<i8"))]


NAMED = "range int, slice long, names binary"


def _columns(values: np.ndarray) -> bytes:
    """Numbers with their bytes regrouped by place: sorted ones compress well so."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(data: memoryview, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).reshape(-1).view(kind)


def _named_rows(slice_: int, unit: int, names: np.ndarray, checks: np.ndarray | None, bits: int) -> pa.RecordBatch:
    ranges, blobs = [], []
    for r, part in by_range(names, bits):
        ranges.append(unit << _RANGE_BITS | r)
        blobs.append(_columns(names[part]) + (b"" if checks is None else _columns(checks[part])))
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array([slice_] * len(ranges), pa.int64()), pa.array(blobs, pa.binary())], names=["range", "slice", "names"])


def _name_samples(units: list[Unit], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, sizes, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = Text(sizes, blob)
                for u, unit in enumerate(units):
                    yield _named_rows(slice_, u, np.unique(Symbols(text, unit).sampled_names()[2]), None, bits)

    return run


FOUND = "slice long, range int, hits binary"


def _adjacent(check: str):
    """Sorts a range and marks the names that occur in several slices: two bits for each
    name of a slice, whether it occurs elsewhere and whether in an earlier slice.
    ``check`` is the type of the second half of a name, empty without one."""
    width = 8 + (np.dtype(check).itemsize if check else 0)

    def run(group: pa.Table) -> pa.Table:
        slice_ids = group.column("slice").to_numpy()
        order = np.argsort(slice_ids, kind="stable")
        rows = [group.column("names")[int(i)].as_py() for i in order]
        sizes = [len(row) // width for row in rows]
        name = np.concatenate([_values(memoryview(row), "<u8", n) for row, n in zip(rows, sizes)])
        place = np.argsort(name, kind="stable")
        same = name[place[1:]] == name[place[:-1]]
        if check:
            second = np.concatenate([_values(memoryview(row)[8 * n :], check, n) for row, n in zip(rows, sizes)])
            same &= second[place[1:]] == second[place[:-1]]
        later, hit = np.zeros(len(name), bool), np.zeros(len(name), bool)
        later[place[1:][same]] = True
        hit[place[:-1][same]] = True
        hit |= later
        out: dict[str, list] = {"slice": [], "hits": []}
        edges = np.r_[0, np.cumsum(sizes)]
        for i, row in enumerate(order):
            part = slice(edges[i], edges[i + 1])
            if hit[part].any():
                out["slice"].append(int(slice_ids[row]))
                out["hits"].append(np.packbits(hit[part]).tobytes() + np.packbits(later[part]).tobytes())
        range_ = group.column("range")[0].as_py()
        return pa.table({"slice": pa.array(out["slice"], pa.int64()), "range": pa.array([range_] * len(out["slice"]), pa.int32()), "hits": pa.array(out["hits"], pa.binary())})

    return run


def _hits(unit: int, names: np.ndarray, found: list[dict] | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """What came back for a slice's sorted distinct names: elsewhere, and earlier."""
    marks = {f["range"]: f["hits"] for f in found or ()}
    out = np.zeros(len(names), bool), np.zeros(len(names), bool)
    for r, part in by_range(names, bits):
        r |= unit << _RANGE_BITS
        if r in marks:
            n = part.stop - part.start
            raw = np.frombuffer(marks[r], np.uint8)
            for o, half in zip(out, np.split(raw, 2)):
                o[part] = np.unpackbits(half, count=n).astype(bool)
    return out


def _spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in some [start, end)."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


OPEN = "slice long, windows long, cols binary, sizes binary, blob binary, runs array<binary>, done binary"


def _remaining(units: list[Unit], bits: int, finish):
    """Keeps the suffixes that step 2 leaves; documents without any are finished."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, cols, sizes, blob, found in zip(*(batch.column(i).to_pylist() for i in range(5))):
                text = Text(sizes, blob)
                n = np.diff(text.offsets)
                busy = np.zeros(len(n), bool)
                windows, all_symbols = [], []
                for u, unit in enumerate(units):
                    symbols = Symbols(text, unit)
                    at, owner, names = symbols.sampled_names()
                    names, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
                    repeated = (_hits(u, names, found, bits)[0] | (count > 1))[inverse.ravel()]
                    at, owner = at[repeated], owner[repeated]
                    left = np.maximum(symbols.offsets[owner], at - unit.cover[0] + 1)
                    right = np.minimum(at, symbols.offsets[owner + 1] - unit.length) + 1
                    some = left < right
                    window = _spread(left[some], right[some], symbols.n)
                    counts = np.r_[0, np.cumsum(window)]
                    busy |= counts[symbols.offsets[1:]] > counts[symbols.offsets[:-1]]
                    windows.append(window)
                    all_symbols.append(symbols)
                table_ = _unipc(cols)
                idle = np.flatnonzero(~busy)
                whole = [text.buf[text.offsets[i] : text.offsets[i + 1]] for i in idle]
                done = finish(table_.take(pa.array(idle)), whole, [np.zeros(n[i], bool) for i in idle], [np.zeros(len(idle), np.int64) for _ in units])
                kept = [np.repeat(busy, np.diff(s.offsets)) for s in all_symbols]
                runs = [_packed(np.packbits(w[k]).tobytes()) for w, k in zip(windows, kept)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([slice_]), pa.array([int(sum(w.sum() for w in windows))]), pa.array([_ipc(table_.filter(pa.array(busy)))], pa.binary()),
                    pa.array([n[busy].astype("<i8").tobytes()], pa.binary()), pa.array([_packed(text.buf[np.repeat(busy, n)].tobytes())], pa.binary()),
                    pa.array([runs], pa.list_(pa.binary())), pa.array([_packed(_ipc(done))], pa.binary()),
                ], names=["slice", "windows", "cols", "sizes", "blob", "runs", "done"])

    return run


class Runs:
    """The remaining suffixes of a slice in one unit, in runs of neighbours with the same
    anchor: the place of the smallest gram in their first ``length`` symbols. Equal
    texts have their anchors in the same places, so runs of copies are equal."""

    def __init__(self, number: int, symbols: Symbols, runs: bytes) -> None:
        self.number, self.symbols, self.length = number, symbols, symbols.unit.length
        n, gram = symbols.n, symbols.unit.gram
        self.prefix = symbols.prefix()
        self.at = np.flatnonzero(np.unpackbits(np.frombuffer(_unpacked(runs), np.uint8), count=n))
        width = self.length - gram + 1
        if not len(self.at):
            self.first, self.anchors = np.zeros(0, np.int64), np.zeros(0, U64)
            return
        start = np.arange(n - gram + 1)
        bits = max(20, int(n).bit_length())
        low = U64((1 << bits) - 1)
        packed = (span_hash(self.prefix, start, start + gram) & ~low) | start.astype(U64)
        whole = np.full(-(-len(packed) // width) * width, U64(0xFFFFFFFFFFFFFFFF))
        whole[: len(packed)] = packed
        blocks = whole.reshape(-1, width)  # the minimum over any width from block-wise running minima
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = np.minimum(behind[self.at], ahead[self.at + width - 1]) & low
        self.first = np.flatnonzero(np.r_[True, (self.at[1:] != self.at[:-1] + 1) | (anchor[1:] != anchor[:-1])])
        place = anchor[self.first].astype(np.int64)
        self.anchors = span_hash(self.prefix, place, place + gram)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct run names (two halves), the first run of each, the name of each run, counts."""
        end = np.r_[self.first[1:], len(self.at)]
        lo, hi = self.at[self.first], (self.at[end - 1] + self.length if len(self.first) else self.first)
        self.many = end - self.first
        names, one, which, count = np.unique(span_hash(self.prefix, lo, hi), return_index=True, return_inverse=True, return_counts=True)
        return names, self.checks(lo[one], hi[one]), one, which.ravel(), count

    def checks(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The second halves of names."""
        return span_hash(self.symbols.prefix(1), lo, hi, 1)

    def standing(self, found: list[dict] | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For each run whether it occurs elsewhere too, and whether it stands for all its copies."""
        names, _, one, which, count = self.contexts()
        hit, later = _hits(self.number, names, found, bits)
        chosen = np.zeros(len(self.first), bool)
        chosen[one] = ~later
        return (hit | (count > 1))[which], chosen

    def contested(self, chosen: np.ndarray, found: list[dict] | None, bits: int) -> np.ndarray:
        """The chosen runs whose anchors another chosen run has too."""
        names, which, count = np.unique(self.anchors[chosen], return_inverse=True, return_counts=True)
        out = chosen.copy()
        out[chosen] = (_hits(self.number, names, found, bits)[0] | (count > 1))[which.ravel()]
        return out

    def suffixes(self, runs: np.ndarray) -> np.ndarray:
        """Which of the remaining suffixes are in the given runs."""
        return np.repeat(runs, self.many) if len(self.first) else np.zeros(0, bool)

    def names(self, at: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix, at, at + self.length)


def opened(units: list[Unit], sizes: bytes, blob: bytes, runs: list[bytes]) -> list[Runs]:
    text = Text(sizes, blob)
    return [Runs(u, Symbols(text, unit), part) for u, (unit, part) in enumerate(zip(units, runs))]


def _name_runs(units: list[Unit], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, *text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for r in opened(units, *text):
                    names, checks, *_ = r.contexts()
                    yield _named_rows(slice_, r.number, names, checks, bits)

    return run


def _name_anchors(units: list[Unit], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, *text, of_runs in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for r in opened(units, *text):
                    yield _named_rows(slice_, r.number, np.unique(r.anchors[r.standing(of_runs, bits)[1]]), None, bits)

    return run


def _name_suffixes(units: list[Unit], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_, *text, of_runs, of_anchors in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for r in opened(units, *text):
                    at = r.at[r.suffixes(r.contested(r.standing(of_runs, bits)[1], of_anchors, bits))]
                    names, first = np.unique(r.names(at), return_index=True)
                    yield _named_rows(slice_, r.number, names, r.checks(at[first], at[first] + r.length), bits)

    return run


def gone(r: Runs, bits: int, keep_first: bool, of_runs, of_anchors, of_suffixes) -> np.ndarray:
    """The symbols that go, given what came back for the names of a slice."""
    shared, chosen = r.standing(of_runs, bits)
    open_ = r.suffixes(r.contested(chosen, of_anchors, bits))
    names, first, inverse, count = np.unique(r.names(r.at[open_]), return_index=True, return_inverse=True, return_counts=True)
    hit, later = _hits(r.number, names, of_suffixes, bits)
    inverse = inverse.ravel()
    if keep_first:
        repeated = r.suffixes(~chosen)
        gone_at = np.ones(len(inverse), bool)
        gone_at[first] = later
        repeated[open_] = gone_at
    else:
        repeated = r.suffixes(shared)
        repeated[open_] |= (hit | (count > 1))[inverse]
    at = r.at[repeated]
    return _spread(at, at + r.length, r.symbols.n)


def _remove(units: list[Unit], bits: int, keep_first: bool, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols, sizes, blob, runs, done, *marks in zip(*(batch.column(i).to_pylist() for i in range(1, 9))):
                yield _unipc(_unpacked(done))
                counts, removed = [], None
                for r in opened(units, sizes, blob, runs):
                    mask = gone(r, bits, keep_first, *marks)
                    total = np.r_[0, np.cumsum(mask)]
                    counts.append(total[r.symbols.offsets[1:]] - total[r.symbols.offsets[:-1]])
                    if removed is None:
                        text, removed = r.symbols.text, r.symbols.bytes_of(mask)
                parts = [slice(a, b) for a, b in zip(text.offsets[:-1], text.offsets[1:])]
                yield finish(_unipc(cols), [text.buf[p] for p in parts], [removed[p] for p in parts], counts)

    return run


def _digest(cols: pa.RecordBatch, texts: list[np.ndarray], gone: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    n = pa.array([len(t) for t in texts], pa.int64())
    removed = pa.array([int(g.sum()) for g in gone], pa.int64())
    spans = pa.array([int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0 for g in gone], pa.int64())
    sha = pa.array([hashlib.sha256(t[~g].tobytes()).hexdigest() for t, g in zip(texts, gone)], pa.string())
    words = [pa.array(c.astype(np.int64)) for c in counts[1:]]
    return pa.RecordBatch.from_arrays([*cols.columns, n, removed, spans, sha, *words], names=[*cols.schema.names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["n_passage_words"] * len(words)])


def _text(cols: pa.RecordBatch, texts: list[np.ndarray], gone: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """Kept text and bytes removed; characters cut in half stay whole."""
    out, removed = [], []
    for text, g in zip(texts, gone):
        if g.any():
            start = (text & 0xC0) != 0x80  # first bytes of characters
            char = np.cumsum(start) - 1
            whole = np.bincount(char, ~g) == 0  # removed from first byte to last
            g = whole[char]
        out.append(text[~g].tobytes().decode("utf-8", "replace"))
        removed.append(int(g.sum()))
    return pa.RecordBatch.from_arrays([*cols.columns, pa.array(out, pa.string()), pa.array(removed, pa.int64())], names=[*cols.schema.names, "text", "n_removed"])


def _bits(names: int) -> int:
    return max(LEAST_RANGES, -(-names // RANGE_NAMES) - 1).bit_length()


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, digest: bool = True, unit: str = "byte", passages: int = 0) -> DataFrame:
    """All columns of ``docs`` but text, with what is left of it when the strings of
    ``length`` symbols of the unit ``byte`` or ``word`` that repeat are removed.

    ``digest`` gives n_bytes, n_removed, n_spans and kept_sha256, else text and
    n_removed. ``keep_first`` leaves one occurrence of every repeated string. With
    ``passages`` the digest also has n_passage_words: how many of the document's words
    lie in passages of that many words that occur elsewhere too; white space may differ.
    """
    units = [Unit(unit, length)] + ([Unit("word", passages)] if passages and digest else [])
    others = [c for c in docs.columns if c not in ("text", "n_removed")]
    rows = docs.select(*others, F.col("text").cast("string").alias("text"))
    added = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())] if digest else [StructField("text", StringType()), StructField("n_removed", LongType())]
    added += [StructField("n_passage_words", LongType())] * (len(units) - 1)
    result = StructType([*[f for f in rows.schema.fields if f.name != "text" and f.name not in {x.name for x in added}], *added])
    rows = rows.select(*[f.name for f in result.fields if f.name not in {x.name for x in added}], "text")
    finish = _digest if digest else _text

    def marks(names: DataFrame, check: str, to: str) -> DataFrame:
        found = names.groupBy("range").applyInArrow(_adjacent(check), FOUND)
        return found.groupBy(F.col("slice").alias(f"__{to}")).agg(F.collect_list(F.struct("range", "hits")).alias(to))

    cut = materialise(rows.mapInArrow(_slice, SLICE), "suffix-slices")
    total = cut.agg(F.sum("bytes")).first()[0] or 0
    bits = _bits(total * len(units[0].cover[1]) // units[0].cover[0])
    samples = marks(cut.select("slice", "sizes", "blob").mapInArrow(_name_samples(units, bits), NAMED), "", "samples")
    both = cut.join(samples, F.col("slice") == F.col("__samples"), "left").select("slice", "cols", "sizes", "blob", "samples")
    open_ = materialise(both.mapInArrow(tidy(_remaining(units, bits, finish)), OPEN), "suffix-open")
    discard(cut)
    del samples, both
    release(docs.sparkSession)

    bits = _bits(open_.agg(F.sum("windows")).first()[0] or 0)
    left = open_.where("windows > 0").select("slice", "sizes", "blob", "runs")
    base = ["slice", "sizes", "blob", "runs"]

    def with_marks(rows: DataFrame, found: DataFrame, to: str) -> DataFrame:
        return rows.join(found, F.col("slice") == F.col(f"__{to}"), "left").drop(f"__{to}")

    runs = materialise(marks(left.mapInArrow(_name_runs(units, bits), NAMED), "<u8", "of_runs"), "suffix-runs")
    named = with_marks(left, runs, "of_runs").select(*base, "of_runs")
    anchors = materialise(marks(named.mapInArrow(_name_anchors(units, bits), NAMED), "", "of_anchors"), "suffix-anchors")
    both_marks = lambda rows: with_marks(with_marks(rows, runs, "of_runs"), anchors, "of_anchors")
    named = both_marks(left).select(*base, "of_runs", "of_anchors")
    suffixes = marks(named.mapInArrow(_name_suffixes(units, bits), NAMED), "<u8", "of_suffixes")
    out = with_marks(both_marks(open_), suffixes, "of_suffixes").select("slice", "cols", "sizes", "blob", "runs", "done", "of_runs", "of_anchors", "of_suffixes")
    return out.mapInArrow(tidy(_remove(units, bits, keep_first, finish)), result)


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=WORDS)
