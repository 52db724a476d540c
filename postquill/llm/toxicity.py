"""Toxicity scores from a bidirectional gated recurrent network, trained in numpy.

A word's input joins a vector of its own with the mean of vectors of its byte
n-grams (those at its start apart), so an unseen word with a known stem still
counts. Two gated recurrent passes read windows of ``WINDOW`` words, every window
overlapping the next by half; attention pools the states of a window, and a
document's score comes from its most toxic window and its three most toxic ones,
calibrated for equal shares of both classes on documents kept out of the training.
All windows of the whole text are scored.

Labels are learned only from a bounded sample (``SAMPLE`` documents of each class, of at
most ``SAMPLE_BYTES`` bytes, drawn by a hash of the id) of the rows that are not
held out; texts are the only input.

Defined results: a null text is empty; a text without words scores 0; repeated
rows score alike; without both labels in the training rows every text scores the
share of label 1 (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .bytekit import U64, HashIndex, buffers, fold_case, prefix_hash, slices, span_hash, tidy, words

WINDOW, STRIDE = 32, 16
LONGEST = 32
GRAMS = (3, 4, 5)
PREFIXES = (3, 4, 5, 6)
EMBED, HIDDEN = 8, 8
#: A text's evidence. A word stands in two windows, so a third tells whether there is more than one.
TOP, NOTHING = 3, -6.0
#: A word's input: its own vector, the mean vector of its n-grams, the strongest n-gram.
WIDTH = 2 * EMBED + 1
PART_BYTES = 1 << 19
#: n-grams looked up and added at a time; bounds memory, not results.
PART_GRAMS = 1 << 17
SAMPLE, SAMPLE_BYTES = {1: 1000, 0: 1600}, 8_000
MIN_COUNT = 3
THRESHOLD = 0.7
STEPS, BATCH, RATE = 240, 128, 0.02
_START = U64(0xA24BAED4963EE407)


@dataclass
class Words:
    """The distinct words of a batch, their n-grams, and where words stand."""

    hashes: np.ndarray  # of distinct words
    which: np.ndarray  # distinct word of each word
    text: np.ndarray  # text of each word
    grams: np.ndarray  # hashes of n-grams, word after word
    owner: np.ndarray  # distinct word of each n-gram


def read_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are found a part of the texts at a time; n-grams are read from the distinct
    words, set side by side, so memory follows the words and not the bytes."""
    folded = fold_case(buf)
    parts = [(np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3)]
    for a, b in slices(offsets, PART_BYTES):
        part = folded[offsets[a] : offsets[b]]
        start, end, text = words(part, offsets[a : b + 1] - offsets[a], LONGEST)
        parts.append((span_hash(prefix_hash(part), start, end), start + offsets[a], end - start, (text + a).astype(np.int64)))
    every, start, size, text = map(np.concatenate, zip(*parts))
    del parts
    hashes, first, which = np.unique(every, return_index=True, return_inverse=True)
    start, length = start[first], size[first]
    del every, size
    e = np.cumsum(length)
    s = e - length
    prefix = prefix_hash(folded[np.repeat(start - s, length) + np.arange(e[-1] if len(e) else 0)])
    grams, owner = [], []
    for n in GRAMS:
        many = np.maximum(length - n + 1, 0)
        own = np.repeat(np.arange(len(s), dtype=np.int32), many)
        at = s[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        grams.append(span_hash(prefix, at, at + n))
        owner.append(own)
    for n in PREFIXES:
        own = np.flatnonzero(length >= n).astype(np.int32)
        grams.append(span_hash(prefix, s[own], s[own] + n) ^ _START)
        owner.append(own)
    return Words(hashes, which.ravel().astype(np.int32), text.astype(np.int32), np.concatenate(grams), np.concatenate(owner))


def windows(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of every window; ``text`` is the ascending text of each word."""
    found, first, count = np.unique(text, return_index=True, return_counts=True)
    many = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(found)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return first[owner] + nth * STRIDE, found[owner]


def window_words(start: np.ndarray, owner: np.ndarray, text: np.ndarray, which: np.ndarray, none: int) -> np.ndarray:
    """Distinct words of each window, ``none`` beyond its text's end."""
    at = start[:, None] + np.arange(WINDOW)
    inside = at < len(text)
    at = np.where(inside, at, 0)
    inside &= text[at] == owner[:, None]
    return np.where(inside, which[at], none)


def evidence(logits: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of ``owner`` (ascending) and their evidence: the strongest window's logit, averaged with the
    mean of the ``TOP`` strongest, where a window that a short text lacks counts ``NOTHING``."""
    order = np.lexsort((-logits, owner))
    found, first, count = np.unique(owner, return_index=True, return_counts=True)
    nth = np.arange(len(owner)) - np.repeat(first, count)
    total = np.bincount(np.repeat(np.arange(len(found)), count), np.where(nth < TOP, np.maximum(logits[order], NOTHING), 0), minlength=len(found))
    return found, (logits[order][first] + (total + np.maximum(TOP - count, 0) * NOTHING) / TOP) / 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, forward and backward passes."""

    def __init__(self, word_index: HashIndex, gram_index: HashIndex, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.word_index, self.gram_index = word_index, gram_index
        self.gram_odds = np.r_[gram_odds, 0].astype(np.float32)
        f = np.float32

        def table_of(odds: np.ndarray) -> np.ndarray:
            out = rng.normal(0, 0.05, (len(odds) + 1, EMBED)).astype(f)
            out[:-1, 0] = odds
            out[-1] = 0
            return out

        self.words, self.grams = table_of(word_odds), table_of(gram_odds)
        d = WIDTH
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = rng.normal(0, 0.3, (d, 3 * HIDDEN)).astype(f)
            self.p[f"h{way}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(f)
            self.p[f"c{way}"] = np.zeros(3 * HIDDEN, f)
        self.p["att"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(f)
        self.p["out"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(f)
        self.p["bias"] = np.zeros(1, f)
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, hashes: np.ndarray, grams: np.ndarray, owner: np.ndarray):
        """Input vectors of distinct words (and a row of zeros), with what their gradient needs."""
        w = self.word_index.find(hashes)
        found = [(np.zeros(0, np.int32), owner[:0])]
        for at in range(0, len(grams), PART_GRAMS):
            rows = self.gram_index.find(grams[at : at + PART_GRAMS])
            found.append((rows[rows >= 0], owner[at : at + PART_GRAMS][rows >= 0]))
        g, own = map(np.concatenate, zip(*found))
        del found
        n = np.maximum(np.bincount(own, minlength=len(hashes)), 1).astype(np.float32)
        x = np.zeros((len(hashes) + 1, WIDTH), np.float32)
        x[:-1, :EMBED] = self.words[w]
        order = np.argsort(own, kind="stable")
        own_sorted = own[order]
        if len(own):
            edges = np.r_[np.flatnonzero(np.r_[True, own_sorted[1:] != own_sorted[:-1]]), len(own)]
            for a, b in slices(edges, PART_GRAMS):  # whole words at a time
                rows, first = g[order[edges[a] : edges[b]]], edges[a:b] - edges[a]
                x[own_sorted[edges[a:b]], EMBED : 2 * EMBED] = np.add.reduceat(self.grams[rows], first, axis=0)
                x[own_sorted[edges[a:b]], 2 * EMBED] = np.maximum.reduceat(self.gram_odds[rows], first)
        x[:-1, EMBED : 2 * EMBED] /= n[:, None]
        return x, (w, g, own, n)

    def forward(self, x: np.ndarray, idx: np.ndarray, keep: bool = False):
        """Logit of each window; ``idx`` rows of ``x``, the last of them outside the text."""
        p, (n, length), none = self.p, idx.shape, len(x) - 1
        on = idx != none
        states = np.empty((length, n, 2 * HIDDEN), np.float32)
        memo = {}
        h3 = HIDDEN
        for way, steps, to in (("f", range(length), 0), ("b", range(length - 1, -1, -1), HIDDEN)):
            gx = x @ p[f"x{way}"] + p[f"c{way}"]
            h = np.zeros((n, h3), np.float32)
            for t in steps:
                a = gx[idx[:, t]]
                b = h @ p[f"h{way}"]
                zr = _sigmoid(a[:, : 2 * h3] + b[:, : 2 * h3])
                z, r = zr[:, :h3], zr[:, h3:]
                c = np.tanh(a[:, 2 * h3 :] + r * b[:, 2 * h3 :])
                new = c + z * (h - c)
                m = on[:, t, None]
                new = np.where(m, new, h)
                if keep:
                    memo[way, t] = (h, z, r, c, b[:, 2 * h3 :], m)
                h = new
                states[t, :, to : to + h3] = h
        e = (states @ p["att"]).T
        e = np.where(on, e, -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * on
        att = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,tnh->nh", att, states)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (states, att, pooled, memo)) if keep else logit

    def backward(self, x: np.ndarray, idx: np.ndarray, d_logit: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        p, h3 = self.p, HIDDEN
        states, att, pooled, memo = kept
        n, length = idx.shape
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"] = pooled.T @ d_logit
        g["bias"][0] = d_logit.sum()
        d_pooled = d_logit[:, None] * p["out"]
        d_att = np.einsum("nh,tnh->nt", d_pooled, states)
        d_e = att * (d_att - (att * d_att).sum(axis=1, keepdims=True))
        g["att"] = np.einsum("nt,tnh->h", d_e, states)
        d_states = att.T[:, :, None] * d_pooled[None] + d_e.T[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        flat_idx = idx.T.ravel()
        for way, steps, to in (("f", range(length - 1, -1, -1), 0), ("b", range(length), HIDDEN)):
            dh = np.zeros((n, h3), np.float32)
            d_all = np.zeros((length, n, 3 * h3), np.float32)
            for t in steps:
                h, z, r, c, bn, m = memo[way, t]
                dh = dh + d_states[t, :, to : to + h3]
                d_new = np.where(m, dh, 0)
                dz = d_new * (h - c) * z * (1 - z)
                dc = d_new * (1 - z) * (1 - c * c)
                dr = dc * bn * r * (1 - r)
                d_b = np.concatenate([dz, dr, dc * r], axis=1)
                d_all[t] = np.concatenate([dz, dr, dc], axis=1)
                g[f"h{way}"] += h.T @ d_b
                dh = np.where(m, d_new * z, dh) + d_b @ p[f"h{way}"].T
            flat = d_all.reshape(-1, 3 * h3)
            by_row = np.stack([np.bincount(flat_idx, flat[:, j], minlength=len(x)) for j in range(3 * h3)], axis=1).astype(np.float32)
            g[f"c{way}"] = flat.sum(axis=0)
            g[f"x{way}"] = x.T @ by_row
            dx += by_row @ p[f"x{way}"].T
        dx[-1] = 0
        return g, dx

    def scores(self, buf: np.ndarray, offsets: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """The evidence of each text, -inf without words."""
        out = np.full(len(offsets) - 1, -np.inf)
        if not len(buf):
            return out
        w = read_words(buf, offsets)
        if not len(w.text):
            return out
        x, _ = self.inputs(w.hashes, w.grams, w.owner)
        start, owner = windows(w.text)
        logits = np.empty(len(start), np.float32)
        for at in range(0, len(start), chunk):
            part = slice(at, at + chunk)
            idx = window_words(start[part], owner[part], w.text, w.which, len(w.hashes))
            logits[part] = self.forward(x, idx)
        found, value = evidence(logits, owner)
        out[found] = value
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(logit), _sigmoid(np.clip(self.scale * np.where(np.isfinite(logit), logit, 0) + self.shift, -50, 50)), 0.0)


def _odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log odds of a feature in toxic against clean texts, less a standard error."""
    raw = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    error = np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    return (np.clip(np.sign(raw) * np.maximum(np.abs(raw) - error, 0), -3, 5) / 2).astype(np.float32)


def _texts_with(feature: np.ndarray, text: np.ndarray, labels: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and clean texts that hold each of ``count`` features."""
    pair = np.unique(feature * len(labels) + text)
    feature, lab = pair // len(labels), labels[pair % len(labels)]
    return np.bincount(feature[lab == 1], minlength=count), np.bincount(feature[lab == 0], minlength=count)


def fit(texts: list[str], labels: np.ndarray, seed: int = 5) -> Network:
    """Trains on four fifths of the texts and calibrates on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    texts, labels = [texts[i] for i in order], labels[order]
    aside = np.arange(len(texts)) % 5 == 0
    buf, offsets = buffers(pa.array(texts, pa.large_string()))
    w = read_words(buf, offsets)
    train = ~aside[w.text]

    # log odds of words and n-grams by the texts that hold them
    n_pos, n_neg = int((labels[~aside] == 1).sum()), int((labels[~aside] == 0).sum())
    pair = np.unique(w.text[train].astype(np.int64) * len(w.hashes) + w.which[train])
    pair_text, pair_word = pair // len(w.hashes), pair % len(w.hashes)
    pos, neg = _texts_with(pair_word, pair_text, labels, len(w.hashes))
    keep = pos + neg >= MIN_COUNT
    by_owner = np.argsort(w.owner, kind="stable").astype(np.int32)
    w.grams, w.owner = w.grams[by_owner], w.owner[by_owner]
    grams_sorted = w.grams
    edges = np.searchsorted(w.owner, np.arange(len(w.hashes) + 1))
    del by_owner, pair
    gram = np.unique(grams_sorted)
    of_word = np.concatenate([np.searchsorted(gram, part).astype(np.int32) for part in np.array_split(grams_sorted, 1 + len(grams_sorted) // PART_GRAMS)])
    gpos, gneg = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    by_word = np.argsort(pair_word, kind="stable")
    for part in np.array_split(by_word, max(1, len(by_word) // 20_000)):  # bounded memory; a word's texts may be in two parts
        many = edges[pair_word[part] + 1] - edges[pair_word[part]]
        at = np.repeat(edges[pair_word[part]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        seen = np.unique(of_word[at].astype(np.int64) * len(labels) + np.repeat(pair_text[part], many))
        lab = labels[seen % len(labels)]
        gpos += np.bincount(seen[lab == 1] // len(labels), minlength=len(gram))
        gneg += np.bincount(seen[lab == 0] // len(labels), minlength=len(gram))
    gkeep = gpos + gneg >= MIN_COUNT + 1
    net = Network(HashIndex(w.hashes[keep]), HashIndex(gram[gkeep]), _odds(pos[keep], neg[keep], n_pos, n_neg), _odds(gpos[gkeep], gneg[gkeep], n_pos, n_neg), seed)
    del of_word, gram, gpos, gneg, by_word, pair_text, pair_word, train

    # windows to learn from: the strongest of a toxic text, any of a clean one
    start, owner = windows(w.text)
    idx = window_words(start, owner, w.text, w.which, len(w.hashes))
    x, memo = net.inputs(w.hashes, w.grams, w.owner)
    hint = x[:, 0] + x[:, 2 * EMBED]
    strength = np.maximum.reduceat(hint[idx].max(axis=1), np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
    firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    value = hint[idx].max(axis=1)
    is_top = value >= np.repeat(strength, np.diff(np.r_[firsts, len(owner)]))
    usable = ~aside[owner]
    tox = labels[owner] == 1
    top = np.flatnonzero(usable & tox & is_top)
    clean = np.flatnonzero(usable & ~tox)
    bounds = edges

    state: dict[str, np.ndarray] = {}

    def step(name: str, value: np.ndarray, grad: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        acc = state.setdefault(name, np.full(value.shape if rows is None else (len(value), 1), 1e-3, np.float32))
        if rows is None:
            acc += grad * grad
            value -= rate * grad / np.sqrt(acc)
        else:
            acc[rows, 0] += (grad * grad).mean(axis=1)
            value[rows] -= rate * grad / np.sqrt(acc[rows])

    hard = np.zeros(0, np.int64)
    epochs = int(np.clip(STEPS * BATCH // max(1, 4 * len(top)), 6, 30))
    for epoch in range(epochs):
        picks = np.concatenate([top, rng.choice(clean, min(len(clean), 2 * len(top)), replace=False), hard])
        rng.shuffle(picks)
        for at in range(0, len(picks), BATCH):
            rows = picks[at : at + BATCH]
            used, local = np.unique(idx[rows], return_inverse=True)
            real = used[used < len(w.hashes)]
            local = local.reshape(len(rows), WINDOW)
            spans = [np.arange(bounds[i], bounds[i + 1]) for i in real]
            own = np.repeat(np.arange(len(real)), [len(s) for s in spans])
            xs, (wi, gi, gown, gn) = net.inputs(w.hashes[real], grams_sorted[np.concatenate(spans)] if len(spans) else np.zeros(0, U64), own)
            local = np.minimum(local, len(real))
            logit, kept = net.forward(xs, local, keep=True)
            y = (labels[owner[rows]] == 1).astype(np.float32)
            d_logit = ((_sigmoid(logit) - y) / len(rows)).astype(np.float32)
            grads, dx = net.backward(xs, local, d_logit, kept)
            for k, v in net.p.items():
                step(k, v, grads[k], RATE * 3)
            known = wi >= 0
            step("words", net.words, dx[:-1][known][:, :EMBED], RATE, wi[known])
            share = dx[gown][:, EMBED : 2 * EMBED] / gn[gown][:, None]
            touched, inv = np.unique(gi, return_inverse=True)
            by = np.stack([np.bincount(inv.ravel(), share[:, j], minlength=len(touched)) for j in range(EMBED)], axis=1).astype(np.float32)
            step("grams", net.grams, by, RATE, touched)
            net.words[-1] = net.grams[-1] = 0
        if epoch % max(1, epochs // 8) == 0 and epoch:  # clean windows that look toxic join for good; toxic windows are chosen anew
            x, _ = net.inputs(w.hashes, w.grams, w.owner)
            logits = np.concatenate([net.forward(x, idx[i : i + 4096]) for i in range(0, len(idx), 4096)])
            worst = clean[np.argsort(-logits[clean], kind="stable")[: max(8, len(top) // 4)]]
            hard = np.union1d(hard, worst[logits[worst] > -4])
            best = np.maximum.reduceat(logits, firsts)
            top = np.flatnonzero(usable & tox & (logits >= np.repeat(best, np.diff(np.r_[firsts, len(owner)]))))

    # calibration on the texts kept aside
    x, _ = net.inputs(w.hashes, w.grams, w.owner)
    logits = np.concatenate([net.forward(x, idx[i : i + 4096]) for i in range(0, len(idx), 4096)])
    found, best = evidence(logits, owner)
    held = aside[found]
    best, lab = best[held], (labels[found][held] == 1).astype(np.float64)
    if 0 < lab.sum() < len(lab):
        centre, spread = best.mean(), max(best.std(), 1e-6)
        z, a, b = (best - centre) / spread, 1.0, 0.0
        weight = np.where(lab == 1, 0.5 / lab.mean(), 0.5 / (1 - lab.mean()))  # the sample's shares say nothing of the table's
        for _ in range(300):
            q = weight * (_sigmoid(np.clip(a * z + b, -40, 40)) - lab)
            a, b = a - 0.5 * ((q * z).mean() + 1e-3 * a), b - 0.5 * q.mean()
        net.scale, net.shift = a / spread, b - a * centre / spread
    return net


def training_rows(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, longest: int = SAMPLE_BYTES) -> DataFrame:
    """text and toxic of the bounded sample of labelled rows that are not held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    ids = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[label])
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.select(F.col("doc_id").alias("__id"), "toxic")  # at most the sample's rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text").between(1, longest))
    return texts.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic").limit(2 * sum(sample.values()))


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All training rows of the one task into a pickled model."""
    rows = pa.Table.from_batches(list(batches), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32())]))
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = rows.column("toxic").to_numpy().astype(np.int64)
    if len(y) < 10 or y.min() == y.max():
        model: Network | float = float(y.mean()) if len(y) else 0.0
    else:
        model = fit(rows.column("text").to_pylist(), y)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A trained network, or the share of label 1 where there is nothing to tell apart.

    One task trains on the bounded sample, so a lost executor repeats the training and
    the driver holds nothing but the model.
    """
    rows = training_rows(docs, labels).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))
    found = rows.coalesce(1).mapInArrow(tidy(_fit_rows), "model binary").first()
    return pickle.loads(found["model"]) if found else 0.0


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            buf, offsets = buffers(batch.column(batch.schema.get_field_index("text")))
            score = np.full(len(batch), net if isinstance(net, float) else 0.0)
            if not isinstance(net, float):
                for a, b in slices(offsets):
                    part = buf[offsets[a] : offsets[b]]
                    score[a:b] = net.probability(net.scores(part, offsets[a : b + 1] - offsets[a]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "__score"])

    return run


def score(docs: DataFrame, model, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """``columns`` of ``docs`` (text among them) and ``__score`` of every whole text, in
    place of a column of that name."""
    rows = docs.select(*[c for c in columns if c != "__score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("__score", DoubleType())])
    return rows.mapInArrow(tidy(_score(shared)), schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
