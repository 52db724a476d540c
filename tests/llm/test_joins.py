"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postquill.llm import bytekit, joins

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 4:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 4]) for i in range(len(words) - 3))


def plain(rows):
    """(doc_id, size, component) of all rows, from all pairs."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(doc, least.get(r, doc))
    return sorted(((-1 if d is None else d), len(sets[i]), least.get(find(i), -1)) for i, (d, _) in enumerate(rows))


def found(docs, **how):
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in joins.jaccard_components(docs, **how).collect())


def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    rows = []
    for family in range(14):  # copies of all degrees, some that share a passage only
        base = [word() for _ in range(rng.choice([5, 12, 40, 150]))]
        for _ in range(rng.choice([1, 4, 16])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1, 1])] = [word()]
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(own)))
    passage = [f"p{i}" for i in range(70)]
    for i in range(60):  # frequent shingles, and texts of nothing else
        rows.append((len(rows), " ".join(passage[rng.randrange(3) : 70 - rng.randrange(12)] + [word() for _ in range(rng.choice([0, 0, 2, 60]))])))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "ONE two"), (906, "One Two Three four"), (907, "one two three FOUR"), (908, "É a b c"), (909, "é a b c")]
    rows += [(910, "x y z w " * 300), (911, "x y z w " * 200), rows[3], rows[3], (3, "another text of that id"), (None, rows[40][1]), (None, "no id and alone here now"), (912, " ".join(f"w{i}" for i in range(30_000)))]
    return rows + [(913, " ".join(f"w{i}" for i in range(2_000, 30_000)))]


@pytest.mark.parametrize("how", [{}, {"block": 3, "share": 0.05}])
def test_join(spark, how):
    rows = odd_rows()
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOC).withColumns({"n": F.lit("clash"), "sig": F.lit(1), "same": F.lit(2), "id": F.lit(3)})
    want = plain(rows)
    assert found(docs, **how) == want
    assert len({c for _, _, c in want}) < len(rows) - 30


def test_blocks_alone_find_all(spark):
    """One list that every set is in: pairs across blocks and components are met."""
    rng = np.random.default_rng(0)
    n = 60
    rows = [(0, 40 + int(i % 5), i, int(rng.integers(0, 4)), rng.integers(0, 4, 8).astype(np.uint64).tobytes()) for i in range(n)]
    rows.sort(key=lambda r: (r[1], r[2]))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("group", "n", "id", "part", "side", "sketch"), (g, k, i, p, -1, s))) for g, k, i, p, s in rows[a : a + 7]]) for a in range(0, n, 7)]
    got = {(r["a"], r["b"]) for out in joins._meet(iter(batches)) for r in out.to_pylist()}
    want = set()
    for x in rows:
        for y in rows:
            if x[2] < y[2] and x[3] != y[3] and 100 * min(x[1], y[1]) >= 85 * max(x[1], y[1]):
                differ = sum(bin(a ^ b).count("1") for a, b in zip(x[4], y[4]))
                if 185 * differ <= 15 * (x[1] + y[1]):
                    want.add((x[2], y[2]))
    assert got == want and want


def test_sketches_and_leading_shingles_lose_no_link():
    rng = random.Random(1)
    frequent = np.zeros(0, np.uint64)
    for _ in range(300):
        n = rng.choice([1, 3, 7, 40, 300])
        a = np.array(sorted(rng.sample(range(1 << 60), n)), np.uint64)
        b = np.unique(np.r_[a[rng.randrange(max(1, n // 6)) :], np.array(rng.sample(range(1 << 60), rng.randrange(max(1, n // 9))), np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        frequent = np.sort(bytekit.mix64(a[:2])) if rng.random() < 0.5 else np.sort(a[: n // 3])
        owner = lambda x: np.zeros(len(x), np.int64)
        assert set(joins.leading(owner(a), a, frequent)[1].tolist()) & set(joins.leading(owner(b), b, frequent)[1].tolist())
        assert joins.alike(joins.sketches(owner(a), a, 1), joins.sketches(owner(b), b, 1), np.array([len(a)]), np.array([len(b)]))[0]


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], DOC)) == []
    assert found(spark.createDataFrame([(4, None, None, None, None), (None, "", None, None, None)], DOC)) == [(-1, 0, -1), (4, 0, 4)]


def counted(monkeypatch):
    """The numbers of pairs whose overlaps are counted, a number for each round."""
    many = []
    linked = joins.linked

    def count(pairs, segments):
        many.append(pairs.count())
        return linked(pairs, segments)

    monkeypatch.setattr(joins, "linked", count)
    return many


def test_near_copies_of_one_text_are_few_pairs(spark, monkeypatch):
    """A group of near copies: not every set outside the largest component with each inside."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([1, 1, 1, 2, 2])):  # 24 shingles differ of one edit and two: just no link, unless edits are near
            own[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    many = counted(monkeypatch)
    assert found(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOC), share=1.0) == plain(rows)
    assert sum(many[1:]) < len(rows) // 4


def test_long_texts_that_share_a_passage_are_no_pairs(spark, monkeypatch):
    """512 bits are filled by 3,000 shingles; sketches that grow with the set tell such texts apart."""
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(i, passage + " " + " ".join(f"d{i}w{j}" for j in range(2_800))) for i in range(12)]
    rows += [(20, rows[0][1] + " and a few words more"), (21, rows[1][1].replace("d1w5 ", "d1w6 "))]
    many = counted(monkeypatch)
    assert found(spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOC), share=1.0) == plain(rows)
    assert sum(many) <= 4


def test_growing_sketches_lose_no_link():
    rng = np.random.default_rng(4)
    for n in (513, 1024, 1025, 5_000, 50_000):
        a = rng.integers(0, 1 << 60, n).astype(np.uint64)
        b = np.r_[a[: n - n // 15], rng.integers(0, 1 << 60, rng.integers(0, n // 15)).astype(np.uint64)]
        differ = len(np.setxor1d(a, b))
        got = joins.wide_differ(joins.wide_sketch(a), joins.wide_sketch(b))
        assert got <= differ and got == joins.wide_differ(joins.wide_sketch(b), joins.wide_sketch(a))
        assert joins.wide_differ(joins.wide_sketch(a), joins.wide_sketch(rng.integers(0, 1 << 60, n).astype(np.uint64))) * 185 > 15 * 2 * n or n > 2 * joins.WIDE // 3
