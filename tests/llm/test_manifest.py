"""The Merkle manifest against plain loops."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from postquill.llm import merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def climbed(nodes, fanout):
    """The root, and of each leaf its (number in the run, the run's others) from below."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // fanout * fanout : k // fanout * fanout + fanout]
            paths[i].append((k % fanout, run[: k % fanout] + run[k % fanout + 1 :]))
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [k // fanout for k in at]
    return nodes[0], paths


def plain(rows, fanout):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append(r)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        own = sorted(by_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = (own, *climbed([leaf(r) for r in own], fanout))
    root, over = climbed([trees[x][1] for x in order], fanout)
    out = []
    for nth, lang in enumerate(order):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths):
            path = path + over[nth]
            forged = dict(r)
            if r["doc_id"] is not None and r["n_chars"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0:
                forged["n_chars"] += 1
            now = leaf(forged)
            for k, others in path:
                now = h(*others[:k], now, *others[k:])
            out.append((r["doc_id"] if r["doc_id"] is not None else -1, leaf(r), subroot, root, h(*(x for _, o in path for x in o)), now, now == root, sum(len(o) for _, o in path)))
    return sorted(out)


def found(docs, **how):
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(docs, F.when(chosen, F.col("n_chars").cast("decimal(20,0)") + 1), **how).collect()
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got)


@pytest.mark.parametrize("climb, fanout", [(12, 2), (1, 2), (2, 3), (3, 2)])
def test_manifest(spark, climb, fanout):
    rng = random.Random(climb)
    rows = [(i, "x" * rng.randrange(9) + "é日", rng.choice(["en", "en", "en", "fr", "", "é", None]), None if i % 5 == 0 else f"s{i}", None if i % 4 == 0 else i) for i in range(45)]
    rows += [rows[3], rows[3], (rows[3][0], "another text of that id", rows[3][2], "s", 1), (None, None, None, None, None), (None, "", "en", "", 0), (7, "y" * 300_000, "de", "s", 2**63 - 1)]
    docs = spark.createDataFrame(rows, DOC).withColumns({"tree": F.lit("clash"), "pos": F.lit(1), "n": F.lit(2), "leaf": F.lit("no")})
    want = plain([r.asDict() for r in docs.collect()], fanout)
    assert found(docs, climb=climb, fanout=fanout) == want
    assert 0 < sum(r[6] for r in want) < len(want)


def test_small_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOC)).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == h() and one.n_siblings == 0


def test_places_over_many_ranges(spark, sf):
    """One tree over many ranges: the places are those of one window."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("t").alias("tree"), F.col("doc_id").alias("id"), F.md5("text").alias("node"))
    got = [(r["id"], r["pos"], r["n"]) for r in merkle.placed(rows, ["id", "node"], range_rows=7).collect()]
    ids = sorted(i for i, _, _ in got)
    assert sorted(got) == [(i, k, len(ids)) for k, i in enumerate(ids)]
