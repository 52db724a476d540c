"""Merkle manifest of a dataset: one tree a language, and one over their roots.

Leaves of a tree are dealt to aligned blocks of ``FANOUT ** CLIMB`` places. A block is
one row whose digests lie in one contiguous matrix of 64-byte hexadecimal texts: each
level reshapes it by the fanout and hashes its rows, and every sibling is found by index
arithmetic. A block's top is a leaf of the next layer of blocks, so a tree of any size is
as many layers as its depth has multiples of ``CLIMB``, and no task holds more than a
block. Going down, a block learns the siblings above it, which all its leaves share.

Places come from a range sort: rows are numbered in each range, and the counts of the
ranges before are added, so a language of any size is never one task's window.

Defined results: nulls are ``-``; leaves ascend by id, null ids first, rows of one id by
their leaf (equal rows have equal leaves); a row without an id is not tampered with; the
null language has a tree like others and comes first; a tree of one leaf has that leaf as
root and no siblings; an empty table gives no rows; columns beyond those of ``FIELDS``
count for nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, materialise, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Levels that a block spans: 4,096 leaves.
CLIMB = 12
HEX = 64
RANGE_ROWS = 250_000
TAMPER = 7


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    values = {name: F.col(name) for name in FIELDS} | ({} if n_chars is None else {"n_chars": n_chars})
    return F.sha2(F.concat(*[encoded(values[name]) for name in FIELDS]).cast("binary"), 256)


def depth(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def hashed(nodes: np.ndarray) -> np.ndarray:
    """The digest of each row of a matrix of bytes, as rows of hexadecimal text."""
    width, data = nodes.shape[1], nodes.tobytes()
    return np.frombuffer("".join([sha256(data[i : i + width]).hexdigest() for i in range(0, len(data), width)]).encode(), np.uint8).reshape(-1, HEX)


def levels_of(nodes: np.ndarray, climbs: int, fanout: int) -> list[np.ndarray]:
    """The matrices of a block's levels: each is the one below, reshaped and hashed."""
    out = [nodes]
    for _ in range(climbs):
        now = out[-1]
        whole = len(now) // fanout * fanout
        up = [hashed(now[:whole].reshape(-1, fanout * HEX))] if whole else []
        if whole < len(now):  # the last run has fewer
            up.append(hashed(now[whole:].reshape(1, -1)))
        out.append(np.concatenate(up))
    return out


def siblings(level: np.ndarray, at: np.ndarray, fanout: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For places ``at`` of a level: (which of them, their numbers in the run, the digests of the
    run's others from left to right), one entry for each length of a run."""
    first = at // fanout * fanout
    size = np.minimum(fanout, len(level) - first)
    out = []
    for n in np.unique(size):
        which = np.flatnonzero(size == n)
        nth = at[which] - first[which]
        others = np.arange(n - 1)[None, :]
        others = first[which][:, None] + others + (others >= nth[:, None])
        out.append((which, nth, level[others].reshape(len(which), -1)))
    return out


def folded(now: np.ndarray, nth: np.ndarray, others: np.ndarray) -> np.ndarray:
    """One level up: each digest put among the others of its run, and hashed."""
    out = np.empty_like(now)
    for k in np.unique(nth):
        which = np.flatnonzero(nth == k)
        left, right = others[which, : k * HEX], others[which, k * HEX :]
        out[which] = hashed(np.ascontiguousarray(np.concatenate([left, now[which], right], axis=1)))
    return out


def _matrix(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, HEX)


BLOCK = "tree string, block long, n long, nodes binary, top string, ids array<long>, forged binary"


def _gather(climb: int, fanout: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        tree, block, n = (group.column(c)[0].as_py() for c in ("tree", "block", "n"))
        nodes = _matrix("".join(group.column("node").to_pylist()).encode())
        top = levels_of(nodes, min(climb, depth(n, fanout)), fanout)[-1]
        forged = "".join(group.column("forged").to_pylist()).encode()
        return pa.table({
            "tree": pa.array([tree], pa.string()), "block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int64()), "nodes": pa.array([nodes.tobytes()], pa.binary()),
            "top": pa.array([top.tobytes().decode()]), "ids": pa.array([group.column("id").to_pylist()], pa.list_(pa.int64())), "forged": pa.array([forged], pa.binary()),
        })

    return run


def placed(rows: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` (a written table with a column tree) with their places ``pos`` in their tree's
    order, from 0, and its number ``n`` of rows."""
    ranges = max(1, -(-rows.count() // range_rows))
    ordered = rows.repartitionByRange(ranges, "tree", *order).sortWithinPartitions("tree", *order)
    ordered = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("at", 33)  # the number of the range; below it the row's number there
    runs = ordered.groupBy(F.col("tree").alias("__tree"), part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("at").alias("__first"))
    # one row for each tree and range that it lies in
    whole = Window.partitionBy("__tree")
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__tree", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("n"))
    found = ordered.join(runs, F.col("tree").eqNullSafe(F.col("__tree")) & (part == F.col("__part")))
    return found.withColumn("pos", F.col("at") + F.col("__shift")).drop("at", "__tree", "__part", "__shift")


def layers(rows: DataFrame, climb: int = CLIMB, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables of blocks from the leaves up, the last with one block a tree, from rows
    (tree, pos, n, node, id, forged)."""
    size = fanout**climb
    out = []
    while True:
        dealt = rows.withColumn("block", F.floor(F.col("pos") / F.lit(size)).cast("long"))
        out.append(materialise(dealt.groupBy("tree", "block").applyInArrow(_gather(climb, fanout), BLOCK), "merkle-blocks"))
        if (out[-1].agg(F.max("block")).first()[0] or 0) == 0:
            return out
        rows = out[-1].select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(size)).cast("long").alias("n"), F.col("top").alias("node"), F.lit(None).cast("long").alias("id"), F.lit("").alias("forged"))


PATH = "tree string, block long, nths array<int>, others array<string>, root string"


def _descend(climb: int, fanout: int):
    """Of each node of a block (tree, block, n, nodes, and nths, others and root from above
    it): its place in its run and the run's others, level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                nodes = _matrix(r["nodes"])
                nths: list[list] = [[] for _ in nodes]
                others: list[list] = [[] for _ in nodes]
                at = np.arange(len(nodes))
                for level in levels_of(nodes, min(climb, depth(r["n"], fanout)), fanout)[:-1]:
                    for which, nth, beside in siblings(level, at, fanout):
                        for i, k, text in zip(which.tolist(), nth.tolist(), beside):
                            nths[i].append(k)
                            others[i].append(text.tobytes().decode())
                    at = at // fanout
                first = r["block"] * fanout**climb
                out += [(r["tree"], first + i, nths[i] + r["nths"], others[i] + r["others"], r["root"]) for i in range(len(nodes))]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["tree", "block", "nths", "others", "root"])

    return run


def _above(blocks: list[DataFrame], climb: int, fanout: int, down_to: int = 0) -> DataFrame:
    """PATH of every block of layer ``down_to``."""
    path = blocks[-1].select("tree", "block", F.array().cast("array<int>").alias("nths"), F.array().cast("array<string>").alias("others"), F.col("top").alias("root"))
    for layer in range(len(blocks) - 1, down_to, -1):
        path = materialise(_joined(blocks[layer], path).mapInArrow(_descend(climb, fanout), PATH), "merkle-paths")
    return path


def _joined(blocks: DataFrame, path: DataFrame) -> DataFrame:
    path = path.withColumnsRenamed({"tree": "__tree", "block": "__block"})
    return blocks.join(path, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block"))).drop("__tree", "__block")


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_siblings int"


def _proofs(climb: int, fanout: int) -> Callable:
    """The proofs of a block's leaves, and the root to which each folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                nodes, now = _matrix(r["nodes"]), _matrix(r["forged"])
                proof, at = [bytearray() for _ in nodes], np.arange(len(nodes))
                for level in levels_of(nodes, min(climb, depth(r["n"], fanout)), fanout)[:-1]:
                    up = np.empty_like(now)
                    for which, nth, others in siblings(level, at, fanout):
                        up[which] = folded(now[which], nth, others)
                        width, data = others.shape[1], others.tobytes()
                        for i, k in enumerate(which.tolist()):
                            proof[k] += data[i * width : (i + 1) * width]
                    now, at = up, at // fanout
                # above the block all its leaves have the same siblings, so equal digests stay equal
                shared = "".join(r["others"]).encode()
                kinds, back = np.unique(np.ascontiguousarray(now).view(f"S{HEX}").ravel(), return_inverse=True)
                kinds = np.frombuffer(kinds.tobytes(), np.uint8).reshape(-1, HEX)
                for nth, beside in zip(r["nths"], r["others"]):
                    beside = np.frombuffer(beside.encode(), np.uint8)
                    kinds = folded(kinds, np.full(len(kinds), nth), np.broadcast_to(beside, (len(kinds), len(beside))))
                ends = [kinds[i].tobytes().decode() for i in range(len(kinds))]
                ends = [ends[i] for i in back.ravel().tolist()]
                n = len(nodes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["ids"], pa.int64()), pa.array([nodes[i].tobytes().decode() for i in range(n)]), pa.array([r["subroot"]] * n), pa.array([r["root"]] * n),
                    pa.array([sha256(p + shared).hexdigest() for p in proof]), pa.array(ends), pa.array([e == r["root"] for e in ends]),
                    pa.array([(len(p) + len(shared)) // HEX for p in proof], pa.int32()),
                ], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings"])

    return run


def manifest(docs: DataFrame, forged_chars: Column | None = None, climb: int = CLIMB, fanout: int = FANOUT) -> DataFrame:
    """A row for each document: its leaf, its language's root, the root of all, the digest of
    its proof, and whether the leaf folds to the root.

    ``forged_chars`` takes the place of ``n_chars`` in the leaf that is folded, where it is
    not null."""
    rows = docs.select(*FIELDS)
    own = leaf()
    forged = F.lit(None).cast("string") if forged_chars is None else F.when(forged_chars.isNotNull(), leaf(forged_chars))
    rows = rows.select(F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("id"), own.alias("node"), forged.alias("forged"))
    leaves = materialise(rows, "merkle-leaves")
    leaves = leaves.withColumn("forged", F.coalesce("forged", "node"))
    blocks = layers(placed(leaves, ["id", "node"]), climb, fanout)
    roots = blocks[-1].select("tree", F.col("top").alias("subroot"))
    # the roots, one a language, are the leaves of one more tree
    subroots = materialise(roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("subroot").alias("node")), "merkle-subroots")
    upper = placed(subroots, ["lang"]).withColumns({"id": F.col("pos"), "forged": F.col("node")})
    upper = materialise(upper, "merkle-upper")
    tops = layers(upper.drop("lang"), climb, fanout)
    found = _joined(tops[0], _above(tops, climb, fanout)).mapInArrow(_descend(climb, fanout), PATH)
    over = found.select(F.col("block").alias("__pos"), F.col("nths").alias("over_nths"), F.col("others").alias("over_others"), F.col("root").alias("over_root"))
    over = upper.select(F.col("lang").alias("__lang"), "pos").join(over, F.col("pos") == F.col("__pos")).drop("pos", "__pos")
    whole = _joined(blocks[0], _above(blocks, climb, fanout)).join(over, F.col("tree").eqNullSafe(F.col("__lang")))
    whole = whole.select("block", "n", "nodes", "forged", "ids", F.concat("nths", "over_nths").alias("nths"), F.concat("others", "over_others").alias("others"), F.col("root").alias("subroot"), F.col("over_root").alias("root"))
    out = whole.mapInArrow(_proofs(climb, fanout), RESULT)
    discard(leaves, *blocks[1:])
    return out


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; those whose id's checksum 7 divides are checked with one character too many."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    return manifest(table(spark, sf_dir, "documents"), F.when(chosen, F.col("n_chars").cast("decimal(20,0)") + 1))


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the CRC-32 of an ASCII text: bit by bit, lowest first."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform(range(8), lambda k: (ascii(ch) >> k::INTEGER) & 1)))"
    step = "xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({bits}, lambda b: b::BIGINT)), lambda c, b: {step}), 4294967295)"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


_PLAIN = " || ".join(map(_field, FIELDS))
_FORGED = " || ".join(_field("(n_chars + 1)" if name == "n_chars" else name) for name in FIELDS)
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, sha256({_PLAIN}) AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % {TAMPER} = 0 AND n_chars IS NOT NULL THEN sha256({_FORGED}) END AS other FROM documents),
placed AS (SELECT *, coalesce(other, leaf) AS forged, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up AS (SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
       UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, (SELECT max(level) FROM up u WHERE u.lang IS NOT DISTINCT FROM up.lang) AS height FROM up WHERE n = 1),
over_ AS (SELECT 0 AS level, pos, n, subroot AS node FROM subroots
          UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM over_ WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT p.doc_id, p.lang, p.pos AS id, u.level, (p.pos >> u.level::INTEGER) & 1 AS nth, s.node FROM placed p JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND u.pos = p.pos >> u.level::INTEGER AND u.n > 1
    LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = u.level AND s.pos = xor(u.pos, 1)
  UNION ALL
  SELECT p.doc_id, p.lang, p.pos, r.height + u.level, (r.pos >> u.level::INTEGER) & 1, s.node FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN over_ u ON u.pos = r.pos >> u.level::INTEGER AND u.n > 1
    LEFT JOIN over_ s ON s.level = u.level AND s.pos = xor(u.pos, 1)),
proofs AS (SELECT lang, id, count(node) AS n_siblings, sha256(coalesce(string_agg(node, '' ORDER BY level), '')) AS proof FROM steps GROUP BY lang, id),
fold AS (SELECT lang, pos AS id, 0 AS level, forged AS node FROM placed
         UNION ALL SELECT f.lang, f.id, f.level + 1, sha256(CASE s.nth WHEN 0 THEN f.node || coalesce(s.node, '') ELSE coalesce(s.node, '') || f.node END)
         FROM fold f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.id = f.id AND s.level = f.level),
ends AS (SELECT lang, id, arg_max(node, level) AS folded FROM fold GROUP BY lang, id),
top AS (SELECT node AS root FROM over_ WHERE n = 1)
SELECT p.doc_id, p.leaf, r.subroot, t.root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = t.root AS verified, coalesce(q.n_siblings, 0)::INTEGER AS n_siblings
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang CROSS JOIN top t
LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.id = p.pos JOIN ends e ON e.lang IS NOT DISTINCT FROM p.lang AND e.id = p.pos
"""
