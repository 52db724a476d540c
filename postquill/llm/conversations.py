"""Repair of the structure of conversations by the cheapest edits.

The roles of a repaired conversation begin, as initials, like ``(s?(ua)+)?``. A state says
what stands last (nothing, s, u or a), and what may follow is fixed by it. One macro edit
handles one turn: a run of inserted turns, then the turn kept, given another role or
deleted. Their codes (``I``s and a letter) are prefix-free, and sorted as texts they are
numbered. So the dynamic programme needs no audit strings: a state at a turn has a cost and
a rank among the states of its layer, a candidate is one integer (cost, rank of the state
before, number of the macro), and its least says cost, rank and parent. The audit and the
repaired turns are built afterwards from the parents. All conversations of a batch take a
step at once, in numpy.

Conversations of any length are cut where a range sort of light rows (no texts) cuts them.
A piece is summed up by the costs and ranks from each state to each other one; pieces of one
conversation, at most as many as there are ranges, are joined by the same comparison. Equal
rows of one turn are one entry with a number of copies, which the programme crosses in one
step. Texts move once, for the digest, and are hashed as a sorted stream, so the memory
of a task does not grow with a conversation except by the audit that it returns; the digest
of one conversation is one sequence by its definition.

Defined results: a null role or text is one space, and so are a null conversation and turn
in the checksum; the null conversation is one like others; null turns come first and count
for no gap; rows of one turn go by role, then by the MD5 of the text; the turns left of a
conversation may be none; a role of no known initial, or an empty one, cannot be kept; gaps
beyond 64 bits are null; an empty table gives no rows; other columns count for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, table
from .merkle import crc32_sql

#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = " \t\n\x0b\f\r"
RANGE_ROWS = 250_000

STATES = "^sua"
ROLES = {"u": "user", "a": "assistant"}
#: What may follow each state, a system turn apart.
AFTER = {"^": "u", "s": "u", "u": "a", "a": "u"}
#: Runs of inserted turns that do not come back to a state.
RUNS = {"^": 2, "s": 2, "u": 1, "a": 1}
OK, BLANK, DUPLICATE, CUT = range(4)
MACROS = sorted("I" * n + x for n in range(3) for x in "DKR")
_FAR = 1 << 40


def run_of(state: str, n: int) -> str:
    """The initials of ``n`` turns inserted after ``state``."""
    out = ""
    for _ in range(n):
        out += AFTER[out[-1] if out else state]
    return out


def _candidates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """State before, macro and first place of each state after, and the costs by code of a
    turn (4 * its initial's place in STATES, 0 if unknown, + its fault)."""
    found = []
    for p in STATES:
        for n in range(RUNS[p] + 1):
            now = run_of(p, n)[-1:] or p
            found.append((STATES.index(now), p, n, "D", ""))
            found.append((STATES.index(AFTER[now]), p, n, "R", ""))
            found.append((STATES.index(AFTER[now]), p, n, "K", AFTER[now]))
    found.append((STATES.index("s"), "^", 0, "K", "s"))
    found.sort()
    cost = np.full((16, len(found)), _FAR, np.int64)
    for code in range(16):
        role, fault = STATES[code // 4], code % 4
        for i, (_, _, n, x, needs) in enumerate(found):
            if x == "D":
                cost[code, i] = DELETE + INSERT * n
            elif fault not in (BLANK, DUPLICATE) and (x == "R" or role == needs):
                cost[code, i] = (REROLE if x == "R" else 0) + INSERT * n + (TRUNCATED if fault == CUT else 0)
    before = np.array([STATES.index(f[1]) for f in found])
    macro = np.array([MACROS.index("I" * f[2] + f[3]) for f in found], np.int64)
    return before, macro, np.searchsorted([f[0] for f in found], np.arange(4)), cost


BEFORE, MACRO, STARTS, COST = _candidates()


def programme(code: np.ndarray, extra: np.ndarray, first: np.ndarray, sizes: np.ndarray, cost: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """Costs and ranks of the states after all turns of each piece, from ``cost`` (pieces,
    entries, states). Piece i has the ``sizes[i]`` codes from ``first[i]``; before the last
    of a code's equal turns ``extra`` more are deleted. With ``keep`` also the parents
    (state * 16 + macro), layer by layer. Pieces are in descending order of size."""
    cost, rank, parents = cost.copy(), np.zeros(cost.shape, np.int64), []
    rank += np.arange(4)
    for layer in range(int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -layer, side="left"))  # pieces of more turns than that
        at = first[:k] + layer
        step = COST[code[at]] + (DELETE * extra[at])[:, None]
        key = (cost[:k][:, :, BEFORE] + step[:, None, :]) << 8 | rank[:k][:, :, BEFORE] << 6 | MACRO << 2 | BEFORE
        key = np.minimum.reduceat(key, STARTS, axis=2)
        cost[:k] = np.minimum(key >> 8, _FAR)
        order = np.where(key >> 8 < _FAR, (key >> 2) & 63, 64 + np.arange(4))
        rank[:k] = (order[:, :, None, :] < order[:, :, :, None]).sum(axis=3)
        if keep:
            parents.append(((key & 3) << 4 | (key >> 2) & 15).astype(np.uint8))
    return cost, rank, parents


def entered(pieces: int, states: np.ndarray | None = None) -> np.ndarray:
    """Costs at the beginning: from every state, or from the given one of each piece."""
    cost = np.full((pieces, 4 if states is None else 1, 4), _FAR, np.int64)
    if states is None:
        cost[:, np.arange(4), np.arange(4)] = 0
    else:
        cost[np.arange(pieces), 0, states] = 0
    return cost


def ended(cost: list[int], rank: list[int]) -> tuple[int, int, int]:
    """The cheapest end: cost, state, and the number of turns inserted there."""
    ends = []
    for q, state in enumerate(STATES):
        n = {"^": 0, "s": 2, "u": 1, "a": 0}[state]
        ends.append((cost[q] + INSERT * n, rank[q], n, q))
    least = min(ends)
    return least[0], least[3], least[2]


def joined(pieces: list[tuple[list[int], list[int]]]) -> tuple[list[tuple[int, int]], int]:
    """The states (before, after) of each piece of a conversation on its cheapest way, and the
    number of turns inserted at the end, from the pieces' costs and ranks (16 of each)."""
    cost, rank, way = [0, _FAR, _FAR, _FAR], [0, 1, 2, 3], []
    for c, r in pieces:
        best = [min((cost[p] + c[4 * p + q], rank[p], p) for p in range(4)) for q in range(4)]
        order = sorted(range(4), key=lambda q: (best[q][0] >= _FAR, best[q][1], r[4 * best[q][2] + q]))
        cost, rank = [min(b[0], _FAR) for b in best], [order.index(q) for q in range(4)]
        way.append([b[2] for b in best])
    _, q, tail = ended(cost, rank)
    out = []
    for back in reversed(way):
        out.append((back[q], q))
        q = back[q]
    return out[::-1], tail


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and the number of times each row is there after the damage."""
    one = F.lit(" ")
    lot = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one)).cast("binary")) % 20
    text, role = F.coalesce(F.col("text").cast("string"), one), F.coalesce(F.col("role").cast("string"), one)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _digest() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest")


def entries(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Light rows in the order of their conversations: (conv_id, turn, role, digest, times, code, at),
    one for all equal rows of a turn. ``at`` orders them; its high bits number the range."""
    inked = F.rtrim("text", F.lit(SPACES))
    fault = F.when(inked == "", BLANK).when(~F.substring(inked, -1, 1).isin(*".!?"), CUT).otherwise(OK)
    seen = rows.where("times > 0").select("conv_id", "turn", "role", _digest(), "times", fault.alias("fault"))
    seen = materialise(seen.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("times").alias("times"), F.min("fault").alias("fault")), "turns")
    ranges = max(1, -(-seen.count() // range_rows))
    order = ["conv_id", "turn", "role", "digest"]
    seen = seen.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    seen = materialise(seen.withColumn("at", F.monotonically_increasing_id()), "turns-order")
    # role and text that another turn of the conversation has: all but the first are duplicates
    twice = seen.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    twice = twice.withColumnsRenamed({"conv_id": "__conv", "role": "__role", "digest": "__digest"}).drop("__n")
    found = seen.join(twice, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest")), "left")
    again = F.coalesce(F.col("at") > F.col("__first"), F.lit(False))
    fault = F.when(again & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    return found.select("conv_id", "turn", "role", "digest", "times", (initial * 4 + fault).cast("int").alias("code"), "at")


def _layers(items: pa.StructArray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and extras of all layers, and for each entry its first one; the layers' offsets.
    An entry of several copies has a second layer, which deletes the others."""
    code, times = items.field("code").to_numpy(zero_copy_only=False), items.field("times").to_numpy(zero_copy_only=False)
    many = 1 + (times > 1).astype(np.int64)
    start = np.cumsum(many) - many
    out, extra = np.repeat(code, many).astype(np.int64), np.zeros(int(many.sum()), np.int64)
    second = start[many > 1] + 1
    out[second] = out[second] // 4 * 4 + DUPLICATE
    extra[second] = times[many > 1] - 2
    return out, extra, start, np.r_[start, len(out)][offsets]


def _lists(column: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, extra, _, edges = _layers(*_lists(batch.column(2)))
        sizes = np.diff(edges)
        order = np.argsort(-sizes, kind="stable")
        cost, rank, _ = programme(code, extra, edges[:-1][order], sizes[order], entered(len(sizes)))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        flat = [pa.array(list(x[back].reshape(len(order), 16)), pa.list_(pa.int64())) for x in (cost, rank)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *flat], names=["conv_id", "part", "cost", "rank"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            way, tail = joined([(p["cost"], p["rank"]) for p in pieces])
            out += [(conv, p["part"], a, b, 0 if i < len(way) - 1 else tail) for i, (p, (a, b)) in enumerate(zip(pieces, way))]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["conv_id", "part", "enters", "leaves", "tail"])


EDIT = "conv_id long, turn long, role string, digest binary, code int, times long, lead string, new_role string, trail string, audit string, cost long"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each entry, from the states in which its piece is entered and left."""
    for batch in batches:
        items, offsets = _lists(batch.column("items"))
        code, extra, start, edges = _layers(items, offsets)
        sizes = np.diff(edges)
        order = np.argsort(-sizes, kind="stable")
        first, sizes = edges[:-1][order], sizes[order]
        enters, q = batch.column("enters").to_numpy()[order], batch.column("leaves").to_numpy()[order].copy()
        _, _, parents = programme(code, extra, first, sizes, entered(len(sizes), enters), keep=True)
        macro, state = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for layer in range(len(parents) - 1, -1, -1):
            k = len(parents[layer])
            parent = parents[layer][np.arange(k), 0, q[:k]]
            macro[first[:k] + layer], state[first[:k] + layer] = parent & 15, parent >> 4
            q[:k] = parent >> 4
        lasts = dict(zip((offsets[1:] - 1).tolist(), zip(batch.column("leaves").to_pylist(), batch.column("tail").to_pylist())))
        out: list[tuple] = []
        roles = items.field("role").to_pylist()
        two = np.r_[start[1:], len(code)] - start == 2
        for i, (a, twice) in enumerate(zip(start.tolist(), two.tolist())):
            edits, before = MACROS[macro[a]], STATES[state[a]]
            lead = run_of(before, len(edits) - 1)
            now = lead[-1:] or before
            new = None if edits[-1] == "D" else roles[i] if edits[-1] == "K" else ROLES[AFTER[now]]
            spent = int(COST[code[a]][_place(state[a], macro[a], code[a])])
            trail = ""
            if twice:
                last = MACROS[macro[a + 1]]
                trail = run_of(STATES[state[a + 1]], len(last) - 1)
                edits += "D" * int(extra[a + 1]) + last
                spent += DELETE * int(extra[a + 1] + 1) + INSERT * len(trail)
            left, tail = lasts.get(i, (0, 0))
            if tail:
                trail += run_of(STATES[left], tail)
                edits += "I" * tail
                spent += INSERT * tail
            out.append((lead, new, trail, edits, spent))
        whose = np.repeat(np.arange(len(batch)), np.diff(offsets))
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([
            batch.column("conv_id").take(pa.array(whose)), *[items.field(c) for c in ("turn", "role", "digest", "code", "times")], *[pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)],
        ], names=[c.split()[0] for c in EDIT.split(", ")])


def _place(state: int, macro: int, code: int) -> int:
    """The candidate of a parent: the cheapest of that state and macro."""
    which = np.flatnonzero((BEFORE == state) & (MACRO == macro))
    return int(which[COST[code][which].argmin()])


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {(1, 2), (2, 3), (3, 2)}


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from the stream of its edits and texts, in order: an edit stands
    before the texts of its turn, and of equal texts only the first is read."""
    conv, begun, out = None, False, []

    def fresh() -> dict:
        return {"low": None, "high": None, "turns": 0, "counts": [0, 0, 0, 0], "illegal": 0, "cost": 0, "audit": [], "sha": sha256(), "any": False, "last": None, "role": None, "trail": ""}

    def write(line: str) -> None:
        now["sha"].update((("\n" if now["any"] else "") + line).encode())
        now["any"] = True

    def close() -> None:
        gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
        out.append((conv, gaps if gaps < 1 << 63 else None, *now["counts"][1:], now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest()))

    def flush() -> pa.RecordBatch:
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=names)

    now = fresh()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "kind", "text", "code", "times", "lead", "new_role", "trail", "audit", "cost"))):
            of, turn, kind, text, code, times, lead, new_role, trail, audit, cost = row
            if not begun or of != conv:
                if begun:
                    close()
                conv, begun, now = of, True, fresh()
            if kind == 0:  # an edit
                if turn is not None and turn != now["high"]:
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"], now["turns"] = turn, now["turns"] + 1
                initial, fault = divmod(code, 4)
                now["illegal"] += times - 1 + (now["last"] is not None and (now["last"], initial) not in LEGAL)
                now["last"] = initial
                now["counts"][fault] += 1
                now["counts"][BLANK if fault == BLANK else DUPLICATE] += times - 1
                now["cost"] += cost
                now["audit"].append(audit)
                for x in lead + (trail if new_role is None else ""):
                    write(f"{ROLES[x]}:")
                now["role"], now["trail"] = new_role, trail
            elif kind == 1 and now["role"] is not None:  # the first text of a turn that stays
                write(f"{now['role']}:{text}")
                for x in now["trail"]:
                    write(f"{ROLES[x]}:")
                now["role"] = None
        if len(out) >= 10_000:
            yield flush()
            out = []
    if begun:
        close()
    if out:
        yield flush()


def repair(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, times): RESULT."""
    light = entries(rows, range_rows)
    item = F.struct("at", "turn", "role", "digest", "code", "times")
    # a range holds at most about ``range_rows`` entries, so a piece does
    pieces = light.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    pieces = materialise(pieces, "turns-pieces")
    summed = pieces.mapInArrow(_sum_up, "conv_id long, part long, cost array<long>, rank array<long>")
    whole = summed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "cost", "rank"))).alias("pieces"))
    chosen = whole.mapInArrow(_choose, "conv_id long, part long, enters int, leaves int, tail int").withColumnsRenamed({"conv_id": "__conv", "part": "__part"})
    both = pieces.join(chosen, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("part") == F.col("__part"))).select("conv_id", "items", "enters", "leaves", "tail")
    edits = both.mapInArrow(_rebuild, EDIT).select("*", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", "turn", "role", _digest(), F.when(F.col("times") > 0, 1).otherwise(2).alias("kind"), F.when(F.col("times") > 0, F.col("text")).alias("text"))
    stream = edits.unionByName(texts, allowMissingColumns=True)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stream.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "kind")
    return dealt.mapInArrow(_told, RESULT)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the damage, and its cheapest repair."""
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _macro_rows() -> str:
    """state, macro, state after, cost, initial that a kept turn needs, lines inserted, new role."""
    out = []
    for p in STATES:
        for n in range(RUNS[p] + 1):
            run = run_of(p, n)
            now, lines = run[-1:] or p, "".join(f"\\n{ROLES[x]}:" for x in run)
            nxt = AFTER[now]
            out += [(p, "I" * n + "D", now, 2 * n + 3, "", lines, ""), (p, "I" * n + "R", nxt, 2 * n + 2, "", lines, ROLES[nxt]), (p, "I" * n + "K", nxt, 2 * n, nxt, lines, "")]
    out.append(("^", "K", "s", 0, "s", "", ""))
    return ", ".join(f"('{p}', '{m}', '{q}', {c}, '{need}', E'{lines}', '{role}')" for p, m, q, c, need, lines, role in out)


OP13_SQL = f"""
WITH RECURSIVE lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS lot,
         dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM conversations),
hurt AS (SELECT c, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role, CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE lot WHEN 3 THEN 2 ELSE 1 END)) AS copy
         FROM lots WHERE lot <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM hurt),
judged AS (SELECT *, substr(role, 1, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
           WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE 'k' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS l FROM numbered),
macros(p, m, q, price, need, lines, new_role) AS (VALUES {_macro_rows()}),
way AS (
  SELECT DISTINCT c, 0::BIGINT AS i, '^' AS state, {{'cost': 0::BIGINT, 'audit': '', 'body': ''}} AS best FROM lots
  UNION ALL
  SELECT w.c, w.i + 1, m.q, min({{'cost': w.best.cost + m.price + CASE WHEN j.fault = 't' AND m.m NOT LIKE '%D' THEN 1 ELSE 0 END, 'audit': w.best.audit || m.m,
      'body': w.best.body || m.lines || CASE WHEN m.m LIKE '%D' THEN '' ELSE E'\\n' || CASE WHEN m.m LIKE '%R' THEN m.new_role ELSE j.role END || ':' || j.text END}})
  FROM way w JOIN judged j ON j.c = w.c AND j.i = w.i + 1 JOIN macros m ON m.p = w.state AND (m.m LIKE '%D' OR (j.fault IN ('k', 't') AND (m.need = '' OR m.need = j.r)))
  GROUP BY w.c, w.i, m.q),
summed AS (SELECT c, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (i > 1 AND l || r NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY c),
ends(state, more, price, lines) AS (VALUES ('^', '', 0, ''), ('s', 'II', 4, E'\\nuser:\\nassistant:'), ('u', 'I', 2, E'\\nassistant:'), ('a', '', 0, '')),
done AS (SELECT w.c, min({{'cost': w.best.cost + e.price, 'audit': w.best.audit || e.more, 'body': w.best.body || e.lines}}) AS best
         FROM way w LEFT JOIN summed s ON s.c = w.c JOIN ends e ON e.state = w.state WHERE w.i = coalesce(s.n, 0) GROUP BY w.c)
SELECT k.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
       coalesce(s.illegal, 0)::BIGINT AS illegal, d.best.cost::BIGINT AS cost, d.best.audit AS audit, sha256(substr(d.best.body, 2)) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM lots) k JOIN done d ON d.c = k.c LEFT JOIN summed s ON s.c = k.c
"""
