"""Queries: chunking, search, fusion, reranking and retrieval quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, content_terms, key_of_chunk
from ..operators import chunking, dense, fusion, lexical, metrics, rerank, retrievers, vectorindex
from ..operators.evaluation import misses
from ..session import materialise, shared_dir, table
from .base import EVERY, label_vectors, query, query_number, vector_queries

TOP, DEPTH = 10, 50

# -- SQL parts shared by several queries
_TOK = r"tok AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '') AS t FROM documents)"
_FIXED = (
    _TOK + r""",
ch AS (SELECT doc_id, i::INT AS ordinal, doc_id || ':' || i AS id, t[(i * {stride} + 1)::INT : (i * {stride} + 512)::INT] AS c
       FROM (SELECT doc_id, t, unnest(generate_series(0, CASE WHEN len(t) <= 512 THEN 0 ELSE ceil((len(t) - 512) / {stride}.0)::BIGINT END)) AS i FROM tok WHERE len(t) > 0))"""
)
_STOP = ", ".join(f"'{w}'" for w in lexical.STOPWORDS)


def _bm25(texts: str, idtype: str = "VARCHAR") -> str:
    return rf"""
bq AS (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '\w\w+')) AS term FROM benchmark),
asked AS (SELECT qid, term, count(*) AS qtf FROM bq WHERE term NOT IN ({_STOP}) GROUP BY ALL),
dt AS (SELECT id, list_filter(regexp_extract_all(lower(text), '\w\w+'), lambda w: w NOT IN ({_STOP})) AS t FROM {texts}),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
po AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
bs AS (SELECT qid, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
       FROM po JOIN df USING (term) JOIN asked USING (term), st GROUP BY qid, id),
bm AS (SELECT qid, 'bm25' AS run, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM bs QUALIFY rank <= {DEPTH})"""


_TERMS_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TERMS = rf"list_distinct(list_filter(regexp_extract_all(lower({{x}}), '[a-z0-9'']+'), lambda w: length(w) > 2 AND w NOT IN ({_TERMS_STOP})))"
_OVERLAP = f"""
oq AS (SELECT qid, len(t) AS n, unnest(t) AS term FROM (SELECT item_id AS qid, {_TERMS.format(x="text")} AS t FROM benchmark)),
oh AS (SELECT id, unnest({_TERMS.format(x="text")}) AS term FROM texts),
os AS (SELECT qid, id, round(count(*) / n, 6) AS score FROM oh JOIN oq USING (term) GROUP BY qid, id, n),
ov AS (SELECT qid, 'overlap' AS run, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM os QUALIFY rank <= {DEPTH})"""
_TEXTS = _FIXED.format(stride=512) + ", texts AS (SELECT id, array_to_string(c, ' ') AS text FROM ch), "
_EMBED = r"""
ev AS (SELECT {key}, ('0x' || substr(h, 1, 4))::INT % 64 AS d, sum(CASE WHEN ('0x' || substr(h, 5, 1))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v
       FROM (SELECT {key}, md5(unnest(regexp_extract_all(lower(text), '\w\w+'))) AS h FROM {rows}) GROUP BY ALL)"""
_DENSE_TEXT = (
    "".join(_EMBED.replace("ev AS", f"{name} AS").format(key=key, rows=rows) + "," for name, key, rows in (("qe", "qid", "(SELECT item_id AS qid, text FROM benchmark)"), ("ce", "id", "texts"))) + f"""
qn AS (SELECT qid, sqrt(sum(v * v)) AS n FROM qe GROUP BY qid), cn AS (SELECT id, sqrt(sum(v * v)) AS n FROM ce GROUP BY id),
dp AS (SELECT qid, id, sum(qe.v * ce.v) AS dot FROM qe JOIN ce USING (d) GROUP BY ALL),
ds AS (SELECT qn.qid, cn.id, round(coalesce(dot / nullif(qn.n * cn.n, 0), 0), 6) AS score FROM qn CROSS JOIN cn LEFT JOIN dp ON dp.qid = qn.qid AND dp.id = cn.id),
dn AS (SELECT qid, 'dense' AS run, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM ds QUALIFY rank <= {DEPTH})"""
)
_COLLAPSED = f""",
co AS (SELECT qid, regexp_replace(id, ':[^:]*$', '') AS id, max(score) AS score, min(rank) AS first_rank FROM rk GROUP BY ALL),
hy AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY first_rank, id)::INT AS rank FROM co QUALIFY rank <= {TOP})"""
_FUSED = f"rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {{scores}} QUALIFY rank <= {DEPTH})"


def _rrf(other: str) -> str:
    return f", both_ AS (SELECT * FROM bm UNION ALL SELECT * FROM {other}), rr AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM both_ GROUP BY qid, id), " + _FUSED.format(scores="rr")


_HYBRID = "WITH " + _TEXTS + _bm25("texts") + "," + _DENSE_TEXT + _rrf("dn") + _COLLAPSED


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dedup_key"), "text")
    return chunking.fixed(docs, F.col("text")).select(F.col("chunk_id").alias("id"), "text")


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _found(spark: SparkSession, sf: str, name: str) -> DataFrame:
    run = retrievers.retrieve(name, _chunks(spark, sf), _questions(spark, sf), DEPTH, 0.7)
    return fusion.collapse(run, key_of_chunk("id"), TOP).select("qid", "id", "score", "rank")


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, "hybrid_rrf")


@query(_HYBRID + " SELECT qid, id, score, rank FROM hy")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 and dense vectors over chunks, fused by rank, collapsed to messages."""
    return _hybrid(spark, sf)


@query("WITH " + _TEXTS + _bm25("texts") + "," + _DENSE_TEXT + f""", both_ AS (SELECT * FROM bm UNION ALL SELECT * FROM dn),
mm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM both_ WINDOW w AS (PARTITION BY qid, run)),
ws AS (SELECT qid, id, round(sum(CASE WHEN run = 'dense' THEN 0.7 ELSE 1 - 0.7 END * s), 6) AS score FROM mm GROUP BY qid, id), """ + _FUSED.format(scores="ws") + _COLLAPSED + " SELECT qid, id, score, rank FROM hy")  # fmt: skip
def hybrid_weighted_search(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, "hybrid_weighted")


@query("WITH " + _TEXTS + _DENSE_TEXT + ", rk AS (SELECT qid, id, score, rank FROM dn)" + _COLLAPSED + " SELECT qid, id, score, rank FROM hy")
def dense_text_search(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, "dense")


@query("WITH " + _TEXTS + _bm25("texts") + ", rk AS (SELECT qid, id, score, rank FROM bm)" + _COLLAPSED + " SELECT qid, id, score, rank FROM hy")
def bm25_chunk_search(spark: SparkSession, sf: str) -> DataFrame:
    return _found(spark, sf, "bm25")


@query("WITH " + _TEXTS + _bm25("texts") + "," + _OVERLAP + _rrf("ov").replace(f" QUALIFY rank <= {DEPTH}", "") + _COLLAPSED + " SELECT qid, id, score, rank FROM hy")
def lexical_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 and the share of the question's terms, two lexical runs, fused by rank."""
    chunks, asked = _chunks(spark, sf), _questions(spark, sf)
    runs = fusion.union_runs(lexical.bm25(chunks, asked, DEPTH, keep_zero=False), lexical.overlap_run(chunks, asked, DEPTH, content_terms))
    return fusion.collapse(fusion.reciprocal_rank(runs), key_of_chunk("id"), TOP).select("qid", "id", "score", "rank")


_REL = "rel AS (SELECT b.item_id AS qid, d.doc_id::VARCHAR AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_METRICS = """
nr AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
ht AS (SELECT qid, min(rank) AS found_at, coalesce(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END), 0) AS dcg,
       count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 20) AS h20 FROM {run} JOIN rel USING (qid, id) GROUP BY qid),
pq AS (SELECT q.qid, q.query_class, coalesce(n, 0) AS n_relevant, found_at, CASE WHEN n > 0 THEN coalesce(h5, 0) / n END AS recall_5,
       CASE WHEN n > 0 THEN coalesce(h20, 0) / n END AS recall_20, CASE WHEN n > 0 THEN coalesce(1 / found_at, 0) END AS rr,
       CASE WHEN n > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg
       FROM qs q LEFT JOIN nr USING (qid) LEFT JOIN ht USING (qid))"""
_SUMMARY = """SELECT CASE WHEN grouping(query_class) = 1 THEN 'all' ELSE query_class END AS query_class, count(*) AS n_queries, count(*) FILTER (n_relevant > 0) AS n_answerable,
 round(avg(recall_5), 6) AS recall_5, round(avg(recall_20), 6) AS recall_20, round(avg(rr), 6) AS rr, round(avg(ndcg), 6) AS ndcg FROM pq GROUP BY ROLLUP (query_class)"""


@query(_HYBRID + ", " + _REL + ", qs AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS query_class FROM benchmark)," + _METRICS.format(run="hy") + _SUMMARY)
def hybrid_quality(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark")
    docs = table(spark, sf, "documents")
    # planted passages: a benchmark text inside a document; candidates share its first words
    relevant = _contained(docs, asked)
    classes = asked.select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("query_class"))
    return metrics.summary(metrics.per_query(_hybrid(spark, sf), classes, relevant))


def _contained(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, id) of benchmark texts inside documents: pairs that share the text's longest
    word, as ids; texts join afterwards."""
    word = F.regexp_extract_all(F.lower("text"), F.lit(r"\w\w+"), F.lit(0))
    rare = asked.select(F.col("item_id").alias("qid"), F.col("text").alias("needle"), F.array_max(F.transform(word, lambda w: F.struct(F.length(w), w.alias("w"))))["w"].alias("w"))
    pairs = docs.select("doc_id", F.explode(F.array_distinct(word)).alias("w")).join(rare, "w").drop("w")
    held = pairs.join(docs.select("doc_id", "text"), "doc_id")
    return held.where(F.contains("text", F.col("needle"))).select("qid", F.col("doc_id").cast("string").alias("id")).distinct()


_LONG = rf"""bt AS (SELECT item_id AS qid, text AS query FROM benchmark), texts AS (SELECT doc_id AS id, text FROM documents)"""


@query("WITH " + _LONG + "," + _bm25("texts") + " SELECT qid, id, score, rank FROM bm")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return lexical.bm25(docs, _questions(spark, sf), DEPTH, keep_zero=False).drop("run")


@query("WITH " + _LONG + "," + _bm25("texts") + f""",
cnt AS (SELECT b.item_id AS qid, count(bm.id) AS got FROM benchmark b LEFT JOIN bm ON bm.qid = b.item_id GROUP BY 1),
zero AS (SELECT c.qid, d.doc_id AS id, 0.0::DOUBLE AS score, (c.got + row_number() OVER (PARTITION BY c.qid ORDER BY d.doc_id))::INT AS rank
         FROM cnt c, documents d WHERE c.got < {DEPTH} AND NOT EXISTS (SELECT 1 FROM bm WHERE bm.qid = c.qid AND bm.id = d.doc_id))
SELECT qid, id, score, rank FROM bm UNION ALL SELECT qid, id, score, rank FROM zero WHERE rank <= {DEPTH}""")
def bm25_padded(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return lexical.bm25(docs, _questions(spark, sf), DEPTH).drop("run")


# -- chunking

_CHUNK_OUT = " SELECT id AS chunk_id, doc_id::VARCHAR AS dedup_key, ordinal, len(c)::INT AS n_tokens, md5(array_to_string(c, ' ')) AS text_md5 FROM ch"


def _chunk_out(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "dedup_key", "ordinal", "n_tokens", F.md5("text").alias("text_md5"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dedup_key"), "text")


@query("WITH " + _FIXED.format(stride=512) + _CHUNK_OUT)
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_out(chunking.fixed(_docs(spark, sf), F.col("text")))


@query("WITH " + _FIXED.format(stride=448) + _CHUNK_OUT)
def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_out(chunking.fixed(_docs(spark, sf), F.col("text"), overlap=64))


@query("WITH " + _TOK + ", ch AS (SELECT doc_id, 0 AS ordinal, doc_id || ':0' AS id, t[1:512] AS c FROM tok WHERE len(t) > 0)" + _CHUNK_OUT)
def chunk_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_out(chunking.whole(_docs(spark, sf), F.col("text")))


_PACK = 60


@query(rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS tok FROM conversations),
m AS (SELECT conv_id, turn, tok, len(tok) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || '-' || turn) AS pos FROM t WHERE len(tok) > 0),
f AS (SELECT conv_id, pos, CASE WHEN n > {_PACK} THEN 0 ELSE n END AS used, 0 AS no, n > {_PACK} AS big FROM m WHERE pos = 1
 UNION ALL
 SELECT m.conv_id, m.pos, CASE WHEN m.n > {_PACK} THEN 0 WHEN f.used + m.n > {_PACK} THEN m.n ELSE f.used + m.n END,
        CASE WHEN (m.n > {_PACK} OR f.used + m.n > {_PACK}) AND f.used > 0 THEN f.no + 1 ELSE f.no END, m.n > {_PACK}
 FROM f JOIN m ON m.conv_id = f.conv_id AND m.pos = f.pos + 1),
j AS (SELECT m.*, f.no, f.big FROM m JOIN f USING (conv_id, pos)),
packed AS (SELECT conv_id, no AS ordinal, arg_min(turn, pos) AS turn, flatten(list(tok ORDER BY pos)) AS c FROM j WHERE NOT big GROUP BY conv_id, no),
large AS (SELECT conv_id, turn, i AS ordinal, tok[(i * {_PACK} + 1)::INT : (i * {_PACK} + {_PACK})::INT] AS c FROM (SELECT *, unnest(generate_series(0, ceil(n / {_PACK}.0)::BIGINT - 1)) AS i FROM j WHERE big))
SELECT conv_id || '-' || turn || ':' || ordinal AS chunk_id, conv_id || '-' || turn AS dedup_key, ordinal::INT AS ordinal, len(c)::INT AS n_tokens, md5(array_to_string(c, ' ')) AS text_md5
FROM (SELECT conv_id, turn, ordinal, c FROM packed UNION ALL SELECT conv_id, turn, ordinal, c FROM large)""")
def chunk_thread_aware(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("thread_id"), F.concat_ws("-", "conv_id", "turn").alias("dedup_key"), "turn", "text")
    return _chunk_out(chunking.thread_aware(turns, F.col("text"), ["turn"], size=_PACK))


@query("WITH " + _FIXED.format(stride=512) + " SELECT 'other' AS side, id AS chunk_id FROM ch WHERE doc_id % 50 = 7")
def rebuild_parity(spark: SparkSession, sf: str) -> DataFrame:
    built = chunking.fixed(_docs(spark, sf), F.col("text"))
    stored = built.where(F.col("dedup_key").cast("long") % 50 != 7)
    return chunking.id_differences(stored, built).select("side", "chunk_id")


@query("WITH " + _FIXED.format(stride=512) + " SELECT count(*) AS chunks, count(DISTINCT doc_id) AS messages, round(count(*) / count(DISTINCT doc_id), 6) AS chunks_per_message, round(avg(len(c)), 6) AS mean_tokens, max(len(c))::INT AS max_tokens FROM ch")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.fixed(_docs(spark, sf), F.col("text"))
    n, m = F.count(F.lit(1)), F.count_distinct("dedup_key")
    return c.agg(n.alias("chunks"), m.alias("messages"), F.round(n / m, 6).alias("chunks_per_message"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"), F.max("n_tokens").alias("max_tokens"))


# -- dense search and fusion over vectors

_DOT = "list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_DENSE = f"""
de AS (SELECT q.vec_id AS qid, d.vec_id AS id, round({_DOT}, 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
dense AS (SELECT qid, 'dense' AS run, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM de QUALIFY rank <= 100),
ha AS (SELECT q.vec_id AS qid, d.vec_id AS id, round({_DOT.replace("q.embedding", "list_transform(q.embedding, lambda x: sign(x))").replace("d.embedding", "list_transform(d.embedding, lambda x: sign(x))")}, 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
signs AS (SELECT qid, 'signs' AS run, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM ha QUALIFY rank <= 100),
runs AS (SELECT * FROM dense UNION ALL SELECT * FROM signs)"""


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v, q = label_vectors(spark, sf), vector_queries(spark, sf)
    signs = lambda df, c: df.withColumn(c, F.transform(c, F.signum))
    coarse = dense.search_batch(signs(v, "embedding"), signs(q, "vector"), 100).withColumn("run", F.lit("signs"))
    return dense.search_batch(v, q, 100), coarse


@query("WITH" + _DENSE + " SELECT qid, id, score, rank FROM dense")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.search(label_vectors(spark, sf), vector_queries(spark, sf), 100).drop("run")


@query("WITH" + _DENSE + " SELECT qid, id, score, rank FROM dense")
def dense_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    return dense.search_batch(label_vectors(spark, sf), vector_queries(spark, sf), 100).drop("run")


_RRF = " , rf AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM runs GROUP BY qid, id), rrf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM rf)"
_MM = " , mm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM runs WINDOW w AS (PARTITION BY qid, run))"


@query("WITH" + _DENSE + _RRF + " SELECT qid, id, score, rank FROM rrf")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.reciprocal_rank(fusion.union_runs(*_runs(spark, sf))).drop("run")


@query("WITH" + _DENSE + _MM + """, wf AS (SELECT qid, id, round(sum(CASE WHEN run = 'dense' THEN 0.7 ELSE 0.3 END * s), 6) AS score FROM mm GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM wf QUALIFY rank <= 50""")
def weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.weighted(fusion.union_runs(*_runs(spark, sf)), {"dense": 0.7, "signs": 0.3}, 50).drop("run")


@query("WITH" + _DENSE + _MM + """, wf AS (SELECT share, qid, id, round(sum(CASE WHEN run = 'dense' THEN share ELSE 1 - share END * s), 6) AS score FROM mm, (VALUES (0.3::DOUBLE), (0.4), (0.5), (0.6), (0.7)) v(share) GROUP BY ALL)
SELECT share, qid, id, score, row_number() OVER (PARTITION BY share, qid ORDER BY score DESC, id)::INT AS rank FROM wf QUALIFY rank <= 10""")
def weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.weight_sweep(fusion.union_runs(*_runs(spark, sf)), "dense", "signs", top_k=10)


_MULTI = "WITH" + _DENSE + """, inner_ AS (SELECT qid, run, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT qid // 40 AS qid, CASE WHEN run = 'dense' THEN 'dense' ELSE 'sparse' END AS run, id, rank FROM runs) GROUP BY ALL),
again AS (SELECT *, row_number() OVER (PARTITION BY qid, run ORDER BY round(score, 9) DESC, id) AS rank FROM inner_),
fin AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM again GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM fin QUALIFY rank <= 20"""


@query(_MULTI)
def multi_query_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Two texts per question and two modalities: fused within, then across."""
    runs = fusion.union_runs(*_runs(spark, sf))
    number = query_number()
    rows = runs.select(F.floor(number / 2).alias("qid"), F.when(F.col("run") == "dense", "dense").otherwise("sparse").alias("modality"), (number % 2).alias("text_no"), "id", "rank")
    return fusion.two_stage(rows, top_k=20).drop("run")


@query("WITH" + _DENSE + """, src AS (SELECT qid, id, run, rank FROM runs WHERE rank <= 30 UNION ALL SELECT vec_id, (vec_id + 1), 'source', 0 FROM embeddings WHERE vec_id % 20 = 0),
be AS (SELECT qid, id, min(rank)::INT AS best, array_to_string(list_sort(list_distinct(list(run))), '+') AS found_by FROM src GROUP BY qid, id)
SELECT qid, id, best, found_by, row_number() OVER (PARTITION BY qid ORDER BY best, id)::INT AS position FROM be QUALIFY position <= 25""")
def pool_candidates(spark: SparkSession, sf: str) -> DataFrame:
    runs = fusion.union_runs(*_runs(spark, sf)).where("rank <= 30")
    extra = vector_queries(spark, sf).select("qid", (F.col("qid") + 1).alias("id"))
    return fusion.pool(runs, 25, extra).select("qid", "id", "best", "found_by", "position")


_VREL = ", rel AS (SELECT q.vec_id AS qid, d.vec_id AS id FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0), qs AS (SELECT vec_id AS qid, CASE label % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'temporal' ELSE 'entity' END AS query_class FROM embeddings WHERE vec_id % 20 = 0), own AS (SELECT qid, id, (rank - 1)::INT AS rank FROM dense WHERE qid <> id AND rank > 1),"


def _vector_eval(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(run, classes, relevant, counts). All rows of a query's label are relevant: a label is
    compared for what the run holds and counted for the rest, as those pairs grow by the square."""
    v = label_vectors(spark, sf)
    own = dense.search_batch(v, vector_queries(spark, sf), 100).where("qid <> id AND rank > 1").withColumn("rank", F.col("rank") - 1)
    own = materialise(own, "run")
    asked = v.where(EVERY.replace("vec_id", "id")).select(F.col("id").alias("qid"), "label")
    classes = asked.select("qid", F.element_at(F.array(F.lit("semantic"), F.lit("temporal"), F.lit("entity")), F.col("label") % 3 + 1).alias("query_class"))
    relevant = own.select("qid", "id").join(asked, "qid").join(v.select("id", "label"), ["id", "label"]).select("qid", "id")
    sizes = v.groupBy("label").agg((F.count_distinct("id") - 1).alias("n_relevant"))  # without the query itself
    return own, classes, relevant, asked.join(sizes, "label").select("qid", "n_relevant")


@query("WITH" + _DENSE + _VREL + _METRICS.format(run="own") + _SUMMARY)
def recall_mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    own, classes, relevant, counts = _vector_eval(spark, sf)
    return metrics.summary(metrics.per_query(own, classes, relevant, counts=counts))


@query("WITH" + _DENSE + _VREL + _METRICS.format(run="own") + " SELECT qid, query_class, n_relevant, found_at, round(recall_5, 6) AS recall_5, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM pq")
def per_query_found_at(spark: SparkSession, sf: str) -> DataFrame:
    own, classes, relevant, counts = _vector_eval(spark, sf)
    per = metrics.per_query(own, classes, relevant, counts=counts)
    return per.select("qid", "query_class", "n_relevant", "found_at", *[F.round(c, 6).alias(c) for c in ("recall_5", "rr", "ndcg")])


@query("WITH" + _DENSE + _VREL.rstrip(",") + " SELECT qid, (list(rank ORDER BY rank, id))[1:8] AS ranks FROM own JOIN rel USING (qid, id) GROUP BY qid")
def chunk_ranks(spark: SparkSession, sf: str) -> DataFrame:
    own, _, relevant, _ = _vector_eval(spark, sf)
    got = metrics.chunk_ranks(own, relevant, F.col("id"))
    return got.select("qid", F.transform("chunks", lambda c: c["rank"]).alias("ranks"))


@query("SELECT event_type, v[(least(floor(len(v) * 0.5), len(v) - 1) + 1)::INT] AS p50, v[(least(floor(len(v) * 0.95), len(v) - 1) + 1)::INT] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latency(table(spark, sf, "events"), ["event_type"], "value")


# -- reranking and display

_RERANK_K = 20


@query("WITH " + _LONG + "," + _bm25("texts") + rf""",
hd AS (SELECT bm.qid, bm.id, bm.rank, round(CASE WHEN len(q.t) = 0 THEN 0 ELSE len(list_intersect(q.t, {_TERMS.format(x="d.text")})) / len(q.t) END, 6) AS new
       FROM bm JOIN (SELECT item_id AS qid, {_TERMS.format(x="text")} AS t FROM benchmark) q USING (qid) JOIN documents d ON d.doc_id = bm.id WHERE bm.rank <= {_RERANK_K}
       UNION ALL SELECT qid, id, rank, NULL FROM bm WHERE rank > {_RERANK_K}),
pl AS (SELECT qid, id, new, row_number() OVER (PARTITION BY qid ORDER BY new DESC NULLS LAST, rank, id)::INT AS rank, min(new) OVER (PARTITION BY qid) AS lo, count(new) OVER (PARTITION BY qid) AS n FROM hd)
SELECT qid, id, coalesce(new, coalesce(lo, 0) - (rank - n)) AS score, rank FROM pl""")
def rerank_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = _questions(spark, sf)
    runs = lexical.bm25(docs, asked, DEPTH, keep_zero=False)
    return rerank.rerank(runs, asked, docs, _RERANK_K).drop("run")


_SCORED = "WITH " + _FIXED.format(stride=512) + ", texts AS (SELECT id, array_to_string(c, ' ') AS text FROM ch), " + _bm25("texts") + rf""",
hw AS (SELECT qid, id FROM bm WHERE rank <= {_RERANK_K}),
qw AS (SELECT qid, w, count(*) AS n FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '\w\w+')) AS w FROM benchmark) GROUP BY ALL),
pw AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '\w\w+')) AS w FROM texts WHERE id IN (SELECT id FROM hw)),
ms AS (SELECT qid, id, qw.w, n, max(jaccard(qw.w, pw.w)) AS s FROM hw JOIN qw USING (qid) JOIN pw USING (id) GROUP BY ALL),
sc AS (SELECT qid, id, round((sum(n * floor(s * 1000000)::BIGINT) // sum(n)) / 1000000, 6) AS new FROM ms GROUP BY ALL)"""


def _reranked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """BM25 over chunks, the head by the similarity of words; chunks are no longer than a scorer reads."""
    chunks, asked = _chunks(spark, sf), _questions(spark, sf)
    runs = materialise(lexical.bm25(chunks, asked, DEPTH, keep_zero=False), "run")
    return rerank.rerank_batched(runs, asked, chunks, _RERANK_K)


@query(_SCORED + """,
pl AS (SELECT qid, id, new, row_number() OVER (PARTITION BY qid ORDER BY new DESC NULLS LAST, rank, id)::INT AS rank, min(new) OVER (PARTITION BY qid) AS lo, count(new) OVER (PARTITION BY qid) AS n FROM bm LEFT JOIN sc USING (qid, id))
SELECT qid, id, coalesce(new, coalesce(lo, 0) - (rank - n)) AS score, rank FROM pl""")
def rerank_token_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf)[0].drop("run")


@query(_SCORED + " SELECT qid, count(*) AS passages, true AS timed FROM hw GROUP BY qid")
def rerank_times(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that the scorer read for each question, and whether its time was taken."""
    return _reranked(spark, sf)[1].select("qid", "passages", (F.col("ms") > 0).alias("timed"))


@query("WITH " + _FIXED.format(stride=512) + ", texts AS (SELECT id, array_to_string(c, ' ') AS text FROM ch), " + _bm25("texts") + f""",
g AS (SELECT qid, regexp_replace(id, ':[^:]*$', '') AS key, min(rank)::INT AS first_rank, list(id ORDER BY rank, id) AS chunk_ids FROM bm GROUP BY ALL)
SELECT qid, key, first_rank, row_number() OVER (PARTITION BY qid ORDER BY first_rank, key)::INT AS rank, chunk_ids FROM g QUALIFY rank <= {TOP}""")
def collapse_display(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _chunks(spark, sf)
    runs = lexical.bm25(chunks, _questions(spark, sf), DEPTH, keep_zero=False)
    return fusion.collapse_display(runs, key_of_chunk("id"), chunks, TOP).select("qid", "key", "first_rank", "rank", "chunk_ids")


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings WHERE abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-8")
def unit_norm_check(spark: SparkSession, sf: str) -> DataFrame:
    return dense.norm_problems(label_vectors(spark, sf), 1e-8).select("id", F.round("norm", 6).alias("norm"))


@query("SELECT vec_id AS id FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64")
def dimension_check(spark: SparkSession, sf: str) -> DataFrame:
    return dense.dimension_problems(label_vectors(spark, sf), 64).select("id")


@query()
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The index with codes against exact search at 20, and what it reads: at most a quarter of the vectors."""
    v, q = label_vectors(spark, sf), vector_queries(spark, sf)
    root = f"{shared_dir(spark)}/tables/vectors-{uuid.uuid4().hex}"
    vectorindex.build(v, root)
    short = min(vectorindex.REACH * 20, max(20, v.count() // 4))
    listed = materialise(vectorindex.short_list(spark, root, q, short), "short")
    found = materialise(vectorindex.search(spark, root, q, 20, listed=listed), "ann")
    recall = dense.ann_recall(dense.search_batch(v, q, 20), found)
    return recall.join(vectorindex.reading(spark, root, q, short, listed=listed), F.lit(True))


_TAXONOMY = "WITH" + _DENSE + _VREL.rstrip(",") + f""", fa AS (SELECT qid, min(rank) AS found_at FROM own JOIN rel USING (qid, id) GROUP BY qid),
nr AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
pq AS (SELECT q.qid, q.query_class, n, found_at, CASE WHEN q.qid // 20 % 5 = 0 THEN 'bad_label: by hand' ELSE '' END AS notes, CASE WHEN q.qid // 20 % 2 = 0 THEN 'pricing memo terms' END AS document FROM qs q JOIN nr USING (qid) LEFT JOIN fa USING (qid))
SELECT qid::VARCHAR AS query_id, CASE WHEN contains(notes, 'bad_label') THEN 'bad_label' WHEN query_class = 'temporal' THEN 'temporal' WHEN n > 1 THEN 'multi_hop' WHEN document IS NULL THEN 'vocabulary' ELSE 'ranking' END AS category
FROM pq WHERE found_at IS NULL OR found_at > 1"""


@query(_TAXONOMY)
def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    own, classes, relevant, counts = _vector_eval(spark, sf)
    per = metrics.per_query(own, classes, relevant, counts=counts)
    number = query_number()
    rows = per.where("n_relevant > 0").select(
        F.col("qid").cast("string").alias("query_id"), F.lit("pricing memo").alias("query"), "query_class", "n_relevant", "found_at", F.lit(None).cast("int").alias("best_chunk_rank"),
        F.when(number % 5 == 0, "bad_label: by hand").otherwise("").alias("notes"), F.when(number % 2 == 0, "pricing memo terms").alias("document"),
    )
    return misses(rows, k=1).select("query_id", "category")
