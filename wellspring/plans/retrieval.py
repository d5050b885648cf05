"""Retrieval queries over documents, benchmark and embeddings. Search queries are the ids divisible by 50."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .base import query

TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def bm25_sql(docs: str = "documents", queries: str = "benchmark", k: int = 10, name: str = "hits") -> str:
    """CTEs ending in ``name`` (item_id, doc_id, score, rank)."""
    return f"""
d AS (SELECT doc_id, {TOK.format('text')} AS t FROM {docs}),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
q AS (SELECT item_id, w, count(*) AS qtf FROM (SELECT item_id, unnest({TOK.format('text')}) AS w FROM {queries}) GROUP BY ALL),
p AS (SELECT doc_id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
f AS (SELECT w, count(*) AS df FROM p GROUP BY w),
s AS (SELECT item_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM p JOIN q USING (w) JOIN f USING (w), st GROUP BY item_id, doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k})"""


VEC = """
vq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
vs AS (SELECT query_id, vec_id AS id, round({0}, 6) AS score FROM vq, embeddings),
vhits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= 20)"""
DOT = "list_dot_product(q::DOUBLE[], embedding::DOUBLE[])"


@query("bm25_topk", f"WITH {bm25_sql()} SELECT item_id, doc_id, score, rank FROM hits")
def bm25_topk(t):
    return R.bm25(t("documents"), t("benchmark"))


@query("bm25_index_stats", f"WITH d AS (SELECT {TOK.format('text')} AS t FROM documents) SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_tokens, round(avg(len(t)), 2) AS avg_length, (SELECT count(DISTINCT w) FROM (SELECT unnest(t) AS w FROM d)) AS vocabulary FROM d")
def bm25_index_stats(t):
    return R.index_stats(t("documents"))


@query("bm25_delete_recompute", f"WITH kept AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {bm25_sql('kept')} SELECT item_id, doc_id, score, rank FROM hits")
def bm25_delete_recompute(t):
    gone = t("labels").filter("toxic = 1")
    return R.bm25(R.delete_documents(t("documents"), gone), t("benchmark"))


@query("bm25_replace_upsert", f"WITH new AS (SELECT item_id AS doc_id, text FROM benchmark), up AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new), {bm25_sql('up')} SELECT item_id, doc_id, score, rank FROM hits")
def bm25_replace_upsert(t):
    new = t("benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return R.bm25(R.upsert(t("documents").select("doc_id", "text"), new, "doc_id"), t("benchmark"))


@query("vector_topk", f"WITH {VEC.format(DOT)} SELECT query_id, id, score, rank FROM vhits")
def vector_topk(t):
    e = t("embeddings")
    return R.vector_search(e, e.filter("vec_id % 50 = 0"))


@query("vector_l2_topk", f"WITH {VEC.format('1 - list_distance(q::DOUBLE[], embedding::DOUBLE[])')} SELECT query_id, id, score, rank FROM vhits")
def vector_l2_topk(t):
    e = t("embeddings")
    return R.vector_search(e, e.filter("vec_id % 50 = 0"), metric="l2")


@query("vector_min_score", f"WITH {VEC.format(DOT)} SELECT query_id, id, score, rank FROM vhits WHERE score >= 0.5")
def vector_min_score(t):
    e = t("embeddings")
    return R.vector_search(e, e.filter("vec_id % 50 = 0"), min_score=0.5)


#: BM25 and vector lists over a shared id space: benchmark items and vectors are queries by id, documents and vectors results by id.
BOTH = f"{bm25_sql(k=20)}, {VEC.format(DOT)}, l AS (SELECT item_id AS q, doc_id AS d, rank FROM hits), v AS (SELECT query_id AS q, id AS d, rank FROM vhits)"
FUSED = f"{BOTH}, fu AS (SELECT coalesce(l.q, v.q) AS q, coalesce(l.d, v.d) AS d, round(coalesce(0.5 / (60 + l.rank), 0) + coalesce(0.5 / (60 + v.rank), 0), 9) AS score FROM l FULL JOIN v ON l.q = v.q AND l.d = v.d)"
RANKED = f"{FUSED}, ra AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM fu), pg AS (SELECT ra.*, source AS page FROM ra LEFT JOIN documents ON d = doc_id)"
DIVERSE = f"{RANKED}, di AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, coalesce(nullif(page, ''), CAST(d AS VARCHAR)) ORDER BY rank) AS n FROM pg) WHERE n <= 2)"


def _lists(t):
    e = t("embeddings")
    a = R.bm25(t("documents"), t("benchmark"), k=20).select(F.col("item_id").alias("q"), F.col("doc_id").alias("d"), "rank")
    b = R.vector_search(e, e.filter("vec_id % 50 = 0")).select(F.col("query_id").alias("q"), F.col("id").alias("d"), "rank")
    return a, b, t("documents").select(F.col("doc_id").alias("d"), F.col("source").alias("page"))


@query("rrf_fusion", f"WITH {FUSED} SELECT q, d, score FROM fu")
def rrf_fusion(t):
    a, b, _ = _lists(t)
    return R.rrf([a, b])


@query("page_diversity", f"WITH {DIVERSE} SELECT q, d, score, rank, page FROM di")
def page_diversity(t):
    a, b, pages = _lists(t)
    order = F.row_number().over(R.Window.partitionBy("q").orderBy(F.desc("score"), "d")).cast("bigint")
    return R.diversify(R.rrf([a, b]).withColumn("rank", order).join(pages, "d", "left"), "page").select("q", "d", "score", "rank", "page")


@query("hybrid_search", f"WITH {DIVERSE}, fi AS (SELECT q, d, score, page, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM di) SELECT q, d, score, page, rank FROM fi WHERE rank <= 10")
def hybrid_search(t):
    return R.hybrid(*_lists(t)).select("q", "d", "score", "page", "rank")
