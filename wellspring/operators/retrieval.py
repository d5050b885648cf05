"""Retrieval: BM25, exact vector search, rank fusion and page diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokenize

K1, B = 1.5, 0.75
RRF_K = 60
BROADCAST_TOKENS = 1_000_000
DENSE_CELLS = 4_000_000  # query words x queries of a weight table that each task holds
QUERY_BLOCK = 4096  # queries a scan of the vectors
TILE = 1024  # queries and vectors of one product


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast df if it has at most ``rows`` rows; else leave the join to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def index_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, tokens, mean length and vocabulary size."""
    t = docs.select(tokenize(F.col(text_col)).alias("t"))
    sizes = t.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("t")).cast("bigint").alias("n_tokens"), F.round(F.avg(F.size("t")), 2).alias("avg_length"))
    words = t.select(F.explode("t").alias("w")).distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
    return sizes.join(F.broadcast(words))  # one row each


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, min_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text", qid: str = "item_id", qtext: str = "text") -> DataFrame:
    """(qid, doc id, score, rank): top k by score, then those above min_score.

    A repeated query word counts as often as it occurs. Only query words leave the scan: postings are
    cut down by a semi join with the queries' words before any shuffle. Where the queries are few and ids are
    told apart, rows are scored where they are (bm25_rows); else postings are joined.
    """
    q = queries.select(F.col(qid).alias("_q"), F.explode(tokenize(F.col(qtext))).alias("w")).groupBy("_q", "w").agg(F.count(F.lit(1)).alias("qtf"))
    few = q.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS  # then so are its words, and its join with df
    if few and k > 0 and isinstance(docs.schema[id_col].dataType, T.LongType):
        size = q.agg(F.count_distinct("w"), F.count_distinct("_q")).first()
        clash = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
        if size[0] * size[1] <= DENSE_CELLS and not clash.limit(1).count():
            s = bm25_rows(docs.select(F.col(id_col).alias("_d"), tokenize(F.col(text_col)).alias("t")), q, k)
            return top_k(s, "_q", "_d", k).filter(F.col("score") >= min_score).select(F.col("_q").alias(qid), F.col("_d").alias(id_col), "score", "rank")
    hint = F.broadcast if few else (lambda d: d)
    words = hint(q.select("w").distinct())
    d = docs.select(F.col(id_col).alias("_d"), tokenize(F.col(text_col)).alias("t")).withColumn("dl", F.size("t"))
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    post = d.select("_d", "dl", F.explode("t").alias("w")).join(words, "w", "left_semi").groupBy("_d", "dl", "w").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    scored = post.join(hint(q.join(df, "w")), "w").join(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    term = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    s = scored.groupBy("_q", "_d").agg(F.round(F.sum(term), 6).alias("score"))
    return top_k(s, "_q", "_d", k).filter(F.col("score") >= min_score).select(F.col("_q").alias(qid), F.col("_d").alias(id_col), "score", "rank")


def bm25_rows(docs: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """docs (_d bigint, t) of unlike ids, q (_q, w, qtf) of bounded size -> (_q, _d, score): at least the k best of each query.

    A document's words are counted and scored where its row is; a task keeps the k best of each query, so the shuffle carries
    neither postings nor scores of all pairs.
    """
    spark = docs.sparkSession
    kind = q.schema["_q"].dataType.simpleString()
    rows = q.toArrow()
    words = pc.unique(rows["w"])
    own = rows["_q"].combine_chunks().dictionary_encode()
    ids, at = own.dictionary, own.indices.to_numpy(zero_copy_only=False)
    word, qtf = pc.index_in(rows["w"], value_set=words).to_numpy(), rows["qtf"].to_numpy()
    shared = spark.sparkContext.broadcast(words)

    def postings(batch: pa.RecordBatch, col: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows in small parts, with their lengths and each (row, word, count)."""
        for i in range(0, batch.num_rows, TILE // 2):
            part = batch.slice(i, TILE // 2)
            n = pc.list_value_length(part.column(col)).to_numpy(zero_copy_only=False).astype(np.int64)
            w = pc.index_in(part.column(col).flatten(), value_set=shared.value)
            there = w.is_valid().to_numpy(zero_copy_only=False)
            cell = np.repeat(np.arange(len(n)), n)[there] * len(shared.value) + w.drop_null().to_numpy()
            cell, tf = np.unique(cell, return_counts=True)
            yield part, n, cell // len(shared.value), cell % len(shared.value), tf

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(shared.value), dtype=np.int64), 0, 0
        for batch in batches:
            for _, size, _, w, _ in postings(batch, 0):
                df += np.bincount(w, minlength=len(df))
                n, total = n + len(size), total + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(df))), pa.array(np.concatenate([[n, total], df]))], names=["w", "n"])

    sums = docs.select("t").mapInArrow(counted, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(len(words) + 2, dtype=np.int64)
    found[sums["w"].to_numpy() + 2] = sums["n"].to_numpy()
    n, df = int(found[0]), found[2:]
    avgdl = found[1] / n if n else 0.0
    table = np.zeros((len(words), len(ids)))
    table[word, at] = qtf * np.log((n - df[word] + 0.5) / (df[word] + 0.5) + 1)
    weights = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        top = Top(table.shape[1], k)
        for batch in batches:
            for part, size, row, w, tf in postings(batch, 1):
                x = np.zeros((len(size), table.shape[0]))
                x[row, w] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / (avgdl or 1.0)))
                s = (x @ table).T
                top.add(np.where(s > 0, np.round(s, 6), -np.inf), part.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(top.query)), pa.array(top.id), pa.array(top.score)], names=["_q", "_d", "score"])

    return docs.select("_d", "t").mapInArrow(run, f"_q {kind}, _d bigint, score double")


def top_k(scores: DataFrame, q: str, d: str, k: int) -> DataFrame:
    """The k best rows of each query with rank; ties by id."""
    r = F.row_number().over(Window.partitionBy(q).orderBy(F.desc("score"), d))
    return scores.withColumn("rank", r.cast("bigint")).filter(F.col("rank") <= k)


def delete_documents(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the ids in gone; the index is recomputed from what stays."""
    return docs.join(gone.select(id_col), id_col, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 20, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding", min_score: float | None = None) -> DataFrame:
    """(query_id, id, score, rank) by exact search; null vectors are skipped.

    score is the dot product of unit vectors, or 1 - Euclidean distance. Queries are broadcast in
    blocks of QUERY_BLOCK; each task keeps its own k best of a block, and products are made in tiles of
    TILE x TILE, so a task's memory depends on neither the rows nor the queries.
    """
    out = None
    block: list = []

    def search(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block], dtype=np.int64)
        q = np.array([r[1] for r in block], dtype=np.float64)
        b = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = b.value
            tops = [Top(len(q[i : i + TILE]), k) for i in range(0, len(q), TILE)]
            for batch in batches:
                for j in range(0, batch.num_rows, TILE):
                    part = batch.slice(j, TILE)
                    own = part.column(0).to_numpy()
                    v = part.column(1).flatten().to_numpy().astype(np.float64).reshape(len(own), -1)
                    for i, top in enumerate(tops):
                        top.add(scores(q[i * TILE : (i + 1) * TILE], v, metric), own)
            for i, top in enumerate(tops):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i * TILE + top.query]), pa.array(top.id), pa.array(top.score)], names=["query_id", "id", "score"])

        return vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "query_id bigint, id bigint, score double")

    for r in queries.filter(F.col(vec_col).isNotNull()).select(id_col, vec_col).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == QUERY_BLOCK:
            out, block = (search(block) if out is None else out.unionByName(search(block))), []
    if block or out is None:
        more = search(block) if block else vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double")
        out = more if out is None else out.unionByName(more)
    top = top_k(out, "query_id", "id", k)
    return top if min_score is None else top.filter(F.col("score") >= min_score)


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores of each query with each vector, to six decimals."""
    s = q @ v.T
    if metric == "l2":
        s = 1 - np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * s, 0))
    return np.round(s, 6)


class Top:
    """The k best (query, id, score) of each of n queries, ties by id, of all tiles added."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)  # the k-th best score so far
        self.query, self.id, self.score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        """s (queries x ids)."""
        bar = self.least
        if s.shape[1] > self.k and np.isneginf(self.least).any():
            bar = np.maximum(bar, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        at, col = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
        if not len(at):
            return
        query, own, score = np.concatenate([self.query, at]), np.concatenate([self.id, ids[col]]), np.concatenate([self.score, s[at, col]])
        order = np.lexsort((own, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[rank < self.k]
        self.id, self.score = own[kept], score[kept]
        self.query = query[rank < self.k]
        self.least[query[rank == self.k - 1]] = score[order[rank == self.k - 1]]


def rrf(rankings: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """rankings (q, d, rank) -> (q, d, score): sum of w / (k + rank), weights scaled to sum 1."""
    w = weights or [1.0] * len(rankings)
    parts = [r.select("q", "d", (F.lit(x / sum(w)) / (k + F.col("rank"))).alias("part")) for r, x in zip(rankings, w)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("q", "d").agg(F.round(F.sum("part"), 9).alias("score"))


def diversify(ranked: DataFrame, page: str, most: int = 2) -> DataFrame:
    """At most ``most`` results of one page (the id, where the page is null or empty) a query, in rank order; 0 keeps all."""
    if most <= 0:
        return ranked
    key = F.coalesce(F.nullif(F.col(page), F.lit("")), F.col("d").cast("string"))
    n = F.row_number().over(Window.partitionBy("q", key).orderBy("rank"))
    return ranked.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def hybrid(bm25_hits: DataFrame, vector_hits: DataFrame, pages: DataFrame, limit: int = 10, most: int = 2, min_score: float = 0.0) -> DataFrame:
    """Fuse two ranked lists (q, d, rank), keep pages diverse, cut by score, then the top ``limit``."""
    fused = rrf([bm25_hits, vector_hits], [0.5, 0.5])
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "d"))
    ranked = fused.withColumn("rank", order).join(pages, "d", "left")
    kept = diversify(ranked, "page", most).filter(F.col("score") >= min_score)
    again = F.row_number().over(Window.partitionBy("q").orderBy("rank"))
    return kept.withColumn("rank", again.cast("bigint")).filter(F.col("rank") <= limit)
