"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over block-max inverted lists.

The index holds at most ``MAX_EXAMPLES`` labelled training documents of at most ``MAX_CHARS`` characters in
all, taken in seeded hash order (a documented bound on labelled rows), and every term of theirs. A
term's weight is the difference of its inverse document frequencies in the two classes (delta TF-IDF), smoothed
towards none and never 0; the document frequencies come from every labelled training document. Under plain
idf the cosine of a long text is ruled by words that say nothing about the label.

The inverted lists are cut into blocks of ``BLOCK`` examples with each term's largest weight per block:
blocks are searched in falling order of their bound until the k-th best cosine cannot be
beaten, so the neighbours are exactly those of a full scan (ties: lower example first). The most frequent
terms stand in a table, whose part of the cosines is one matrix product for ``TILE`` texts.

Votes are weighted by cosine and calibrated by a logistic curve fitted to the examples' own
leave-one-out votes. The neighbours' ids are the evidence. Texts are scored whole, in one scan.

Defined results: a text without any index term (null and empty ones too) gets the share of label 1
among training documents and no neighbours; a null doc_id is scored and never an example; labels without a
document or with a null label are unused, repeated ones count once by their largest; of rows that share a labelled
doc_id, the one of least text hash can be an example; no labels of either class give every text the
share of label 1 (0.0 without labels); repeated rows score alike; an empty table gives an empty result; very long
texts cost their distinct terms; other columns of docs are left out of the result, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

TERM = re.compile(r"[^\W\d_]+")
MAX_EXAMPLES, MAX_CHARS, BLOCK, DENSE, K = 8192, 64_000_000, 128, 512, 15
TILE, NEAR = 64, 2e-5  # texts scored together; more than single precision moves a cosine
SMOOTH, LEAST = 5.0, 0.01
LABEL_ROWS = 1_000_000
SPACED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def words(text: str) -> list[str]:
    """What TERM finds in a text, sooner: all else becomes spaces."""
    if not text.isascii():
        odd = [c for c in set(text) if c > "\x7f" and (not c.isalnum() or c.isdecimal())]
        if len(odd) > 32:
            return TERM.findall(text)
        for c in odd:
            text = text.replace(c, " ")
    return text.encode().translate(SPACED).decode().split()


def term_freqs(text: str | None) -> Counter:
    return Counter(words(text.lower())) if text else Counter()


def remainder(doc: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % mod, F.lit(1))


def term_counts(train: DataFrame) -> DataFrame:
    """train (text, y) -> (term, pos, neg): documents of each label that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c):
            own = list(c[0] | c[1])
            return pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([c[1][t] for t in own], pa.int64()), pa.array([c[0][t] for t in own], pa.int64())], names=["term", "pos", "neg"])

        c = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                c[y].update(term_freqs(t.as_py()).keys())
                if len(c[0]) + len(c[1]) > 400_000:
                    yield out(c)
                    c = (Counter(), Counter())
        yield out(c)

    return train.mapInArrow(run, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def weights_of(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Smoothed difference of the two class idfs of terms held by pos and neg documents."""
    share = n_pos / (n_pos + n_neg)
    ratio = (pos + SMOOTH * share) / (neg + SMOOTH * (1 - share)) * (n_neg / n_pos)
    return np.maximum(np.abs(np.log(ratio)), LEAST)


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges lo[i]..hi[i] - 1 in order, and how many each has."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n), n


class Index:
    """Unit vectors of examples: an inverted index with block maxima, and a dense table of the most frequent terms.

    Postings lie in order of term, then example; an entry is one term's run of postings in one block. The
    ``dense`` terms of most postings stand in a table (examples x terms) instead of lists: a matrix product gives
    their part of every cosine, and its largest in a block enters the block's bound.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, n_terms: int, block: int = BLOCK, dense: int = DENSE):
        self.ids, self.labels, self.block = np.asarray(ids, dtype=np.int64), np.asarray(labels, dtype=np.float64), block
        n, self.blocks = len(ids), max(1, -(-len(ids) // block))
        own = np.lexsort((term, example))
        self.vector = (term[own].astype(np.int32), weight[own].astype(np.float32), np.searchsorted(example[own], np.arange(n + 1)))
        del own
        often = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:dense]
        self.column = np.full(n_terms, -1, dtype=np.int32)
        self.column[often] = np.arange(len(often))
        col = self.column[term]
        self.table = np.zeros((self.blocks * block, len(often)), dtype=np.float32)
        self.table[example[col >= 0], col[col >= 0]] = weight[col >= 0]
        example, term, weight = example[col < 0], term[col < 0], weight[col < 0]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order].astype(np.float32)
        key = term[order].astype(np.int64) * self.blocks + self.example // block
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.at = np.append(first, len(key)).astype(np.int32)  # postings of entry e: at[e] to at[e + 1]
        self.in_block = (key[first] % self.blocks).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.entry = np.searchsorted(key[first] // self.blocks, np.arange(n_terms + 1)).astype(np.int32)

    def spread(self, terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Weights q of the terms that stand in the table, by column."""
        col = self.column[terms]
        qd = np.zeros(self.table.shape[1], dtype=np.float32)
        qd[col[col >= 0]] = q[col >= 0]
        return qd

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, but: int = -1, common: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest positive cosine (to six decimals) with weights q of terms (all, if fewer), best first, without example ``but``.

        common: spread(), its product with the table and the largest of each block, if known.
        """
        if not len(terms) or not len(self.ids):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        if common is None:
            qd = self.spread(terms, q)
            part = self.table @ qd
            common = qd, part, part.reshape(self.blocks, self.block).max(axis=1)
        qd, part, peak = common
        rare = self.column[terms] < 0
        e, n = ranges(self.entry[terms[rare]], self.entry[terms[rare] + 1])
        qe, blk = np.repeat(q[rare], n), self.in_block[e]
        bound = np.bincount(blk, qe * self.top[e], minlength=self.blocks) + peak + 1e-5
        order = np.argsort(-bound, kind="stable")
        listed, about, least = np.zeros(len(self.table)), np.full((self.blocks, self.block), -1.0), 1e-12
        for now in (order[:8], order[8:]):
            now = now[bound[now] >= least]
            if not len(now):
                break
            if 4 * len(now) > self.blocks:  # a term's run over all blocks is read sooner than most of its pieces
                listed, (p, m), qp = np.zeros(len(listed)), ranges(self.at[self.entry[terms[rare]]], self.at[self.entry[terms[rare] + 1]]), q[rare]
            else:
                some = np.zeros(self.blocks, dtype=bool)
                some[now] = True
                use = some[blk]
                (p, m), qp = ranges(self.at[e[use]], self.at[e[use] + 1]), qe[use]
            listed += np.bincount(self.example[p], np.repeat(qp, m) * self.weight[p], minlength=len(listed))
            about[now] = listed.reshape(about.shape)[now] + part.reshape(about.shape)[now]
            if but >= 0:
                about[but // self.block, but % self.block] = -1.0
            open_ = np.flatnonzero(about >= least)
            if len(open_) > k:
                s = about.ravel()[open_]
                least = max(least, np.partition(s, len(s) - k)[len(s) - k] - NEAR)
                open_ = open_[s >= least]
        s = np.round(listed[open_] + np.einsum("nc,c->n", self.table[open_], qd), 6)  # of those that may be among the k
        open_, s = open_[s > 0], s[s > 0]
        first = np.lexsort((open_, -s))[:k]
        return open_[first], s[first]

    def vote(self, terms: np.ndarray, q: np.ndarray, k: int, but: int = -1, common: tuple | None = None) -> tuple[float | None, np.ndarray]:
        """The cosine-weighted share of label 1 among the nearest, shrunk by a light vote at the mean; their indexes."""
        i, s = self.nearest(terms, q, k, but, common)
        if not len(i):
            return None, i
        return float((s @ self.labels[i] + 0.05 * self.labels.mean()) / (s.sum() + 0.05)), i

    def votes(self, queries: Iterator[tuple[np.ndarray, np.ndarray, int]], k: int) -> Iterator[tuple[float | None, np.ndarray]]:
        """vote() of each (terms, weights, but), TILE at a time."""
        queries = iter(queries)
        while tile := list(islice(queries, TILE)):
            qd = np.stack([self.spread(t, q) for t, q, _ in tile])
            part = qd @ self.table.T
            peak = part.reshape(len(tile), self.blocks, self.block).max(axis=2)
            for (t, q, but), *common in zip(tile, qd, part, peak):
                yield self.vote(t, q, k, but, tuple(common))


_indexes: list[tuple[tuple, Index]] = []
_numbers: list[tuple[pa.Array, dict[str, int]]] = []


def index_of(examples: tuple) -> Index:
    """The Python worker's index of the broadcast examples, made by its first task; the driver makes none."""
    if not _indexes or _indexes[0][0] is not examples:
        _indexes[:] = [(examples, Index(*examples))]
    return _indexes[0][1]


def number_of(names: pa.Array) -> dict[str, int]:
    """The Python worker's number by term, made by its first task that scores."""
    if not _numbers or _numbers[0][0] is not names:
        _numbers[:] = [(names, dict(zip(names.to_pylist(), range(len(names)))))]
    return _numbers[0][1]


def unit(terms: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """TF-IDF weights of one text over index terms, of length 1."""
    w = (1 + np.log(tf)) * weight[terms]
    return w / np.sqrt(w @ w) if len(w) else w


def numbered(c: Counter, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Index terms of a text in order, and how often each occurs."""
    t = np.fromiter(map(number.get, c, repeat(-1)), dtype=np.int64, count=len(c))
    tf = np.fromiter(c.values(), dtype=np.int64, count=len(c))
    order = np.argsort(t, kind="stable")[int((t < 0).sum()) :]
    return t[order], tf[order]


def logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the probability of label 1 by vote, with Platt's softened targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, b = np.stack([v, np.ones_like(v)], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * b)
        b += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    if b[0] < 0:  # votes that tell nothing
        return 0.0, float(np.log(t.mean() / (1 - t.mean())))
    return float(b[0]), float(b[1])


def examples_of(docs: DataFrame, y: DataFrame, max_examples: int, max_chars: int) -> DataFrame:
    """(doc_id, h, y): the labelled rows that the index holds; h is the text's hash."""
    known = docs.filter(F.length("text") > 0).join(scratch.small(y, LABEL_ROWS), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), "y")
    one = known.groupBy("doc_id").agg(F.min(F.struct("h", "n", "y")).alias("x")).select("doc_id", "x.h", "x.n", "x.y")
    own, size = [], 0
    for r in one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples).collect():
        if size + r["n"] <= max_chars:
            own.append((r["doc_id"], r["h"], r["y"]))
            size += r["n"]
    return docs.sparkSession.createDataFrame(own, "doc_id bigint, h bigint, y int")


def spelled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, y, term, tf) of the chosen examples, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, y, t in zip(b.column(0), b.column(1), b.column(2)):
                c = term_freqs(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(c), pa.int64()), pa.array([y.as_py()] * len(c), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int32())], names=["doc_id", "y", "term", "tf"])

    own = docs.join(F.broadcast(chosen), "doc_id").filter(F.xxhash64("text") == F.col("h")).select("doc_id", "y", "text")
    rows = own.mapInArrow(run, "doc_id bigint, y int, term string, tf int")
    return rows.groupBy("doc_id", "term").agg(F.max("y").alias("y"), F.max("tf").alias("tf"))  # rows of one id and text are one example


def build(docs: DataFrame, y: DataFrame, max_examples: int, max_chars: int) -> tuple[tuple, pa.Array, np.ndarray, float]:
    """What Index takes, its terms and their weights, and the share of label 1 among training documents."""
    spark = docs.sparkSession
    train = docs.join(scratch.small(y, LABEL_ROWS), "doc_id").select("text", "y")
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    none = np.zeros(0, dtype=np.int64)
    if not pos or not neg:
        return (none, none, none.astype(float), none, none, 0), pa.array([], pa.string()), np.zeros(0), pos / max(pos + neg, 1)
    post = scratch.table(spelled(docs, examples_of(docs, y, max_examples, max_chars)), "examples")
    # the driver gets the terms and postings of the index alone, bounded by max_chars
    terms = term_counts(train).join(post.select("term").distinct(), "term", "left_semi").toArrow().sort_by("term")
    names, weight = terms["term"].combine_chunks(), weights_of(terms["pos"].to_numpy(), terms["neg"].to_numpy(), pos, neg)
    number = spark.createDataFrame(pa.table({"term": names, "t": pa.array(np.arange(len(names), dtype=np.int32))}))
    rows = post.join(number, "term").select("doc_id", F.col("y").cast("tinyint").alias("y"), "t", "tf").toArrow()
    ids, e = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
    labels = np.zeros(len(ids))
    labels[e] = rows["y"].to_numpy()
    t, tf = rows["t"].to_numpy(), rows["tf"].to_numpy()
    del rows
    order = np.argsort(e.astype(np.int64) * len(names) + t)
    e, t, w = e[order].astype(np.int32), t[order], ((1 + np.log(tf[order])) * weight[t[order]]).astype(np.float32)
    del order, tf
    at = np.flatnonzero(np.diff(e, prepend=-1))
    w /= np.sqrt(np.add.reduceat(w * w, at))[e]
    best = np.flatnonzero(w == np.maximum.reduceat(w, at)[e])
    lead = t[best[np.unique(e[best], return_index=True)[1]]]  # like by like, for sharp block bounds: examples in order of their weightiest term
    seat = np.lexsort((ids, lead))
    rank = np.empty(len(ids), dtype=np.int32)
    rank[seat] = np.arange(len(ids))
    return (rank[e], t, w, ids[seat], labels[seat], len(names)), names, weight, pos / (pos + neg)


def score(docs: DataFrame, labels: DataFrame, mod: int = 5, k: int = K, max_examples: int = MAX_EXAMPLES, max_chars: int = MAX_CHARS) -> DataFrame:
    """docs (doc_id bigint, text), labels (doc_id, y int) -> (doc_id, held_out, score, predicted, neighbours).

    Labels are learned only from rows whose remainder() is not 0.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    y = labels.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), mod) != 0))
    y = scratch.table(y.groupBy("doc_id").agg(F.max("y").cast("int").alias("y")), "labels")
    examples, names, weight, prior = build(docs, y, max_examples, max_chars)
    b = spark.sparkContext.broadcast((examples, names, weight))  # bounded by max_examples and max_chars
    label_of, examples = np.asarray(examples[4], dtype=np.float64), None  # the driver keeps no copy

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(b.value[0])
        term, weight, cut = index.vector
        for batch in batches:
            own = batch.column(0).to_pylist()
            v = [x for x, _ in index.votes(((term[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]], i) for i in own), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.float64())], names=["i", "v"])

    parts = spark.sparkContext.defaultParallelism
    own = spark.range(0, len(label_of), 1, parts).mapInArrow(own_votes, "i bigint, v double").filter("v is not null").toArrow()
    slope, level = logistic(own["v"].to_numpy(), label_of[own["i"].to_numpy()]) if own.num_rows else (0.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, names, weight = b.value
        index = index_of(examples)
        number = number_of(names)

        def query(t: pa.Scalar) -> tuple[np.ndarray, np.ndarray, int]:
            terms, tf = numbered(term_freqs(t.as_py()), number)
            return terms, unit(terms, tf, weight), -1

        for batch in batches:
            out, near = [], []
            for v, i in index.votes(map(query, batch.column(2)), k):
                out.append(prior if v is None else float(1 / (1 + np.exp(-(slope * v + level)))))
                near.append(index.ids[i].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32()), pa.array(near, pa.list_(pa.int64()))], names=["doc_id", "held_out", "score", "predicted", "neighbours"])

    held = (remainder(F.col("doc_id"), mod) == 0).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, neighbours array<bigint>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents, and the neighbours as evidence."""
    docs = scratch.docs_of(spark, sf_dir).select("doc_id", "text")
    labels = scratch.docs_of(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    return score(docs, labels)
