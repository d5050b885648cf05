"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives (documents labelled 1) and unlabelled web text (every training document, whatever its label) are all
that is learned from: labels of 0 are never read. The class prior is the share of positives in the unlabelled text; it is
estimated first: a classifier of trusted against unlabelled ranks the texts on one half of the rows, and on the other half every set of
the best ranked bounds the prior from above by its share of the unlabelled over its share of the trusted rows; the least such bound, with
its sampling error added, is the estimate. The quality model is a logistic one; its risk is
``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``: where its second part, an estimate of the negatives' risk, would fall below 0
(seen as a running mean over steps), that part has no gradient.

Features are computed once, in one scan of the whole texts, and written as packed numbers: pairs of neighbouring character kinds (letters by case,
digits, other scripts, white space, each ASCII sign for itself), hashed lower-case words, and surface statistics
(length, repetition, letter case, digits, signs, lines) as hat functions over fixed knots. Training rows are dealt to
``BUCKETS`` parts by hash; a step takes the gradient over all rows of one part, summed over the cluster by dimension, so what the
driver gets is the model's size whatever the corpus. All labelled rows and all unlabelled rows take part in each round.

Defined results: null and empty texts have the features of no words and are scored; a null doc_id is scored, and never trusted but unlabelled like any
other; labels without a document, null labels and repeated labels change nothing (a doc_id is trusted if any of its labels is 1);
repeated rows score alike and each counts in training; without trusted rows every score is 0.5; an empty table gives an empty result; very
long texts cost one pass over their characters and words; other columns of docs are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

BUCKETS, RANK_ROUNDS, ROUNDS, RATE, DECAY = 8, 3, 5, 0.1, 1e-4
PAIR_SCALE, WORD_SCALE, SURFACE_SCALE = 4.0, 0.2, 2.0
MEMORY = 0.75  # of the running mean of the negatives' risk
WORDS = 1024
BINS = 512
LABEL_ROWS = 1_000_000
FEATURES = "doc_id bigint, held_out boolean, part int, at binary, value binary"

#: Character kinds: 0 other scripts, 1 upper, 2 lower, 3 digit, 4 blank, 5 line end, then each ASCII sign.
KIND = np.zeros(256, dtype=np.int64)
KIND[ord("A") : ord("Z") + 1] = 1
KIND[ord("a") : ord("z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 3
KIND[:33] = 4
KIND[[10, 13]] = 5
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
KIND[_SIGNS] = np.arange(6, 6 + len(_SIGNS))
KINDS = 6 + len(_SIGNS)
PAIRS = KINDS * KINDS

#: Knots of the hat functions of each statistic of stats().
SHARES = (0.0, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0)
KNOTS = [
    (0.0, 0.7, 1.2, 1.7, 2.2, 2.7, 3.2, 3.7, 4.5),  # log10 of words
    (0.0, 0.2, 0.4, 0.55, 0.7, 0.8, 0.88, 0.94, 1.0),  # log distinct words over log words
    SHARES, SHARES, SHARES, SHARES, SHARES, SHARES,  # like neighbours, repeated lines, upper case, digits, signs, longest line
    (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.5, 8.0, 12.0, 20.0),  # mean word length
    (0.0, 1.0, 1.5, 2.0, 3.0, 4.0),  # log10 of 1 + longest word
]
FIRST = np.cumsum([0, *map(len, KNOTS)])
SIZE = PAIRS + WORDS + int(FIRST[-1]) + 1  # and a constant


def stats(raw: bytes, words: list[bytes], counts: np.ndarray, distinct: int) -> list[float]:
    """Surface statistics of one text in the order of KNOTS; counts: characters of each kind."""
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters, shown = counts[1] + counts[2] + counts[0], max(1, int(counts.sum() - counts[4] - counts[5]))
    return [
        np.log10(1 + n),
        np.log(distinct) / np.log(n) if n > 1 else 1.0,
        sum(map(eq, words, words[1:])) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        counts[1] / max(1, letters),
        counts[3] / shown,
        counts[6:].sum() / shown,
        max(map(len, lines)) / len(raw) if lines else 0.0,
        sum(map(len, words)) / n if n else 0.0,
        np.log10(1 + max(map(len, words))) if n else 0.0,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's features, places rising."""
    raw = (text or "").encode()
    kind = KIND[np.frombuffer(raw, dtype=np.uint8)]
    pair = np.bincount(kind[:-1] * KINDS + kind[1:], minlength=PAIRS) if len(kind) > 1 else np.zeros(PAIRS, dtype=np.int64)
    words = raw.split()
    held = Counter(raw.lower().split())
    at = np.flatnonzero(pair)
    value = PAIR_SCALE * np.sqrt(pair[at] / max(1, len(kind) - 1))
    slot: dict[int, float] = {}
    for w, k in held.items():
        h = crc32(w)
        i = PAIRS + h % WORDS
        slot[i] = slot.get(i, 0.0) + (k if h & 0x80000000 else -k)
    own = np.array(sorted(slot), dtype=np.int64)
    v = np.array([slot[i] for i in own.tolist()])
    v = np.sign(v) * np.sqrt(np.abs(v))
    v *= WORD_SCALE / max(1.0, float(np.sqrt(v @ v)))
    surface_at, surface = [], []
    for x, knots, first in zip(stats(raw, words, np.bincount(kind, minlength=KINDS), len(held)), KNOTS, FIRST):
        x = min(max(x, knots[0]), knots[-1])
        i = min(int(np.searchsorted(knots, x, side="right")) - 1, len(knots) - 2)
        right = (x - knots[i]) / (knots[i + 1] - knots[i])
        surface_at += [PAIRS + WORDS + first + i, PAIRS + WORDS + first + i + 1]
        surface += [SURFACE_SCALE * (1 - right), SURFACE_SCALE * right]
    at = np.concatenate([at, own, surface_at, [SIZE - 1]])
    value = np.concatenate([value, v, surface, [1.0]])
    some = value != 0
    return at[some].astype(np.uint16), value[some].astype(np.float16)


def vectors(docs: DataFrame, held_out: Column) -> DataFrame:
    """docs (doc_id, text) -> FEATURES; part: the training part of a row, from its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(3)]
            packed = [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *packed], names=["doc_id", "held_out", "part", "at", "value"])

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(BUCKETS)).cast("int")
    return docs.select("doc_id", held_out.alias("held_out"), part.alias("part"), "text").mapInArrow(run, FEATURES)


def numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column, one row after the other, and where each row begins and the last ends."""
    column = column.cast(pa.large_binary())
    cut = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=kind, count=(cut[-1] - cut[0]) // size, offset=int(cut[0])) if data else np.zeros(0, dtype=kind)
    return flat, (cut - cut[0]) // size


def margins(batch: pa.RecordBatch, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(margin of each row, places, values, row starts) of a batch with columns at and value; every row has a constant."""
    at, cut = numbers(batch.column("at"), np.uint16)
    value = numbers(batch.column("value"), np.float16)[0].astype(np.float64)
    g = np.add.reduceat(value * model[at], cut[:-1]) if len(at) else np.zeros(0)
    return g, at, value, cut


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -35, 35)))


def sums(rows: DataFrame, model: np.ndarray) -> dict[int, np.ndarray]:
    """rows (trusted, at, value) -> for trusted (1) and all (0) rows: gradients of sum l(g) and of sum l(-g), then count, and both losses.

    A trusted row is an unlabelled one too: the unlabelled rows are the whole text, whatever their labels.

    The sums are added up by dimension on the cluster; the driver gets 2 x (2 SIZE + 3) numbers.
    """
    b = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2 * SIZE + 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            g, at, value, cut = margins(batch, b.value)
            p, n = sigmoid(g), np.diff(cut)
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            for y, own in ((1, trusted), (0, np.ones_like(trusted))):
                if own.any():
                    each = np.repeat(own, n)
                    spread = np.repeat(p[own], n[own])
                    total[y, :SIZE] += np.bincount(at[each], value[each] * (spread - 1), minlength=SIZE)
                    total[y, SIZE : 2 * SIZE] += np.bincount(at[each], value[each] * spread, minlength=SIZE)
                    total[y, -3:] += own.sum(), np.logaddexp(0, -g[own]).sum(), np.logaddexp(0, g[own]).sum()
        y, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(i, pa.int32()), pa.array(total[y, i])], names=["y", "i", "v"])

    out = {y: np.zeros(2 * SIZE + 3) for y in (0, 1)}
    for r in rows.select("trusted", "at", "value").mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        out[r["y"]][r["i"]] = r["v"]
    b.unpersist()
    return out


def biased(s: dict[int, np.ndarray]) -> np.ndarray:
    """Gradient of the risk of telling trusted from unlabelled rows, both kinds weighing alike."""
    return s[1][:SIZE] / max(1.0, s[1][-3]) + s[0][SIZE : 2 * SIZE] / max(1.0, s[0][-3])


def non_negative(prior: float) -> Callable[[dict[int, np.ndarray]], np.ndarray]:
    """Gradient of the non-negative risk, step by step: without the negatives' part while its running mean is below 0."""
    mean = None

    def gradient(s: dict[int, np.ndarray]) -> np.ndarray:
        nonlocal mean
        n_p, n_u = max(1.0, s[1][-3]), max(1.0, s[0][-3])
        risk = s[0][-1] / n_u - prior * s[1][-1] / n_p
        mean = risk if mean is None else MEMORY * mean + (1 - MEMORY) * risk
        out = prior * s[1][:SIZE] / n_p
        return out if mean < 0 else out + s[0][SIZE : 2 * SIZE] / n_u - prior * s[1][SIZE : 2 * SIZE] / n_p

    return gradient


def trained(parts: list[DataFrame], rounds: int, gradient: Callable[[dict[int, np.ndarray]], np.ndarray]) -> np.ndarray:
    """The model after ``rounds`` rounds of one Adam step for each part, the rate falling to none."""
    model, m, v = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    steps = rounds * len(parts)
    for t in range(steps):
        g = gradient(sums(parts[t % len(parts)], model)) + DECAY * model
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        model = model - RATE * (1 - t / steps) * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.99 ** (t + 1))) + 1e-8)
    return model


def least_ratio(trusted: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from counts by bin of rank score, best bins last: least bound, with one standard error added."""
    n_p, n_u = trusted.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    p, u = np.cumsum(trusted[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    some = p >= 0.05
    p, u = p[some], u[some]
    error = (u / p) * np.sqrt((1 - p) / (p * n_p) + np.maximum(1 - u, 0) / np.maximum(u * n_u, 1))
    return float(min(1.0, max(0.01, np.min(u / p + error))))


def prior_of(parts: list[DataFrame]) -> float:
    """Share of positives among unlabelled rows: ranked by a model of the even parts, bounded on the odd ones."""
    model = trained(parts[::2], RANK_ROUNDS, biased)
    spark = parts[0].sparkSession
    b = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(2 * BINS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                at = np.minimum((sigmoid(margins(batch, b.value)[0]) * BINS).astype(np.int64), BINS - 1)
                y = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
                count += np.bincount(np.concatenate([at, BINS + at[y]]), minlength=2 * BINS)
        i = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(count[i], pa.int64())], names=["i", "n"])

    odd = parts[1]
    for p in parts[3::2]:
        odd = odd.union(p)
    count = np.zeros(2 * BINS)
    for r in odd.select("trusted", "at", "value").mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        count[r["i"]] = r["n"]
    return least_ratio(count[BINS:], count[:BINS])


def classify(docs: DataFrame, labels: DataFrame, held_out: Column) -> tuple[DataFrame, float | None]:
    """docs (doc_id bigint, text), labels (doc_id, y int) -> ((doc_id, held_out, score, predicted), prior).

    Nothing is learned from rows of docs or labels for which held_out, over doc_id, is true.
    """
    spark = docs.sparkSession
    positive = labels.filter((F.col("y") == 1) & F.col("doc_id").isNotNull() & ~held_out).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    trusted = scratch.small(positive.withColumn("trusted", F.lit(True)), LABEL_ROWS)
    flagged = vectors(docs, held_out).join(trusted, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    rows = scratch.table(flagged, "features", "part")
    learn = rows.filter("not held_out")
    parts = [learn.filter(F.col("part") == i).select("trusted", "at", "value") for i in range(BUCKETS)]
    model, prior = None, None
    if learn.filter("trusted").limit(1).count():
        prior = prior_of(parts)
        model = trained(parts, ROUNDS, non_negative(prior))
    b = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sigmoid(margins(batch, b.value)[0]) if b.value is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "at", "value").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int"), prior


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents; rows whose crc32(doc_id) mod 3 is 1 are held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = scratch.docs_of(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return classify(scratch.docs_of(spark, sf_dir).select("doc_id", "text"), labels, held)[0]
