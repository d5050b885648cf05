"""op13: held-out accuracy, plain loops for its gradients and prior, and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import positive

SF = "/root/testdata/sf0.01"


def margin(text, model):
    at, value = positive.features(text)
    return float(value.astype(float) @ model[at])


def plain_sums(texts, trusted, model):
    """positive.sums by a loop over texts."""
    out = {y: np.zeros(2 * positive.SIZE + 3) for y in (0, 1)}
    for t, known in zip(texts, trusted):
        at, value = positive.features(t)
        p = 1 / (1 + np.exp(-margin(t, model)))
        for y in (0, 1) if known else (0,):
            for i, v in zip(at.tolist(), value.astype(float).tolist()):
                out[y][i] += v * (p - 1)
                out[y][positive.SIZE + i] += v * p
            out[y][-3:] += 1, -np.log(p), -np.log(1 - p)
    return out


def packed(spark, texts, trusted):
    rows = [(bool(k), bytearray(at.tobytes()), bytearray(v.tobytes())) for k, (at, v) in zip(trusted, map(positive.features, texts))]
    return spark.createDataFrame(rows, "trusted boolean, at binary, value binary").repartition(3)


def test_sums_equal_a_loop(spark):
    texts = ["Ab 1 ab\nx", "", None, "é ü # #", "to to to to\nto to to to", "Der Tag"]
    trusted = [True, False, True, False, False, True]
    model = np.sin(np.arange(positive.SIZE))
    got, want = positive.sums(packed(spark, texts, trusted), model), plain_sums(texts, trusted, model)
    for y in (0, 1):
        assert np.allclose(got[y], want[y], atol=1e-9)


def test_gradient_is_that_of_the_risk():
    texts, trusted = ["a b", "c ! c !", "d e f", "g # g"], [True, False, True, False]
    prior, r = 0.9, np.random.default_rng(0)

    def risk(model):
        g = np.array([margin(t, model) for t in texts])
        own = np.array(trusted)
        negative = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[own]).mean()
        return prior * np.logaddexp(0, -g[own]).mean() + max(0, negative), negative

    signs = set()
    for shift in (0.0, 3.0):
        model = r.normal(size=positive.SIZE) * 0.01
        for i in set(positive.features("a b")[0].tolist()) - set(positive.features("c ! c !")[0].tolist()):
            model[i] += shift
        g = positive.non_negative(prior)(plain_sums(texts, trusted, model))
        way = r.normal(size=positive.SIZE)
        up, down = risk(model + 1e-5 * way)[0], risk(model - 1e-5 * way)[0]
        signs.add(risk(model)[1] < 0)
        assert g @ way == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)
    assert signs == {True, False}


def test_prior_from_known_mixtures():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        best = np.histogram(np.clip(r.normal(0.7, 0.12, 4000), 0, 1), 512, (0, 1))[0].astype(float)
        mixed = np.where(r.random(20_000) < share, r.normal(0.7, 0.12, 20_000), r.normal(0.25, 0.1, 20_000))
        got = positive.least_ratio(best, np.histogram(np.clip(mixed, 0, 1), 512, (0, 1))[0].astype(float))
        assert got == pytest.approx(share, abs=0.05)
    assert positive.least_ratio(np.zeros(512), np.ones(512)) == 0.5


def test_features_of_whole_texts():
    assert [a.tolist() for a in positive.features(None)] == [a.tolist() for a in positive.features("")]
    at, _ = positive.features("word " * 200_000 + "#")
    assert at.max() == positive.SIZE - 1 and (np.diff(at.astype(int)) > 0).all()
    kind = positive.KIND[ord("#")]
    assert positive.KIND[32] * positive.KINDS + kind in at  # the last sign of a very long text is seen


def test_edges(spark):
    held = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (None, "c", "x"), (2, "dup", "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1), (5, 1), (2, 0), (2, None), (None, 1)], "doc_id bigint, y int")
    out, prior = positive.classify(docs, labels, held)  # the only label 1 of a document is held out
    assert prior is None and [r.score for r in out.collect()] == [0.5] * 4
    assert sorted(out.columns) == ["doc_id", "held_out", "predicted", "score"]
    out, prior = positive.classify(docs, labels.union(spark.createDataFrame([(2, 1)], labels.schema)), held)
    got = out.collect()
    assert len(got) == 4 and 0 < prior <= 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert positive.classify(docs.limit(0), labels, held)[0].count() == 0


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in positive.op13_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(got[i], q) for i, q in y.items() if got[i].held_out]
    assert np.mean([r.predicted == q for r, q in held]) >= 0.97
    good, bad = ([r.score for r, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.99


def test_labels_of_0_and_held_out_labels_are_not_read(spark):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    other = labels.filter((F.col("y") == 1) & ~held).union(labels.filter(held).select("doc_id", (1 - F.col("y")).alias("y")))
    a, b = ({r.doc_id: r.score for r in positive.classify(docs, x, held)[0].collect()} for x in (labels, other))
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)
