"""Columns named like an operator's own, null item ids, and the outlier verdict against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from wellspring.llm import decontaminate, mixing, quality, sharding, simhash, urls

SF = "/root/testdata/sf0.001"
NAMES = ["contaminated", "n_words", "shard", "slot", "copies", "target", "fp", "component_id", "kept", "distance", "host", "verdict", "group", "size", "u", "_text", "matches"]


def test_clashing_columns_pass_every_operator(spark):
    base = spark.createDataFrame([(i, f"alpha beta gamma w{i} " * 20, "en", "s", 7) for i in range(6)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = base.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])
    bench = spark.createDataFrame([(1, "alpha beta gamma w3"), (None, "w2 alpha")], "item_id bigint, text string")
    for out in (decontaminate.decontaminate(docs, bench), mixing.mix(docs), simhash.dedup(docs), quality.quality(docs)):
        assert out.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in NAMES)
    packed = sharding.pack(docs, shards=2)
    assert sorted(packed.columns) == sorted(docs.columns) and all(isinstance(r.shard, int) for r in packed.collect())
    assert urls.filter_urls(docs.withColumn("url", F.lit("http://x.org/")), weights=[0.0] * 9).columns == [*docs.columns, "url"]
    r = {x.doc_id: x for x in decontaminate.report(docs, bench, docs.columns).collect()}
    assert r[2].n_hit > 0 and r[2].n_items == 0 and r[3].n_items == 1 and isinstance(r[3].contaminated, bool)


def test_outlier_verdict_matches_a_plain_loop(spark):
    """The same estimate by numpy: exact quantiles stand for histograms, so only texts near the cut may differ."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    c = quality.scratch.table(quality.with_counts(docs, F.col("text")).drop("text"))
    got = quality.judged(c, "lang", "source").filter("NOT base_failed").select("doc_id", "lang", "source", *quality.X, "distance").toPandas()
    own = got.groupby(["lang", "source"], dropna=False).doc_id.transform("count")
    assert (own < quality.MIN_GROUP).all()  # at this size every group borrows its language's estimate
    far = 0
    for _, g in got.groupby("lang"):
        x = g[quality.X].to_numpy()
        floors = np.array(quality.FLOORS)
        m = np.median(x, axis=0)
        cov = np.diag(np.maximum((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349, floors) ** 2)
        dist = lambda m, cov: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
        for _ in range(quality.STEPS):
            d = dist(m, cov)
            use = x[d <= np.quantile(d, quality.COVERAGE, method="higher") * 1.01]
            m, new = use.mean(axis=0), np.cov(use.T, bias=True) * quality.COVERAGE_FACTOR + np.diag(floors**2)
            done = np.allclose(new, cov)
            cov = new
            if done:
                break
        use = x[dist(m, cov) <= quality.REWEIGHT_CUT]
        d = dist(use.mean(axis=0), np.cov(use.T, bias=True) * quality.REWEIGHT_FACTOR + np.diag(floors**2))
        far += int(((d <= quality.CUTOFF) != (g.distance.to_numpy() <= quality.CUTOFF)).sum())
    assert far <= 0.01 * len(got)
