"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Each source wants its weight's share of the mixture; a source is clamped at ``max_epochs`` times its
own size and the excess goes to the others in proportion to their weights until none is above its cap.
A document is then taken floor(target / size of source) times, and once more if it stands before the
cut in its source's seeded order; the cut is where running words come nearest the remainder.

The order within a source is never sorted in one task: documents fall into hash buckets whose word
sums locate the bucket of the cut, and only that bucket's documents are ordered.

Defined results: a null text has no words; a null source is a source of its own, last in order;
repeated rows are sampled one by one (equal rows are interchangeable); sources without words get
target 0; an empty table gives an empty result; extra columns are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scratch

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MAX_EPOCHS, SEED = 1.5, 2.0, 17
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def draw(doc: Column, text: Column, seed: int) -> Column:
    """A uniform 60-bit integer from the seed, the document's id and its text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target. One row per source, so the windows see sources, not documents.

    With sources in order of cap / weight, the clamped ones are a prefix: source i is clamped when
    filling everything from i on at one level would lift i above its cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("_w", w).withColumn("_cap", max_epochs * F.col("source_size"))
    by = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, all_ = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    s = (
        s.withColumn("_total", share * F.sum("source_size").over(all_))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_clamped", F.col("_left") * F.col("_w") / F.col("_open") >= F.col("_cap"))
    )
    first = F.min(F.when(~F.col("_clamped"), F.struct(F.col("_cap") / F.col("_w"), F.col("_left") / F.col("_open")))).over(all_)
    level = first.getField("col2")
    return s.withColumn("target", F.when(F.col("_clamped"), F.col("_cap")).otherwise(level * F.col("_w"))).select("source", "source_size", F.round("target", 6).alias("target"))


def takes(base: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    """base (source, size, u, ...) -> with source_size, target and copies. base is stable when read twice."""
    p = plan.select(F.col("source").alias("_src"), "source_size", "target").withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("bigint"))
    p = p.withColumn("_rest", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0)))
    b = base.withColumn("_bucket", F.floor(F.col("u") / (2.0**60 / buckets)).cast("int"))
    sums = b.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    run = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(run), F.lit(0))).join(scratch.small(p), F.col("source").eqNullSafe(F.col("_src")))
    cut = scratch.table(sums.filter((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest"))).select(F.col("_src").alias("_csrc"), F.col("_bucket").alias("_cut"), F.col("_before").cast("bigint").alias("_cutb")), "cut")
    plan2 = scratch.table(p.join(scratch.small(cut), F.col("_src").eqNullSafe(F.col("_csrc")), "left").select("_src", "source_size", "target", "_whole", "_rest", "_cut", "_cutb"), "mix")
    d = b.join(scratch.small(plan2), F.col("source").eqNullSafe(F.col("_src")), "left")
    at, cutb = F.col("_bucket"), F.coalesce(F.col("_cut"), F.lit(buckets))  # no cut: the remainder covers all or nothing
    nothing = F.col("_rest") <= 0
    edge = ~nothing & (at == cutb)
    inside = d.filter(edge)
    upto = F.sum("size").over(W.partitionBy("source").orderBy("u").rowsBetween(W.unboundedPreceding, -1))
    mid = F.col("_cutb") + F.coalesce(upto, F.lit(0)) + F.col("size") / 2.0
    inside = inside.withColumn("_more", (mid <= F.col("_rest")).cast("bigint"))
    others = d.filter(~F.coalesce(edge, F.lit(False))).withColumn("_more", (~nothing & (at < cutb)).cast("bigint"))
    return inside.unionByName(others).withColumn("copies", F.col("_whole") + F.coalesce(F.col("_more"), F.lit(0))).drop("_bucket", "_src", "_whole", "_rest", "_cut", "_cutb", "_more")


def buckets_for(n_docs: int, docs_per_bucket: int = 20_000) -> int:
    """As many hash buckets as keep one bucket near ``docs_per_bucket`` rows even if one source holds them all."""
    return max(64, -(-n_docs // docs_per_bucket))


def plan_of(docs: DataFrame, doc_col: str, text_col: str, source_col: str, carry: list[str], seed: int = SEED, **kw) -> DataFrame:
    base = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), draw(F.col(f"`{doc_col}`"), F.col(f"`{text_col}`"), seed).alias("u"))
    base = scratch.table(base, "sizes")
    sizes = scratch.table(base.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    return takes(base, targets(sizes, **kw), buckets_for(base.count()))


def mix(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **kw) -> DataFrame:
    """docs with each row repeated as often as the mixture takes it (0 times: absent); columns unchanged."""
    cols = docs.columns
    t = plan_of(docs, doc_col, text_col, source_col, cols, seed, **kw)
    out = t.filter(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents."""
    t = plan_of(scratch.docs_of(spark, sf_dir), "doc_id", "text", "source", ["doc_id"])
    return t.select(F.col("_c0").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
c AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(rest / open) FILTER (WHERE rest * w / open < cap) AS any_level, arg_min(rest / open, cap / w) FILTER (WHERE rest * w / open < cap) AS level FROM c),
t AS (SELECT source, source_size, round(CASE WHEN rest * w / open >= cap THEN cap ELSE level * w END, 6) AS target FROM c, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, target - whole * p.source_size AS rem,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0 AS mid
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN rem > 0 AND mid <= rem THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
