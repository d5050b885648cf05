"""Calibration search: weight lattices, joint weight and threshold search, temporal splits, experiment tests.

Grids are parameter spaces of fixed size; samples are data. A search multiplies blocks of weight rows with blocks of distinct
score rows inside tasks (one matrix product a block) and keeps mergeable counts by score bin, so each task reads its samples once
for all thresholds, holds at most SEGMENT of them and the product of one block, and the shuffle carries counts alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import split_sites

# Default weights, bounds of a weight, thresholds and bonus weights to try.
DEFAULTS = {"technical": 12, "structure": 18, "schema": 13, "authority": 12, "entity_recognition": 13, "retrieval": 22, "coverage": 10}
PILLARS = list(DEFAULTS)
LEAST, MOST, TOTAL = 5, 35, 100
THRESHOLDS = [30, 35, 40, 45, 50, 55, 60]
BONUSES = [0, 5, 10, 15, 20]
START_THRESHOLD = 50
MIN_COVERAGE, MIN_SAMPLES, MIN_TRAIN_SITES, MIN_HELD_SITES = 70, 200, 10, 3
MIN_ARM = 20

CODE = 101  # weights as digits of one number: its order is that of the weight rows
ROWS, COLUMNS, SEGMENT = 1024, 2048, 250_000  # weight rows and score rows a block, score rows a task holds


# Lattices


def lattice(bounds: DataFrame, names: list[str], step: int, total: int = TOTAL) -> DataFrame:
    """All rows of multiples of step between lo_<name> and hi_<name> of each row of bounds that sum to total.

    One name after the other; a partial sum that the remaining names cannot bring to the total is dropped at once, so no product
    is built. Other columns of bounds stay. No shuffle.
    """
    g = bounds.withColumn("_sum", F.lit(0))
    for i, n in enumerate(names[:-1]):
        low = sum((F.col(f"lo_{m}") for m in names[i + 1 :]), F.lit(0))
        high = sum((F.col(f"hi_{m}") for m in names[i + 1 :]), F.lit(0))
        first, last = F.greatest(F.col(f"lo_{n}"), total - high - F.col("_sum")), F.least(F.col(f"hi_{n}"), total - low - F.col("_sum"))
        g = g.withColumns({"_first": (F.ceil(first / step) * step).cast("int"), "_last": last.cast("int")}).filter("_first <= _last")
        g = g.withColumn(n, F.explode(F.sequence("_first", "_last", F.lit(step)))).withColumn("_sum", F.col("_sum") + F.col(n)).drop("_first", "_last", f"lo_{n}", f"hi_{n}")
    n = names[-1]  # what is left to the total
    g = g.withColumn(n, total - F.col("_sum")).filter((F.col(n) >= F.col(f"lo_{n}")) & (F.col(n) <= F.col(f"hi_{n}")) & (F.col(n) % step == 0))
    return g.drop("_sum", f"lo_{n}", f"hi_{n}")


def around(centers: DataFrame, names: list[str], radius: int, step: int) -> DataFrame:
    """bounds for lattice(): each name within radius of its column in centers, within LEAST and MOST, aligned to step."""
    cols = {}
    for n in names:
        cols[f"lo_{n}"] = F.greatest(F.lit(LEAST), F.ceil(F.greatest(F.lit(LEAST), F.col(n) - radius) / step) * step).cast("int")
        cols[f"hi_{n}"] = (F.floor(F.least(F.lit(MOST), F.col(n) + radius) / step) * step).cast("int")
    return centers.withColumns(cols).drop(*names)


def whole(spark: SparkSession, names: list[str] = PILLARS) -> DataFrame:
    """bounds of the full grid."""
    return spark.range(1).select(*[F.lit(v).alias(f"{e}_{n}") for n in names for e, v in (("lo", LEAST), ("hi", MOST))])


def numbers(grid: DataFrame, names: list[str]) -> np.ndarray:
    """Weight rows in order; a grid has a size of its own, whatever the data."""
    t = grid.select(*[F.col(n).cast("smallint") for n in names]).toArrow()
    w = np.stack([t[n].to_numpy() for n in names], axis=1) if t.num_rows else np.zeros((0, len(names)), dtype=np.int16)
    return w[np.lexsort(w.T[::-1])]


# Samples


def covered(samples: DataFrame, least: int = MIN_COVERAGE, weights: dict[str, int] = DEFAULTS) -> DataFrame:
    """Samples whose evaluated pillars carry at least ``least`` of the default weight."""
    return samples.filter(reduce(lambda a, b: a + b, [F.when(F.col(n).isNotNull(), w).otherwise(0) for n, w in weights.items()]) >= least)


def weighted(weights: dict[str, Column], bonus: Column, primacy: str = "primacy") -> Column:
    """100 times the weighted score: pillars not evaluated count 0, the bonus is added on top."""
    score = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0)) * w for n, w in weights.items()])
    return score + F.coalesce(F.col(primacy), F.lit(0)) * bonus


def confusion(samples: DataFrame, found: Column, by: list[str], cited: str = "cited") -> DataFrame:
    c = F.col(cited)
    return samples.groupBy(*by).agg(F.count_if(found & c).alias("tp"), F.count_if(found & ~c).alias("fp"), F.count_if(~found & ~c).alias("tn"), F.count_if(~found & c).alias("fn"))


def mcc() -> Column:
    """Matthews correlation of columns tp, fp, tn and fn to 12 digits; 0 where a margin is 0."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.round(F.when(below == 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(below)), 12)


def rates(c: DataFrame) -> DataFrame:
    """c with accuracy, over_rate, under_rate, mcc and the accuracy less half the bias."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    part = lambda x: F.round(F.coalesce(F.try_divide(x, n), F.lit(0.0)), 12)
    c = c.withColumns({"accuracy": part(F.col("tp") + F.col("tn")), "over_rate": part(F.col("fp")), "under_rate": part(F.col("fn")), "mcc": mcc()})
    return c.withColumn("adjusted", F.round(F.greatest(F.lit(0.0), F.col("accuracy") - F.abs(F.col("over_rate") - F.col("under_rate")) / 2), 12))


# Search


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about SEGMENT rows each."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= SEGMENT:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def counts(samples: DataFrame, grid: np.ndarray, thresholds: list[int], bonuses: list[int], names: list[str] = PILLARS) -> DataFrame:
    """samples (names as integers 0..100, primacy, cited) -> (code, bonus, threshold, tp, fp, tn, fn) for each weight row, bonus and threshold.

    thresholds rise by equal steps. code packs the weights, first name highest.
    """
    spark = samples.sparkSession
    step = thresholds[1] - thresholds[0] if len(thresholds) > 1 else 1
    bins = len(thresholds) + 1
    value = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("smallint").alias(n)
    rows = samples.groupBy(*[value(n) for n in [*names, "primacy"]], "cited").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.repartition(spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(grid.astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = CODE ** np.arange(len(names) - 1, -1, -1, dtype=np.int64)
        fields = ["code", "bonus", *[f"c{i}" for i in range(2 * bins)]]
        for t in segments(batches):  # bytes of scores; as floats only a block at once
            for at in range(0, len(shared.value), ROWS):
                w = shared.value[at : at + ROWS]
                total = np.zeros((len(bonuses), len(w) * 2 * bins), dtype=np.int64)
                for i in range(0, t.num_rows, COLUMNS):
                    part = t.slice(i, COLUMNS)
                    x = np.stack([part[n].to_numpy() for n in names]).astype(np.float32)
                    primacy, n = part["primacy"].to_numpy().astype(np.float32), part["n"].to_numpy().astype(np.float64)
                    base = w.astype(np.float32) @ x  # 100 times the score, exact in single precision
                    row = np.arange(len(w))[:, None] * (2 * bins) + part["cited"].to_numpy(zero_copy_only=False).astype(np.int64) * bins
                    for k, b in enumerate(bonuses):
                        passed = np.floor((base + b * primacy - 100 * thresholds[0]) / (100 * step)).astype(np.int64) + 1
                        cell = row + np.clip(passed, 0, bins - 1)
                        total[k] += np.bincount(cell.ravel(), np.broadcast_to(n, cell.shape).ravel(), minlength=len(w) * 2 * bins).astype(np.int64)
                for k, b in enumerate(bonuses):
                    c = total[k].reshape(len(w), 2 * bins)
                    yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64) @ powers), pa.array(np.full(len(w), b, dtype=np.int32)), *[pa.array(np.ascontiguousarray(c[:, i])) for i in range(2 * bins)]], names=fields)

    ddl = "code bigint, bonus int, " + ", ".join(f"c{i} bigint" for i in range(2 * bins))
    summed = rows.mapInArrow(run, ddl).groupBy("code", "bonus").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(2 * bins)])
    cells = lambda side, own: reduce(lambda a, b: a + b, [F.col(f"c{side * bins + i}") for i in own])
    each = [F.struct(F.lit(t).alias("threshold"), cells(1, range(i + 1, bins)).alias("tp"), cells(0, range(i + 1, bins)).alias("fp"), cells(0, range(i + 1)).alias("tn"), cells(1, range(i + 1)).alias("fn")) for i, t in enumerate(thresholds)]
    return summed.select("code", "bonus", F.inline(F.array(*each)))


def best(found: DataFrame) -> DataFrame:
    """The row of greatest mcc; ties go to the first weights, then threshold, then bonus."""
    f = found.withColumn("mcc", mcc())
    key = F.struct(F.col("mcc"), -F.col("code"), -F.col("threshold"), -F.col("bonus"))
    return f.agg(F.max_by(F.struct("code", "threshold", "bonus", "tp", "fp", "tn", "fn", "mcc"), key).alias("r")).select("r.*")


def weight(i: int, names: list[str] = PILLARS) -> Column:
    """The i-th weight of column code."""
    return F.pmod(F.expr(f"code div {CODE ** (len(names) - 1 - i)}"), F.lit(CODE)).cast("bigint")


def optimize(samples: DataFrame, full: bool = False, fine: bool = True, least: int = MIN_SAMPLES, names: list[str] = PILLARS) -> dict:
    """The joint search over samples (site, created, names, primacy, cited), last sites held out.

    Coarse: weights within 10 of the defaults by 5 (or the full grid), all thresholds and, where any sample has a primacy, all
    bonuses. Fine: weights within 10 of the best by 2, thresholds and bonuses near its own by 2. A row replaces the best only if its mcc is
    greater; the first best is the defaults at threshold 50. Returns plain values; ``error`` says what is missing.
    """
    spark = samples.sparkSession
    use = split_sites(covered(samples), "site", "created").persist()
    try:
        sizes = {r["holdout"]: r for r in use.groupBy("holdout").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("site").alias("sites"), F.count("primacy").alias("primacy")).collect()}
        n, sites = {h: sizes[h]["n"] if h in sizes else 0 for h in (False, True)}, {h: sizes[h]["sites"] if h in sizes else 0 for h in (False, True)}
        out = {"error": None, "training": n[False], "held_out": n[True], "training_sites": sites[False], "held_out_sites": sites[True]}
        if sum(n.values()) < least:
            return out | {"error": "too few samples"}
        if sites[False] < MIN_TRAIN_SITES or sites[True] < MIN_HELD_SITES:
            return out | {"error": "too few sites"}
        train = use.filter("not holdout")
        start = confusion(train, weighted({k: F.lit(v) for k, v in DEFAULTS.items()}, F.lit(0)) >= 100 * START_THRESHOLD, []).withColumn("mcc", mcc()).first()
        top = start.asDict() | {"weights": list(DEFAULTS.values()), "threshold": START_THRESHOLD, "bonus": 0}
        bonuses = BONUSES if sizes[False]["primacy"] else [0]
        centers = lambda w: spark.range(1).select(*[F.lit(v).alias(k) for k, v in zip(names, w)])
        grid = numbers(lattice(whole(spark) if full else around(centers(DEFAULTS.values()), names, 10, 5), names, 5), names)
        tested = len(grid)
        top = _better(top, train, grid, THRESHOLDS, bonuses, names)
        if fine:
            grid = numbers(lattice(around(centers(top["weights"]), names, 10, 2), names, 2), names)
            tested += len(grid)
            t, b = top["threshold"], top["bonus"]
            near = list(range(max(0, b - 5), min(25, b + 6), 2)) if sizes[False]["primacy"] else [0]
            top = _better(top, train, grid, list(range(max(20, t - 10), min(70, t + 11), 2)), near, names)
        found = weighted(dict(zip(names, map(F.lit, top["weights"]))), F.lit(top["bonus"])) >= 100 * top["threshold"]
        held = rates(confusion(use.filter("holdout"), found, [])).first()
        own = rates(confusion(train, found, [])).first()
        return out | {"tested": tested, "weights": dict(zip(names, top["weights"])), "threshold": top["threshold"], "bonus": top["bonus"], "mcc": top["mcc"], "start_mcc": start["mcc"], "improvement": round(top["mcc"] - start["mcc"], 12), "accuracy": own["accuracy"], "over_rate": own["over_rate"], "under_rate": own["under_rate"], "held_out_accuracy": held["accuracy"], "held_out_adjusted": held["adjusted"]}
    finally:
        use.unpersist()


def _better(top: dict, train: DataFrame, grid: np.ndarray, thresholds: list[int], bonuses: list[int], names: list[str]) -> dict:
    if not len(grid):
        return top
    r = best(counts(train, grid, thresholds, bonuses, names)).first()
    if r["mcc"] is None or r["mcc"] <= top["mcc"]:
        return top
    w = [r["code"] // CODE ** (len(names) - 1 - i) % CODE for i in range(len(names))]
    return r.asDict() | {"weights": w}


# Temporal split


def kth(df: DataFrame, keys: list[str], k: int, bins: int = 4096) -> list[int]:
    """The k-th smallest (from 1) row of bigint keys, compared in order; exact, without a sort.

    Counts by equal bins of the range that still holds it, again and again until the range is one value, then the next key
    among the rows of that value: each round is one aggregation to at most ``bins`` rows.
    """
    out, rest = [], df
    for key in keys:
        low, high = rest.agg(F.min(key), F.max(key)).first()
        while low < high:
            width = -(-(high - low + 1) // bins)
            b = F.expr(f"(`{key}` - {low}L) div {width}L")
            for r in sorted(rest.filter(F.col(key).between(low, high)).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()):
                if r["n"] >= k:
                    low, high = low + r["b"] * width, min(high, low + (r["b"] + 1) * width - 1)
                    break
                k -= r["n"]
        out.append(low)
        rest = rest.filter(F.col(key) == low)
    return out


def tail_split(df: DataFrame, keys: list[str], share: float = 0.2) -> DataFrame:
    """df with holdout: the last int(share x rows) rows in order of keys; rows alike in all keys at the cut stay in training together."""
    n = df.count()
    train = n - int(n * share)
    if not train or train == n:
        return df.withColumn("holdout", F.lit(not train and n > 0))
    cut = kth(df, keys, train)
    after, same = F.lit(False), F.lit(True)
    for key, v in zip(keys, cut):
        after = after | (same & (F.col(key) > v))
        same = same & (F.col(key) == v)
    return df.withColumn("holdout", after)


def steps(low: float, high: float, step: float) -> list[int]:
    """Hundredths from low by step while the running sum is not above high."""
    out, x = [], low
    while x <= high:
        out.append(round(100 * x))
        x += step
    return out


#: (full, part) thresholds in hundredths, in order of search.
CLASS_THRESHOLDS = [(f, p) for f in steps(0.50, 0.90, 0.05) for p in steps(0.15, 0.50, 0.05) if p < f]
CLASS_START = (70, 30)


def class_accuracy(samples: DataFrame, score: Column, actual: Column, by: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """(by, full, part, accuracy, n): 1 for the right class of 0, 1, 2, a half for its neighbour; score in hundredths.

    Scores are counted by their place among all thresholds first, so the grid meets counts, not samples.
    """
    marks = sorted({x for p in pairs for x in p})
    place = reduce(lambda a, b: a + b, [F.when(score >= m, 1).otherwise(0) for m in marks])
    cells = samples.groupBy(*by, place.alias("_place"), actual.alias("_actual")).agg(F.count(F.lit(1)).alias("_n"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("full"), F.lit(p).alias("part"), F.lit(marks.index(f)).alias("_f"), F.lit(marks.index(p)).alias("_p")) for f, p in pairs]))
    x = cells.withColumn("_g", each).select(*by, "_place", "_actual", "_n", "_g.*")
    said = F.when(F.col("_place") > F.col("_f"), 2).when(F.col("_place") > F.col("_p"), 1).otherwise(0)
    off = F.abs(said - F.col("_actual"))
    right = F.sum(F.col("_n") * F.when(off == 0, 1.0).when(off == 1, 0.5).otherwise(0.0))
    return x.groupBy(*by, "full", "part").agg(F.round(right / F.sum("_n"), 12).alias("accuracy"), F.sum("_n").alias("n"))


# Experiments


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0 by built-in functions, within 1e-10: a series of positive terms below 3, a continued fraction above; null of null."""
    y = F.least(x, F.lit(3.0))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(y.alias("term"), y.alias("sum")),
        lambda a, n: F.struct((a["term"] * 2 * y * y / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * y * y / (2 * n + 1)).alias("sum")),
    )["sum"]
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-y * y) * series
    z = F.greatest(x, F.lit(1.0))
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda a, n: z + n / 2 / a)
    return F.when(x < 3, near).when(x >= 3, F.exp(-z * z) / (math.sqrt(math.pi) * tail))


def experiment(arms: DataFrame, min_arm: int = MIN_ARM, min_samples: int = 30) -> DataFrame:
    """arms (control_n, control_right, treatment_n, treatment_right) with accuracies, difference, chi2 with Yates' correction, p_value, significant, ready, winner.

    chi2 and p_value are null below min_arm samples in an arm and where a margin of the table is 0. winner is null until both arms
    have min_samples.
    """
    a, b = F.col("treatment_right").cast("double"), (F.col("treatment_n") - F.col("treatment_right")).cast("double")
    c, d = F.col("control_right").cast("double"), (F.col("control_n") - F.col("control_right")).cast("double")
    n = a + b + c + d
    expected = (a + b) * (a + c) / n
    gap = F.greatest(F.lit(0.0), F.abs(a - expected) - F.least(F.lit(0.5), F.abs(a - expected)))
    chi2 = F.try_divide(gap * gap * n * n * n, (a + b) * (c + d) * (a + c) * (b + d))
    enough = (F.col("control_n") >= min_arm) & (F.col("treatment_n") >= min_arm)
    share = lambda k, m: F.coalesce(F.try_divide(F.col(k), F.col(m)), F.lit(0.0))
    out = arms.withColumns({"control_accuracy": share("control_right", "control_n"), "treatment_accuracy": share("treatment_right", "treatment_n"), "chi2": F.when(enough, chi2)})
    out = out.withColumn("difference", F.col("treatment_accuracy") - F.col("control_accuracy")).withColumn("p_value", erfc(F.sqrt(F.col("chi2") / 2)))
    out = out.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
    ready = (F.col("control_n") >= min_samples) & (F.col("treatment_n") >= min_samples)
    winner = F.when(ready, F.when(~F.col("significant"), "none").when(F.col("difference") > 0, "treatment").otherwise("control"))
    return out.withColumns({"ready": ready, "winner": winner})


# Health


def health(measured: DataFrame) -> DataFrame:
    """rows with accuracy, over_rate and under_rate -> with status, and codes of what to look at."""
    a, over, under = F.col("accuracy"), F.col("over_rate"), F.col("under_rate")
    status = F.when((a >= 0.75) & (over <= 0.15) & (under <= 0.15), "healthy").when((a >= 0.6) & (over <= 0.25) & (under <= 0.25), "acceptable").otherwise("needs_attention")
    bias = lambda c, name: F.when(c > 0.25, f"{name}:high").when(c > 0.15, f"{name}:medium")
    advice = F.array_compact(F.array(F.when(a < 0.6, "accuracy:high").when(a < 0.75, "accuracy:medium"), bias(over, "optimism"), bias(under, "pessimism")))
    return measured.withColumns({"status": status, "advice": advice})
