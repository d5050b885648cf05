"""Lattices, the joint search, temporal splits and experiment statistics against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import optimizer as O

DDL = "site string, created bigint, " + ", ".join(f"{n} int" for n in [*O.PILLARS, "primacy"]) + ", cited boolean"


def product(ranges, total=100):
    return [w for w in itertools.product(*ranges) if sum(w) == total]


def aligned(center, radius, step):
    low, high = max(5, center - radius), min(35, center + radius)
    return range(max(5, -(-low // step) * step), high // step * step + 1, step)


def test_full_grid(spark):
    g = O.numbers(O.lattice(O.whole(spark), O.PILLARS, 5), O.PILLARS)
    assert len(g) == 20_664 and [tuple(map(int, w)) for w in g] == product([range(5, 36, 5)] * 7)
    tens = spark.range(1).select(*[F.lit(v).alias(f"{e}_{n}") for n in O.PILLARS for e, v in (("lo", 5), ("hi", 35))])
    assert O.lattice(tens, O.PILLARS, 10).filter(" AND ".join(f"{n} % 10 = 5" for n in O.PILLARS)).count() == 0


@pytest.mark.parametrize("step", [5, 4])
def test_grids_around_centers(spark, step):
    rows = [("default", *O.DEFAULTS.values()), ("edge", 5, 35, 5, 30, 7, 9, 9)]
    c = spark.createDataFrame(rows, "site string, " + ", ".join(f"{n} int" for n in O.PILLARS))
    got = {}
    for r in O.lattice(O.around(c, O.PILLARS, 10, step), O.PILLARS, step).collect():
        got.setdefault(r.site, []).append(tuple(r[n] for n in O.PILLARS))
    for name, *w in rows:
        assert sorted(got.get(name, [])) == product([aligned(x, 10, step) for x in w])


def sample_rows(n, seed, sites=20, primacy=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x = [r.choice([None, *range(0, 101)]) if r.random() < 0.1 else r.randint(0, 100) for _ in O.PILLARS]
        p = r.choice([None, 0, 50, 100]) if primacy else None
        out.append((f"s{r.randrange(sites)}", i, *x, p, (sum(v or 0 for v in x[3:6]) > 150) != (r.random() < 0.1)))
    return out


def plain(rows, w, threshold, bonus):
    tp = fp = tn = fn = 0
    for _, _, *x, p, cited in rows:
        found = sum((v or 0) * k for v, k in zip(x, w)) + (p or 0) * bonus >= 100 * threshold
        tp, fp, tn, fn = tp + (found and cited), fp + (found and not cited), tn + (not found and not cited), fn + (not found and cited)
    return tp, fp, tn, fn


def plain_mcc(tp, fp, tn, fn):
    below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return round((tp * tn - fp * fn) / math.sqrt(below), 12) if below else 0.0


def test_counts_of_every_cell(spark):
    rows = sample_rows(60, 1)
    grid = O.numbers(O.lattice(O.whole(spark), O.PILLARS, 5), O.PILLARS)[::397]
    got = {(r.code, r.bonus, r.threshold): (r.tp, r.fp, r.tn, r.fn) for r in O.counts(spark.createDataFrame(rows, DDL), grid, [30, 35, 40], [0, 15]).collect()}
    assert len(got) == len(grid) * 6
    for w in grid.tolist():
        code = sum(k * O.CODE ** (6 - i) for i, k in enumerate(w))
        for b, t in itertools.product([0, 15], [30, 35, 40]):
            assert got[code, b, t] == plain(rows, w, t, b)


def test_blocks_do_not_change_counts(spark, monkeypatch):
    df = spark.createDataFrame(sample_rows(40, 2), DDL)
    grid = O.numbers(O.lattice(O.around(spark.createDataFrame([tuple(O.DEFAULTS.values())], list(O.DEFAULTS)), O.PILLARS, 10, 5), O.PILLARS, 5), O.PILLARS)
    a = O.best(O.counts(df, grid, O.THRESHOLDS, O.BONUSES)).first()
    monkeypatch.setattr(O, "ROWS", 77)
    assert O.best(O.counts(df, grid, O.THRESHOLDS, O.BONUSES)).first() == a


def test_joint_search_coarse(spark):
    rows = sample_rows(260, 3)
    got = O.optimize(spark.createDataFrame(rows, DDL), fine=False)
    use = [r for r in rows if sum(w for v, w in zip(r[2:9], O.DEFAULTS.values()) if v is not None) >= 70]
    order = list(dict.fromkeys(r[0] for r in use))
    held = set(order[-max(1, int(len(order) * 0.2)) :])
    train = [r for r in use if r[0] not in held]
    assert (got["training"], got["held_out"]) == (len(train), len(use) - len(train))
    top = (plain_mcc(*plain(train, O.DEFAULTS.values(), 50, 0)), list(O.DEFAULTS.values()), 50, 0)
    grid = product([aligned(w, 10, 5) for w in O.DEFAULTS.values()])
    x = np.array([[v or 0 for v in r[2:9]] for r in train])
    prim, cited = np.array([r[9] or 0 for r in train]), np.array([r[10] for r in train])
    for w in grid:
        base = x @ np.array(w)
        for t in O.THRESHOLDS:
            for b in O.BONUSES:
                found = base + b * prim >= 100 * t
                m = plain_mcc(*(int(v) for v in ((found & cited).sum(), (found & ~cited).sum(), (~found & ~cited).sum(), (~found & cited).sum())))
                if m > top[0]:
                    top = (m, list(w), t, b)
    assert (got["mcc"], list(got["weights"].values()), got["threshold"], got["bonus"]) == top
    tp, fp, tn, fn = plain([r for r in use if r[0] in held], *top[1:])
    assert got["held_out_accuracy"] == round((tp + tn) / (tp + fp + tn + fn), 12) and got["tested"] == len(grid)


def test_fine_search_improves_on_coarse(spark):
    rows = sample_rows(230, 4, primacy=False)
    df = spark.createDataFrame(rows, DDL)
    coarse, fine = O.optimize(df, fine=False), O.optimize(df)
    assert fine["mcc"] >= coarse["mcc"] > coarse["start_mcc"] and fine["bonus"] == 0 and fine["tested"] > coarse["tested"]
    assert all(abs(a - b) <= 10 for a, b in zip(fine["weights"].values(), coarse["weights"].values())) and sum(fine["weights"].values()) == 100


def test_search_says_what_is_missing(spark):
    assert O.optimize(spark.createDataFrame(sample_rows(50, 5), DDL))["error"] == "too few samples"
    assert O.optimize(spark.createDataFrame(sample_rows(260, 5, sites=6), DDL))["error"] == "too few sites"
    assert O.optimize(spark.createDataFrame([], DDL))["error"] == "too few samples"


def test_kth_and_tail_split(spark):
    r = random.Random(6)
    for n, spread in ((1, 5), (7, 3), (400, 20), (400, 10**12)):
        rows = [(r.randint(-spread, spread), i if spread < 100 else i % 7, i) for i in range(n)]
        df = spark.createDataFrame(rows, "a bigint, b bigint, i bigint")
        order = sorted((a, b) for a, b, _ in rows)
        for k in {1, n, (n + 1) // 2}:
            assert tuple(O.kth(df, ["a", "b"], k, bins=8)) == order[k - 1]
        held = {x.i for x in O.tail_split(df, ["a", "b", "i"]).filter("holdout").collect()}
        cut = n - int(n * 0.2)
        assert held == {i for _, _, i in sorted(rows)[cut:]}
    same = spark.createDataFrame([(1,)] * 10, "a bigint")
    assert O.tail_split(same, ["a"]).filter("holdout").count() == 0  # alike rows stay together
    assert O.tail_split(same.limit(0), ["a"]).count() == 0


def test_class_accuracy(spark):
    r = random.Random(7)
    rows = [(r.choice([0.0, 15.0, 30.0, 69.99, 70.0, 85.0, 90.0, r.uniform(0, 120)]), r.randrange(3)) for _ in range(300)]
    got = {(x.full, x.part): x.accuracy for x in O.class_accuracy(spark.createDataFrame(rows, "v double, a int"), F.col("v"), F.col("a"), [], O.CLASS_THRESHOLDS).collect()}
    assert len(got) == len(O.CLASS_THRESHOLDS) == 8 * 8 - 1
    for (f, p), acc in got.items():
        want = sum({0: 1, 1: 0.5, 2: 0}[abs((2 if v >= f else 1 if v >= p else 0) - a)] for v, a in rows) / len(rows)
        assert acc == pytest.approx(want, abs=1e-11)


def test_erfc(spark):
    xs = [i / 40 for i in range(281)] + [2.999999, 3.0, 10.0, 26.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", O.erfc(F.col("x")).alias("y")).collect()
    for r in got:
        assert abs(r.y - math.erfc(r.x)) < 1e-10, r
        if r.x >= 3:
            assert r.y == pytest.approx(math.erfc(r.x), rel=1e-9)


def test_experiment(spark):
    arms = [("a", 100, 60, 100, 80), ("b", 100, 60, 100, 62), ("c", 19, 1, 100, 90), ("d", 50, 50, 50, 50), ("e", 25, 5, 25, 20), ("f", 200, 150, 200, 90), ("g", 0, 0, 0, 0), ("h", 21, 10, 22, 11)]
    df = spark.createDataFrame(arms, "id string, control_n bigint, control_right bigint, treatment_n bigint, treatment_right bigint")
    got = {r.id: r for r in O.experiment(df).collect()}
    for i, cn, cr, tn, tr in arms:
        r = got[i]
        table = [[cr, cn - cr], [tr, tn - tr]]
        rows, cols, n = [sum(x) for x in table], [cr + tr, cn + tn - cr - tr], cn + tn
        if min(cn, tn) < 20 or 0 in cols:
            assert r.p_value is None and not r.significant
            continue
        chi2 = 0.0
        for a in (0, 1):
            for b in (0, 1):
                e = rows[a] * cols[b] / n
                gap = abs(table[a][b] - e)
                chi2 += (gap - min(0.5, gap)) ** 2 / e
        assert r.chi2 == pytest.approx(chi2, abs=1e-9) and r.p_value == pytest.approx(math.erfc(math.sqrt(chi2 / 2)), abs=1e-10)
    assert [got[i].winner for i in "abcdefgh"] == ["treatment", "none", None, "none", None, "control", None, None]
    assert got["e"].significant and not got["e"].ready


def test_health(spark):
    rows = [(0.8, 0.1, 0.1), (0.8, 0.2, 0.0), (0.7, 0.15, 0.15), (0.5, 0.3, 0.2), (0.75, 0.15, 0.15), (0.6, 0.25, 0.26)]
    got = O.health(spark.createDataFrame(rows, "accuracy double, over_rate double, under_rate double")).collect()
    assert [r.status for r in got] == ["healthy", "acceptable", "acceptable", "needs_attention", "healthy", "needs_attention"]
    assert [r.advice for r in got] == [[], ["optimism:medium"], ["accuracy:medium"], ["accuracy:high", "optimism:high", "pessimism:medium"], [], ["accuracy:medium", "optimism:medium", "pessimism:high"]]
