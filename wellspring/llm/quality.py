"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

Every text gets exact word, symbol, line and repetition counts. Texts that pass the base rules are
described by a transformed vector (log word length, symbol rate, repetition share, duplicate-line share)
and compared with their own language and source: a minimum-covariance-determinant estimate of
location and scatter (deterministic start from medians and quartiles, concentration steps on the
closest three quarters until the determinants settle, one reweighting step) and a Mahalanobis cut-off in the far tail
of chi-square. A group of fewer than ``MIN_GROUP`` texts borrows its language's estimate, a small language that of all.

All of it is DataFrame expressions and aggregates; medians and quantiles come from fixed-width
histograms, so they are exact to the bin, mergeable and equal on every run.

Defined results: a null text has no words and fails; null language or source form groups of their own;
repeated rows are judged alike, texts at equal distance too; very long texts count whole; an empty table gives an empty result; ``quality`` keeps extra
columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scratch

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS, MIN_GROUP = 50, 40
STEPS, SETTLED = 30, 0.02  # concentration stops when no group's log determinant falls by SETTLED, at the latest after STEPS
INDEX_BITS = 20

#: Least standard deviation of each feature: word length, symbols, repetition, duplicate lines.
FLOORS = (0.05, 0.12, 0.12, 0.16)
# Chi-square with 4 degrees of freedom.
COVERAGE, COVERAGE_FACTOR = 0.75, 1.486  # 0.75 / P(chi2_6 <= 5.385)
REWEIGHT_CUT, REWEIGHT_FACTOR = 11.143, 1.064  # quantile 0.975; 0.975 / P(chi2_6 <= 11.143)
CUTOFF = 40.0  # beyond the quantile 1 - 4e-8

P = len(FLOORS)
X = [f"_x{i}" for i in range(P)]


def _repeat_words() -> str:
    """SQL over _w (words) and _g (hashes of 3-word windows): words in windows found twice or more.

    Window hashes are packed with their index (high bits of the hash, low INDEX_BITS of the index) and
    sorted as plain longs. Neighbours that agree in the high bits but differ in the whole hash, or a
    text with too many windows for the index, go to the wider sort of (hash, index) pairs instead.
    """
    m = (1 << INDEX_BITS) - 1
    covered = "aggregate({p}, struct(0L AS n, -3L AS at), (s, x) -> struct(s.n + least(3L, x - s.at) AS n, x AS at), s -> s.n)"
    fast = covered.format(p=f"array_sort(transform(_dup, x -> x & {m}L))")
    pairs = "array_sort(transform(_g, (x, i) -> struct(x AS h, CAST(i AS BIGINT) AS i)))"
    slow = covered.format(p=f"transform(array({pairs}), q -> array_sort(transform(filter(q, (x, j) -> get(q, j - 1).h <=> x.h OR get(q, j + 1).h <=> x.h), x -> x.i)))[0]")
    clash = f"exists(transform(_dup, (x, j) -> j > 0 AND shiftright(x, {INDEX_BITS}) = shiftright(get(_dup, j - 1), {INDEX_BITS}) AND get(_g, CAST(x & {m}L AS INT)) != get(_g, CAST(get(_dup, j - 1) & {m}L AS INT))), x -> x)"
    return f"CASE WHEN _g IS NULL THEN 0L WHEN _dup IS NULL OR {clash} THEN {slow} WHEN size(_dup) = 0 THEN 0L ELSE {fast} END"


def with_counts(docs: DataFrame, text: Column) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    m = (1 << INDEX_BITS) - 1
    b = docs.withColumn("_t", F.coalesce(text, F.lit("")))
    b = b.withColumn("_s", F.btrim("_t", F.lit(" \t\n\x0b\x0c\r")))
    b = b.withColumn("_w", F.when(F.col("_s") == "", F.array().cast("array<string>")).otherwise(F.split("_s", SPACE + "+")))
    b = b.withColumn("_g", F.expr("CASE WHEN size(_w) > 3 THEN transform(sequence(0, size(_w) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) END"))
    packed = f"array_sort(transform(_g, (x, i) -> (x & ~{m}L) | CAST(i AS BIGINT)))"
    b = b.withColumn("_p", F.expr(f"CASE WHEN size(_g) <= {m} THEN {packed} END"))
    same = f"shiftright(x, {INDEX_BITS}) = shiftright(get(_p, {{}}), {INDEX_BITS})"
    b = b.withColumn("_dup", F.expr(f"filter(_p, (x, j) -> coalesce({same.format('j - 1')}, false) OR coalesce({same.format('j + 1')}, false))"))
    b = b.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), x -> rlike(x, '{WORD_ESC}'))"))
    return b.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_w").cast("bigint").alias("n_words"),
        (F.length("_t") - F.regexp_count("_t", F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.expr(_repeat_words()).alias("n_repeat_words"),
        F.size("_l").cast("bigint").alias("n_lines"),
    )


WORD_ESC = r"[^\\x20\\x09-\\x0D]"


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _features(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    x = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(8.0 * F.col("n_symbols") / n),
        F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
        F.asin(F.sqrt(F.least(F.col("n_dup_lines") / F.greatest(F.col("n_lines") + 4, F.lit(1)), F.lit(1.0)))),
    ]
    return d.withColumns(dict(zip(X, x)))


def _part(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), c), F.lit("n"))


def _quantiles(rows: DataFrame, value: Column, width: float, qs: list[float]) -> DataFrame:
    """(_k) -> _q0.. : the histogram bin, as its middle, at or above each quantile of value."""
    h = rows.groupBy("_k", F.floor(value / width).cast("bigint").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(W.partitionBy("_k").orderBy("_bin"))
    all_ = F.sum("_n").over(W.partitionBy("_k"))
    h = h.withColumn("_cum", run).withColumn("_all", all_)
    return h.groupBy("_k").agg(*[F.min(F.when(F.col("_cum") >= q * F.col("_all"), (F.col("_bin") + 0.5) * width)).alias(f"_q{i}") for i, q in enumerate(qs)])


def _distance(factor: float = 1.0) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor _l{i}{j} about _m{i}."""
    z: list[Column] = []
    for i in range(P):
        r = F.col(X[i]) - F.col(f"_m{i}")
        for j in range(i):
            r = r - F.col(f"_l{i}{j}") * z[j]
        z.append(r / F.col(f"_l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0]) / factor


def _cholesky(est: DataFrame, factor: float) -> DataFrame:
    """(_k, _m*, _c{i}{j}) -> (_k, _m*, _l{i}{j}) of factor * covariance + floors."""
    for i in range(P):
        for j in range(i + 1):
            v = F.col(f"_c{i}{j}") * factor + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                v = v - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            est = est.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"_l{j}{j}"))
    return est.select("_k", *[f"_m{i}" for i in range(P)], *[f"_l{i}{j}" for i in range(P) for j in range(i + 1)])


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_k").agg(*[F.avg(X[i]).alias(f"_m{i}") for i in range(P)], *[F.covar_pop(X[i], X[j]).alias(f"_c{i}{j}") for i in range(P) for j in range(i + 1)])


def estimates(rows: DataFrame) -> DataFrame:
    """rows (_k, features), stable when read twice -> minimum-covariance-determinant estimate per _k."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(X[i]).alias("x")) for i in range(P)])).alias("_e")
    q = _quantiles(rows.select(F.col("_k").alias("_g"), each).select(F.struct("_g", "_e.i").alias("_k"), F.col("_e.x").alias("_x")), F.col("_x"), 0.002, [0.25, 0.5, 0.75])
    of = lambda i, v: F.max(F.when(F.col("_k.i") == i, v))
    iqr = (F.col("_q2") - F.col("_q0")) / 1.349
    start = q.groupBy(F.col("_k._g").alias("_k")).agg(*[of(i, F.col("_q1")).alias(f"_m{i}") for i in range(P)], *[of(i, F.greatest(iqr, F.lit(FLOORS[i]))).alias(f"_l{i}{i}") for i in range(P)])
    start = start.withColumns({f"_l{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)})
    est = scratch.table(start, "mcd")
    volume = lambda e: e.select("_k", sum((F.log(f"_l{i}{i}") for i in range(1, P)), F.log("_l00")).alias("_v"))
    near = lambda: rows.join(scratch.small(est), "_k").withColumn("_d", _distance())
    for step in range(STEPS):  # concentrate on the closest COVERAGE of each group
        d = near()
        cut = _quantiles(d, F.log(F.col("_d") + 1e-9), 0.01, [COVERAGE]).select("_k", (F.col("_q0") + 0.005).alias("_cut"))
        d = d.join(scratch.small(scratch.table(cut, "cut")), "_k").filter(F.log(F.col("_d") + 1e-9) <= F.col("_cut"))
        new = scratch.table(_cholesky(_moments(d.select("_k", *X)), COVERAGE_FACTOR), "mcd")
        moved = volume(new).join(volume(est).withColumnRenamed("_v", "_was"), "_k").agg(F.max(F.col("_was") - F.col("_v"))).first()[0]
        est = new
        if moved is None or step >= 2 and moved < SETTLED:  # the start is no estimate yet, its volume tells nothing
            break
    return scratch.table(_cholesky(_moments(near().filter(F.col("_d") <= REWEIGHT_CUT).select("_k", *X)), REWEIGHT_FACTOR), "mcd")


def judged(counts: DataFrame, lang: str, source: str) -> DataFrame:
    """counts (a scratch table with the columns of with_counts) -> with base_failed, distance, kept."""
    c = _features(counts).withColumn("base_failed", base_failed())
    one, two, all_ = F.concat(_part(F.col(lang)), F.lit("|"), _part(F.col(source))), _part(F.col(lang)), F.lit("*")
    ok = c.filter(~F.col("base_failed")).select(two.alias("_two"), one.alias("_one"), *X)
    sizes = ok.groupBy("_one", "_two").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_n2", F.sum("_n").over(W.partitionBy("_two")))
    key = F.when(F.col("_n") >= MIN_GROUP, F.col("_one")).when(F.col("_n2") >= MIN_GROUP, F.col("_two")).otherwise(all_)
    keys = scratch.table(sizes.select("_one", "_two", key.alias("_use")), "keys")
    used = keys.select("_use").distinct()
    levels = ok.withColumn("_k", F.explode(F.array("_one", "_two", all_))).join(scratch.small(used), F.col("_k") == F.col("_use"), "left_semi")
    est = estimates(levels.select("_k", *X))
    use = scratch.table(keys.join(est, F.col("_use") == F.col("_k")).drop("_k", "_use", "_two").withColumnRenamed("_one", "_g1"), "use")
    d = c.withColumn("_g", one).join(scratch.small(use), F.col("_g") == F.col("_g1"), "left").withColumn("distance", _distance())
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs without rejected documents; columns unchanged.

    Rejected (id, text hash) pairs are broadcast while they are at most a million; beyond that the
    anti-join shuffles.
    """
    cols = docs.columns
    base = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)])
    col = {c: f"_c{i}" for i, c in enumerate(cols)}
    full = with_counts(base, F.col(col[text_col]))
    counts = scratch.table(full.select(F.col(col[doc_col]).alias("_id"), F.col(col[lang_col]).alias("lang"), F.col(col[source_col]).alias("source"), F.xxhash64(col[text_col]).alias("_h"), *COUNTS, "n_lines"), "counts")
    bad = scratch.table(judged(counts, "lang", "source").filter(~F.col("kept")).select(F.col("_id").alias("_bid"), F.col("_h").alias("_bh")).distinct(), "rejected")
    out = base.join(scratch.small(bad, 1_000_000), F.col(col[doc_col]).eqNullSafe(F.col("_bid")) & (F.xxhash64(col[text_col]) == F.col("_bh")), "left_anti")
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents."""
    docs = scratch.docs_of(spark, sf_dir).select("doc_id", "text", "lang", "source")
    counts = scratch.table(with_counts(docs, F.col("text")).drop("text"), "counts")
    return judged(counts, "lang", "source").select("doc_id", *COUNTS, "base_failed", "kept", F.round("distance", 4).alias("distance"))
