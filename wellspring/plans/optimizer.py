"""Calibration search queries: samples are labelled documents with seven scores measured on their texts, or events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators import optimizer as O
from .base import query

P = O.PILLARS

#: Integer scores 0..100 of a text. One-line texts have no structure and no schema score, and so fall short of the coverage.
SCORES = {
    "technical": "greatest(0, 100 - 1000 * symbols {div} greatest(n_chars, 1))",
    "structure": "CASE WHEN lines > 1 THEN least(100, 10 * lines) END",
    "schema": "CASE WHEN lines > 1 THEN least(100, 100 * stops {div} lines) END",
    "authority": "least(100, 25 * digits)",
    "entity_recognition": "least(100, 300 * capitals {div} words)",
    "retrieval": "100 * different {div} words",
    "coverage": "least(100, n_chars {div} 50)",
    "primacy": "100 {div} copies",
}
COUNTS = {"symbols": "[#*$%&|<>]", "stops": "[.](\\n|$)", "digits": "[0-9]+", "capitals": "[A-Z][a-z]"}

SAMPLES = f"""
measured AS (
  SELECT d.source AS site, d.doc_id AS created, l.quality = 1 AS cited, d.n_chars, {", ".join(f"len(regexp_extract_all(d.text, '{p}')) AS {n}" for n, p in COUNTS.items())},
         len(string_split(d.text, chr(10))) AS lines, len(string_split(d.text, ' ')) AS words, len(list_distinct(string_split(d.text, ' '))) AS different,
         count(*) OVER (PARTITION BY md5(d.text)) AS copies
  FROM documents d JOIN labels l USING (doc_id)
), samples AS (
  SELECT site, created, cited, {", ".join(f"{e.format(div='//')} AS {n}" for n, e in SCORES.items())} FROM measured
), whole_samples AS (
  SELECT * FROM samples WHERE {" + ".join(f"CASE WHEN {n} IS NOT NULL THEN {w} ELSE 0 END" for n, w in O.DEFAULTS.items())} >= {O.MIN_COVERAGE}
), sites AS (
  SELECT site, row_number() OVER (ORDER BY min(created), site) > count(*) OVER () - greatest(1, floor(count(*) OVER () * 0.2)) AS holdout FROM whole_samples GROUP BY site
), train AS (
  SELECT w.* FROM whole_samples w JOIN sites USING (site) WHERE NOT holdout
)"""


def samples(t):
    """Labelled documents with site, created, cited, the seven scores and primacy."""
    text = F.col("text")
    d = t("documents").join(t("labels"), "doc_id").withColumns({n: F.regexp_count(text, F.lit(p)) for n, p in COUNTS.items()})
    words = F.split(text, " ")
    d = d.withColumns({"lines": F.size(F.split(text, "\n")), "words": F.size(words), "different": F.size(F.array_distinct(words)), "_hash": F.md5(text.cast("binary"))})
    copies = d.groupBy("_hash").agg(F.count(F.lit(1)).alias("copies"))
    d = d.drop("text").join(copies, "_hash")
    return d.select(F.col("source").alias("site"), F.col("doc_id").alias("created"), (F.col("quality") == 1).alias("cited"), *[F.expr(e.format(div="div")).cast("int").alias(n) for n, e in SCORES.items()])


def train(t):
    return C.split_sites(O.covered(samples(t)), "site", "created").filter("not holdout")


# Lattices around each site's own weights: its mean scores as shares of their sum.

CENTERS = f"""means AS (
  SELECT site, {", ".join(f"avg(coalesce({n}, 0)) AS m_{n}" for n in P)} FROM samples GROUP BY site
), centers AS (
  SELECT site, {", ".join(f"CAST(least({O.MOST}, greatest({O.LEAST}, floor(round(100 * m_{n} / ({' + '.join('m_' + x for x in P)}), 6)))) AS INT) AS {n}" for n in P)} FROM means
)"""


def centers(t):
    m = samples(t).groupBy("site").agg(*[F.avg(F.coalesce(F.col(n), F.lit(0))).alias(f"m_{n}") for n in P])
    total = sum((F.col(f"m_{n}") for n in P[1:]), F.col(f"m_{P[0]}"))
    return m.select("site", *[F.least(F.lit(O.MOST), F.greatest(F.lit(O.LEAST), F.floor(F.round(100 * F.col(f"m_{n}") / total, 6)))).cast("int").alias(n) for n in P])


def _lattice_sql(kind: str, low: str, high: str, step: int) -> str:
    """Counts of lattice rows and the sum of their first weights, by partial sums instead of rows."""
    out = f"{kind}0 AS (SELECT site, 0 AS s, 0::BIGINT AS first, 1::BIGINT AS n FROM centers)"
    for i, p in enumerate(P):
        v = "v" if i == 0 else "0"
        out += f""", {kind}{i + 1} AS (SELECT a.site, a.s + v AS s, sum(a.first + a.n * {v})::BIGINT AS first, sum(a.n)::BIGINT AS n
          FROM {kind}{i} a JOIN centers c USING (site), unnest(range(({low.format(p=p)})::BIGINT, ({high.format(p=p)})::BIGINT + 1, {step})) u(v) GROUP BY ALL)"""
    return out + f", {kind} AS (SELECT site, '{kind}' AS kind, n AS n_rows, first AS first_weights FROM {kind}7 WHERE s = 100)"


def _near_sql(radius: int, step: int) -> tuple[str, str]:
    low = f"greatest({O.LEAST}, ceil(greatest({O.LEAST}, c.{{p}} - {radius}) / {step}.0) * {step})"
    return (f"ceil({low} / {step}.0) * {step}", f"floor(least({O.MOST}, c.{{p}} + {radius}) / {step}.0) * {step}")


@query("weight_grid_count", f"""WITH {SAMPLES}, {CENTERS}, {_lattice_sql("full_grid", str(O.LEAST), str(O.MOST), 5)}, {_lattice_sql("within_10_by_5", *_near_sql(10, 5), 5)}, {_lattice_sql("within_10_by_2", *_near_sql(10, 2), 2)}
SELECT * FROM full_grid UNION ALL SELECT * FROM within_10_by_5 UNION ALL SELECT * FROM within_10_by_2""")
def weight_grid_count(t):
    """Rows of the full grid and of the grids near each site's weights, enumerated and counted."""
    c = centers(t)
    c = c.repartition(c.sparkSession.sparkContext.defaultParallelism)  # few rows, many grid rows each
    full = c.select("site", *[F.lit(v).alias(f"{e}_{n}") for n in P for e, v in (("lo", O.LEAST), ("hi", O.MOST))])
    out = None
    for kind, bounds, step in (("full_grid", full, 5), ("within_10_by_5", O.around(c, P, 10, 5), 5), ("within_10_by_2", O.around(c, P, 10, 2), 2)):
        g = O.lattice(bounds, P, step).groupBy("site").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(P[0]).cast("bigint").alias("first_weights"))
        g = g.select("site", F.lit(kind).alias("kind"), "n_rows", "first_weights")
        out = g if out is None else out.union(g)
    return out


def _grid_sql() -> str:
    tables = ", ".join(f"(SELECT unnest(range({O.LEAST}, {O.MOST} + 1, 5)) AS w{i})" for i in range(7))
    return f"grid AS (SELECT * FROM {tables} WHERE {' + '.join(f'w{i}' for i in range(7))} = 100)"


_FOUND = ", ".join(f"sum(n) FILTER (WHERE cited = {c} AND (v >= {100 * h}) = {f}) AS {k}{h}" for h in O.THRESHOLDS for k, c, f in (("tp", "true", "true"), ("fp", "false", "true"), ("tn", "false", "false"), ("fn", "true", "false")))
_LONG = " UNION ALL ".join(f"SELECT {', '.join(f'w{i}' for i in range(7))}, bonus, {h} AS threshold, {', '.join(f'coalesce({k}{h}, 0)::BIGINT AS {k}' for k in ('tp', 'fp', 'tn', 'fn'))} FROM cells" for h in O.THRESHOLDS)
_BELOW = "((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))"


@query("weight_grid_search", f"""WITH {SAMPLES}, {_grid_sql()}, vectors AS (SELECT {", ".join(f"coalesce({n}, 0) AS {n}" for n in P)}, primacy, cited, count(*) AS n FROM train GROUP BY ALL),
scored AS (SELECT {", ".join(f"w{i}" for i in range(7))}, primacy, cited, n, {" + ".join(f"w{i} * {n}" for i, n in enumerate(P))} AS s FROM grid, vectors),
cells AS (SELECT {", ".join(f"w{i}" for i in range(7))}, bonus, {_FOUND} FROM (SELECT *, s + bonus * primacy AS v FROM scored, (SELECT unnest({O.BONUSES}) AS bonus)) GROUP BY ALL),
long AS ({_LONG}), m AS (SELECT *, round(CASE WHEN {_BELOW} = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt({_BELOW}) END, 12) AS mcc FROM long),
r AS (SELECT *, row_number() OVER (PARTITION BY threshold ORDER BY mcc DESC, {", ".join(f"w{i}" for i in range(7))}, bonus) AS r FROM m)
SELECT threshold::BIGINT AS threshold, {", ".join(f"w{i}::BIGINT AS w_{n}" for i, n in enumerate(P))}, bonus::BIGINT AS bonus, tp, fp, tn, fn, mcc FROM r WHERE r = 1""")
def weight_grid_search(t):
    """The best of all 20,664 weight rows and five bonuses at each of seven thresholds, over the training sites."""
    s = train(t)
    grid = O.numbers(O.lattice(O.whole(s.sparkSession), P, 5), P)
    found = O.counts(s, grid, O.THRESHOLDS, O.BONUSES).withColumn("mcc", O.mcc())
    key = F.struct(F.col("mcc"), -F.col("code"), -F.col("bonus"))
    top = found.groupBy("threshold").agg(F.max_by(F.struct("code", "bonus", "tp", "fp", "tn", "fn", "mcc"), key).alias("r")).select("threshold", "r.*")
    return top.select(F.col("threshold").cast("bigint").alias("threshold"), *[O.weight(i).alias(f"w_{n}") for i, n in enumerate(P)], F.col("bonus").cast("bigint").alias("bonus"), "tp", "fp", "tn", "fn", "mcc")


@query("weight_joint_search")
def weight_joint_search(t):
    """Coarse-to-fine search with held-out sites, one row; error says why there is none."""
    s = samples(t)
    r = O.optimize(s)
    row = (r["error"], r["training"], r["held_out"], r.get("tested"), *[r["weights"][n] if "weights" in r else None for n in P], *[r.get(k) for k in ("threshold", "bonus", "start_mcc", "mcc", "held_out_accuracy", "held_out_adjusted")])
    ddl = "error string, training bigint, held_out bigint, tested bigint, " + ", ".join(f"w_{n} bigint" for n in P) + ", threshold bigint, bonus bigint, start_mcc double, mcc double, held_out_accuracy double, held_out_adjusted double"
    return s.sparkSession.createDataFrame([row], ddl)


_SCORE = lambda w, b: " + ".join(f"coalesce({n}, 0) * {w(n)}" for n in P) + f" + coalesce(primacy, 0) * {b}"
_RATES = f"""round(coalesce((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 0), 12) AS accuracy, round(CASE WHEN {_BELOW} = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt({_BELOW}) END, 12) AS mcc"""
_CONF = "count(*) FILTER (WHERE p AND cited) AS tp, count(*) FILTER (WHERE p AND NOT cited) AS fp, count(*) FILTER (WHERE NOT p AND NOT cited) AS tn, count(*) FILTER (WHERE NOT p AND cited) AS fn"


@query("config_validation", f"""WITH {SAMPLES}, {CENTERS},
both_ways AS (SELECT w.site, 'own' AS config, ({" + ".join(f"coalesce(w.{n}, 0) * c.{n}" for n in P)}) >= {100 * O.START_THRESHOLD} AS p, cited FROM whole_samples w JOIN centers c USING (site)
  UNION ALL SELECT site, 'default', ({_SCORE(lambda n: O.DEFAULTS[n], 0)}) >= {100 * O.START_THRESHOLD}, cited FROM whole_samples),
m AS (SELECT site, config, {_CONF} FROM both_ways GROUP BY ALL), r AS (SELECT *, {_RATES} FROM m)
SELECT site, (o.tp + o.fp + o.tn + o.fn)::BIGINT AS samples, o.accuracy AS config_accuracy, d.accuracy AS baseline_accuracy, round(o.accuracy - d.accuracy, 6) AS improvement, o.accuracy > d.accuracy AS is_improvement,
  (o.tp + o.fp + o.tn + o.fn) >= 10 AS valid FROM (SELECT * FROM r WHERE config = 'own') o JOIN (SELECT * FROM r WHERE config = 'default') d USING (site)""")
def config_validation(t):
    """Each site's own weights against the defaults over its samples; fewer than ten samples do not validate."""
    own = centers(t).select("site", *[F.col(n).alias(f"w_{n}") for n in P])
    x = O.covered(samples(t)).join(F.broadcast(own), "site")  # one row a site
    x = x.withColumn("p_own", O.weighted({n: F.col(f"w_{n}") for n in P}, F.lit(0)) >= 100 * O.START_THRESHOLD)
    x = x.withColumn("p_default", O.weighted({n: F.lit(w) for n, w in O.DEFAULTS.items()}, F.lit(0)) >= 100 * O.START_THRESHOLD)
    right = lambda p: F.round(F.avg((F.col(p) == F.col("cited")).cast("int")), 12)
    a = x.groupBy("site").agg(F.count(F.lit(1)).alias("samples"), right("p_own").alias("config_accuracy"), right("p_default").alias("baseline_accuracy"))
    gain = F.col("config_accuracy") - F.col("baseline_accuracy")
    return a.withColumns({"improvement": F.round(gain, 6), "is_improvement": gain > 0, "valid": F.col("samples") >= 10})


# Events as observed predictions: value is the score in hundredths; purchases are cited (2), clicks and signups mentioned (1), views neither (0),
# errors have no outcome.

_EV = """outcomes AS (SELECT ts, event_id, value, CASE event_type WHEN 'purchase' THEN 2 WHEN 'view' THEN 0 ELSE 1 END AS actual FROM events WHERE event_type <> 'error'),
split AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) > count(*) OVER () - CAST(floor(count(*) OVER () * 0.2) AS BIGINT) AS holdout FROM outcomes)"""


def outcomes(t):
    e = t("events").filter("event_type <> 'error'")
    kind = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "view", 0).otherwise(1)
    return e.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "value", kind.alias("actual"))


@query("class_threshold_search", f"""WITH {_EV}, pairs(i, f, p) AS (VALUES {", ".join(f"({i}, {f}, {p})" for i, (f, p) in enumerate(O.CLASS_THRESHOLDS))}),
said AS (SELECT i, f, p, holdout, abs(CASE WHEN value >= f THEN 2 WHEN value >= p THEN 1 ELSE 0 END - actual) AS off FROM split, pairs),
a AS (SELECT i, f, p, round(sum(CASE off WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0 END) FILTER (WHERE NOT holdout) / count(*) FILTER (WHERE NOT holdout), 12) AS accuracy,
  round(sum(CASE off WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5 ELSE 0 END) FILTER (WHERE holdout) / count(*) FILTER (WHERE holdout), 12) AS held_out_accuracy FROM said GROUP BY ALL)
SELECT f::BIGINT AS full, p::BIGINT AS part, accuracy, held_out_accuracy, row_number() OVER (ORDER BY accuracy DESC, f = {O.CLASS_START[0]} AND p = {O.CLASS_START[1]} DESC, i) = 1 AS best FROM a""")
def class_threshold_search(t):
    """Three-class thresholds scored on the earlier four fifths of the outcomes and on the last fifth."""
    s = O.tail_split(outcomes(t), ["at", "event_id"])
    a = O.class_accuracy(s, F.col("value"), F.col("actual"), ["holdout"], O.CLASS_THRESHOLDS)
    a = a.groupBy("full", "part").agg(F.max(F.when(~F.col("holdout"), F.col("accuracy"))).alias("accuracy"), F.max(F.when(F.col("holdout"), F.col("accuracy"))).alias("held_out_accuracy"))
    start = (F.col("full") == O.CLASS_START[0]) & (F.col("part") == O.CLASS_START[1])
    key = F.struct(F.col("accuracy"), start.cast("int").alias("s"), -F.col("full"), -F.col("part"))
    top = a.agg(F.max_by(F.struct("full", "part"), key).alias("top"))
    best = (F.col("full") == F.col("top.full")) & (F.col("part") == F.col("top.part"))
    return a.join(F.broadcast(top)).select(F.col("full").cast("bigint").alias("full"), F.col("part").cast("bigint").alias("part"), "accuracy", "held_out_accuracy", best.alias("best"))


_ARM = "CASE WHEN list_reduce(list_transform(string_split(sha256(CAST(user_id AS VARCHAR)), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, d: (a * 16 + d) % 10000) < 5000 THEN 'treatment' ELSE 'control' END"
_EXP = "(treatment_right + control_right)::DOUBLE * treatment_n / (treatment_n + control_n)"
_N = "(treatment_n + control_n)::DOUBLE"
_GAP = f"greatest(0, abs(treatment_right - {_EXP}) - least(0.5::DOUBLE, abs(treatment_right - {_EXP})))"
#: erfc by the trapezoid rule on exp(-x^2 / sin^2) over a quarter circle, which converges at once (Craig's form).
_ERFC = "(2 / pi()) * (pi() / 2 / 400) * (list_sum(list_transform(range(1, 400), lambda k: exp(-x * x / pow(sin(pi() / 2 * k / 400), 2)))) + exp(-x * x) / 2 + CASE WHEN x = 0 THEN 0.5 ELSE 0 END)"


@query("ab_analysis", f"""WITH users AS (SELECT DISTINCT user_id FROM events), arms AS (SELECT user_id, {_ARM} AS arm FROM users),
s AS (SELECT CAST(ts AS DATE) AS day, arm, (value >= 50) = (event_type IN ('purchase', 'signup')) AS ok FROM events JOIN arms USING (user_id) WHERE event_type <> 'error'),
c AS (SELECT day, count(*) FILTER (WHERE arm = 'control') AS control_n, count(*) FILTER (WHERE arm = 'control' AND ok) AS control_right, count(*) FILTER (WHERE arm = 'treatment') AS treatment_n, count(*) FILTER (WHERE arm = 'treatment' AND ok) AS treatment_right FROM s GROUP BY day),
x AS (SELECT *, CASE WHEN control_n >= {O.MIN_ARM} AND treatment_n >= {O.MIN_ARM} THEN pow({_GAP}, 2) * pow({_N}, 3) / nullif(treatment_n::DOUBLE * control_n * (treatment_right + control_right) * ({_N} - treatment_right - control_right), 0) END AS chi2,
  treatment_right / treatment_n - control_right / control_n AS diff FROM c), p AS (SELECT *, sqrt(chi2 / 2) AS x FROM x), q AS (SELECT *, CASE WHEN chi2 IS NOT NULL THEN {_ERFC} END AS pv FROM p)
SELECT CAST(day AS VARCHAR) AS day, control_n, treatment_n, round(diff, 6) AS difference, round(chi2, 6) AS chi2, round(pv, 8) AS p_value, coalesce(pv < 0.05, false) AS significant,
  CASE WHEN control_n >= 30 AND treatment_n >= 30 THEN CASE WHEN NOT coalesce(pv < 0.05, false) THEN 'none' WHEN diff > 0 THEN 'treatment' ELSE 'control' END END AS winner FROM q""")
def ab_analysis(t):
    """One experiment a day: whether a high value told a purchase or signup, by arm of the user."""
    e = t("events").filter("event_type <> 'error'").withColumn("arm", C.arm(F.col("user_id").cast("string")))
    ok, control = (F.col("value") >= 50) == F.col("event_type").isin("purchase", "signup"), F.col("arm") == "control"
    a = e.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(control).alias("control_n"), F.count_if(control & ok).alias("control_right"), F.count_if(~control).alias("treatment_n"), F.count_if(~control & ok).alias("treatment_right"))
    r = O.experiment(a)
    return r.select(F.col("day").cast("string").alias("day"), "control_n", "treatment_n", F.round("difference", 6).alias("difference"), F.round("chi2", 6).alias("chi2"), F.round("p_value", 8).alias("p_value"), "significant", "winner")


@query("calibration_health", f"""WITH {SAMPLES}, f AS (SELECT site, ({_SCORE(lambda n: O.DEFAULTS[n], 0)}) >= {100 * O.START_THRESHOLD} AS p, cited FROM whole_samples), c AS (SELECT site, {_CONF} FROM f GROUP BY site),
r AS (SELECT site, tp + fp + tn + fn AS n, (tp + tn) / (tp + fp + tn + fn) AS a, fp / (tp + fp + tn + fn) AS o, fn / (tp + fp + tn + fn) AS u FROM c)
SELECT site, n AS samples, round(a, 6) AS accuracy, CASE WHEN n < 20 THEN 'insufficient_data' WHEN a >= 0.75 AND o <= 0.15 AND u <= 0.15 THEN 'healthy' WHEN a >= 0.6 AND o <= 0.25 AND u <= 0.25 THEN 'acceptable' ELSE 'needs_attention' END AS status,
array_to_string(list_filter([CASE WHEN a < 0.6 THEN 'accuracy:high' WHEN a < 0.75 THEN 'accuracy:medium' END, CASE WHEN o > 0.25 THEN 'optimism:high' WHEN o > 0.15 THEN 'optimism:medium' END, CASE WHEN u > 0.25 THEN 'pessimism:high' WHEN u > 0.15 THEN 'pessimism:medium' END], lambda x: x IS NOT NULL), ',') AS advice FROM r""")
def calibration_health(t):
    """Whether each site's predictions hold under the default weights, and what to look at; below twenty samples nothing is said of the status."""
    found = O.weighted({n: F.lit(w) for n, w in O.DEFAULTS.items()}, F.lit(0)) >= 100 * O.START_THRESHOLD
    h = O.health(O.rates(O.confusion(O.covered(samples(t)), found, ["site"])))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return h.select("site", n.alias("samples"), F.round("accuracy", 6).alias("accuracy"), F.when(n < 20, "insufficient_data").otherwise(F.col("status")).alias("status"), F.array_join("advice", ",").alias("advice"))
