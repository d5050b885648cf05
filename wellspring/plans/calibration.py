"""Calibration and observation queries over labels, documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.entities import MULTI
from ..operators import calibration as C
from .base import query

MEAS = """round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"""
CONF = "count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND NOT a) AS tn, count(*) FILTER (WHERE NOT p AND a) AS fn"
#: Samples: a text-derived score against the quality label.
SAMPLE = "s AS (SELECT doc_id, source, lang, quality = 1 AS a, least(100, n_chars / 20) AS score, least(100, n_chars / 20) >= 30 AS p FROM labels JOIN documents USING (doc_id))"


def samples(t):
    score = F.least(F.lit(100.0), F.col("n_chars") / 20)
    return t("labels").join(t("documents"), "doc_id").select("doc_id", "source", "lang", (F.col("quality") == 1).alias("a"), score.alias("score"), (score >= 30).alias("p"))


@query("confusion_mcc", f"WITH {SAMPLE}, c AS (SELECT lang, {CONF} FROM s GROUP BY lang) SELECT lang, tp, fp, tn, fn, {MEAS} FROM c")
def confusion_mcc(t):
    return C.measures(C.confusion(samples(t), ["lang"], F.col("p"), F.col("a")))


@query("f1_pearson_mae", f"WITH {SAMPLE} SELECT source, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(covar_pop(score, CAST(a AS INT)) / nullif(stddev_pop(score) * stddev_pop(CAST(a AS INT)), 0), 4) END AS pearson, round(avg(abs(score / 100 - CAST(a AS INT))), 6) AS mae, round(avg(CAST(p AND NOT a AS INT)), 6) AS optimism FROM s GROUP BY source")
def f1_pearson_mae(t):
    a = F.col("a").cast("int")
    return samples(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 5, F.round(F.try_divide(F.covar_pop("score", a.cast("double")), F.stddev_pop("score") * F.stddev_pop(a.cast("double"))), 4)).alias("pearson"), F.round(F.avg(F.abs(F.col("score") / 100 - a)), 6).alias("mae"), F.round(F.avg((F.col("p") & ~F.col("a")).cast("int")), 6).alias("optimism"))


#: Events as outcomes: type gives the outcome, value the accuracy.
EV = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def _ev(t):
    return t("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query("calibration_by_dimension", f"WITH {EV} SELECT coalesce(event_type, 'all') AS event_type, coalesce(k % 3, -1) AS difficulty, count(*) AS n, count(*) FILTER (WHERE value > 50) AS correct, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS accuracy FROM e GROUP BY GROUPING SETS ((event_type), (k % 3), (event_type, k % 3), ())")
def calibration_by_dimension(t):
    e = _ev(t).withColumn("difficulty", F.col("k") % 3)
    good = F.count_if(F.col("value") > 50)
    return e.groupingSets([["event_type"], ["difficulty"], ["event_type", "difficulty"], []], "event_type", "difficulty").agg(F.count(F.lit(1)).alias("n"), good.alias("correct"), F.round(good / F.count(F.lit(1)), 6).alias("accuracy")).withColumns({"event_type": F.coalesce("event_type", F.lit("all")), "difficulty": F.coalesce("difficulty", F.lit(-1))})


@query("outcome_rates", "SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 50) AS correct, round(coalesce(count(*) FILTER (WHERE value > 50) / nullif(count(*) FILTER (WHERE event_type <> 'view'), 0), 0), 6) AS rate FROM events GROUP BY user_id")
def outcome_rates(t):
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("correct"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("value") > 50), F.count_if(F.col("event_type") != "view")), F.lit(0.0)), 6).alias("rate"))


@query("drift_check", """WITH m AS (SELECT max(ts) AS as_of FROM events), w AS (SELECT CASE WHEN ts >= as_of - INTERVAL 7 DAY THEN 'recent' WHEN ts >= as_of - INTERVAL 30 DAY THEN 'base' END AS part, value FROM events, m),
a AS (SELECT count(*) FILTER (WHERE part = 'base') AS n_base, count(*) FILTER (WHERE part = 'recent') AS n_recent, avg(CAST(value > 50 AS INT)) FILTER (WHERE part = 'base') AS b, avg(CAST(value > 50 AS INT)) FILTER (WHERE part = 'recent') AS r FROM w)
SELECT n_base, n_recent, round(b, 6) AS base_accuracy, round(r, 6) AS recent_accuracy, n_base >= 50 AND n_recent >= 50 AND b - r > 0.10 AS drift FROM a""")
def drift_check(t):
    """The last 7 days against the 23 before, as of the latest event."""
    e = t("events")
    as_of = e.agg(F.max("ts").alias("as_of"))
    w = e.join(F.broadcast(as_of)).withColumn("part", F.when(F.col("ts") >= F.expr("as_of - INTERVAL 7 DAYS"), "recent").when(F.col("ts") >= F.expr("as_of - INTERVAL 30 DAYS"), "base"))
    ok = (F.col("value") > 50).cast("int")
    a = w.agg(F.count_if(F.col("part") == "base").alias("n_base"), F.count_if(F.col("part") == "recent").alias("n_recent"), F.avg(F.when(F.col("part") == "base", ok)).alias("b"), F.avg(F.when(F.col("part") == "recent", ok)).alias("r"))
    return a.select("n_base", "n_recent", F.round("b", 6).alias("base_accuracy"), F.round("r", 6).alias("recent_accuracy"), ((F.col("n_base") >= 50) & (F.col("n_recent") >= 50) & (F.col("b") - F.col("r") > 0.10)).alias("drift"))


PILL = ["technical", "structure", "schema", "authority", "entity", "retrieval", "coverage"]
PRIMES = (7, 11, 13, 17, 19, 23, 29)


@query("pillar_correlation", f"""WITH s AS (SELECT doc_id, quality = 1 AS a FROM labels), u AS ({' UNION ALL '.join(f"SELECT '{n}' AS pillar, (doc_id * {p}) % 101 AS score, a FROM s" for n, p in zip(PILL, PRIMES))}),
c AS (SELECT pillar, count(*) FILTER (WHERE score >= 70) AS n_high, count(*) FILTER (WHERE score < 50) AS n_low, avg(CAST(a AS INT)) FILTER (WHERE score >= 70) AS h, avg(CAST(a AS INT)) FILTER (WHERE score < 50) AS l FROM u GROUP BY pillar)
SELECT pillar, n_high, n_low, CASE WHEN n_high >= 10 AND n_low >= 10 THEN round(h - l, 6) END AS effect, n_high >= 10 AND n_low >= 10 AND abs(h - l) > 0.1 AS significant FROM c""")
def pillar_correlation(t):
    s = t("labels").select("doc_id", (F.col("quality") == 1).cast("int").alias("a"))
    u = s.select("a", F.explode(F.array(*[F.struct(F.lit(n).alias("pillar"), ((F.col("doc_id") * p) % 101).alias("score")) for n, p in zip(PILL, PRIMES)])).alias("p")).select("a", "p.*")
    c = u.groupBy("pillar").agg(F.count_if(F.col("score") >= 70).alias("n_high"), F.count_if(F.col("score") < 50).alias("n_low"), F.avg(F.when(F.col("score") >= 70, F.col("a"))).alias("h"), F.avg(F.when(F.col("score") < 50, F.col("a"))).alias("l"))
    ok = (F.col("n_high") >= 10) & (F.col("n_low") >= 10)
    return c.select("pillar", "n_high", "n_low", F.when(ok, F.round(F.col("h") - F.col("l"), 6)).alias("effect"), (ok & F.coalesce(F.abs(F.col("h") - F.col("l")) > 0.1, F.lit(False))).alias("significant"))


@query("threshold_grid_search", f"WITH {SAMPLE}, h AS (SELECT unnest(range(10, 91, 5)) AS threshold), c AS (SELECT threshold, {CONF} FROM (SELECT threshold, a, score >= threshold AS p FROM s, h) GROUP BY threshold) SELECT threshold, tp, fp, tn, fn, {MEAS} FROM c")
def threshold_grid_search(t):
    s = samples(t).withColumn("threshold", F.explode(F.sequence(F.lit(10), F.lit(90), F.lit(5)))).withColumn("p", F.col("score") >= F.col("threshold"))
    return C.measures(C.confusion(s, ["threshold"], F.col("p"), F.col("a"))).withColumn("threshold", F.col("threshold").cast("bigint"))


@query("domain_split", "WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY source), r AS (SELECT source, row_number() OVER (ORDER BY first, source) > count(*) OVER () - greatest(1, floor(count(*) OVER () * 0.2)) AS holdout FROM f) SELECT holdout, count(*) AS n, count(DISTINCT source) AS sites FROM documents JOIN r USING (source) GROUP BY holdout")
def domain_split(t):
    return C.split_sites(t("documents").select("doc_id", "source"), "source", "doc_id").groupBy("holdout").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sites"))


@query("per_domain_accuracy", f"WITH {SAMPLE}, d AS (SELECT source, count(*) AS n, avg(CAST(p = a AS INT)) AS acc FROM s GROUP BY source) SELECT source, n, round(acc, 6) AS accuracy, CASE WHEN acc >= 0.8 THEN 'high' WHEN acc >= 0.4 THEN 'middle' ELSE 'low' END AS tier FROM d")
def per_domain_accuracy(t):
    d = samples(t).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") == F.col("a")).cast("int")).alias("acc"))
    return d.select("source", "n", F.round("acc", 6).alias("accuracy"), F.when(F.col("acc") >= 0.8, "high").when(F.col("acc") >= 0.4, "middle").otherwise("low").alias("tier"))


ARM = "CASE WHEN list_reduce(list_transform(string_split(sha256(CAST(user_id AS VARCHAR)), ''), lambda c: instr('0123456789abcdef', c) - 1), lambda a, d: (a * 16 + d) % 10000) < 5000 THEN 'treatment' ELSE 'control' END"


@query("ab_assign", f"SELECT DISTINCT user_id, {ARM} AS arm FROM events")
def ab_assign(t):
    return t("events").select("user_id").distinct().select("user_id", C.arm(F.col("user_id").cast("string")).alias("arm"))


@query("ab_chi2", f"""WITH u AS (SELECT DISTINCT user_id, {ARM} AS arm FROM events), c AS (SELECT count(*) FILTER (WHERE arm = 'treatment' AND value > 50) AS a, count(*) FILTER (WHERE arm = 'treatment' AND value <= 50) AS b, count(*) FILTER (WHERE arm = 'control' AND value > 50) AS c, count(*) FILTER (WHERE arm = 'control' AND value <= 50) AS d FROM events JOIN u USING (user_id))
SELECT a, b, c, d, round((a + b + c + d)::DOUBLE * pow(greatest(0, abs(a::DOUBLE * d - b::DOUBLE * c) - (a + b + c + d) / 2), 2) / nullif((a + b)::DOUBLE * (c + d) * (a + c) * (b + d), 0), 6) AS chi2 FROM c""")
def ab_chi2(t):
    e = t("events").withColumn("arm", C.arm(F.col("user_id").cast("string")))
    tr, ok = F.col("arm") == "treatment", F.col("value") > 50
    c = e.agg(F.count_if(tr & ok).alias("a"), F.count_if(tr & ~ok).alias("b"), F.count_if(~tr & ok).alias("c"), F.count_if(~tr & ~ok).alias("d"))
    x = [F.col(k).cast("double") for k in "abcd"]
    return c.withColumn("chi2", F.round(C.chi_square(*x), 6))


@query("category_tier_accuracy", f"WITH {SAMPLE}, d AS (SELECT source FROM s GROUP BY source HAVING count(*) >= 5) SELECT lang, count(*) AS n, round(avg(CAST(p = a AS INT)), 6) AS accuracy FROM s WHERE source IN (SELECT source FROM d) GROUP BY lang")
def category_tier_accuracy(t):
    """Accuracy by language over sites with at least five samples (having, then a semi join)."""
    s = samples(t)
    many = s.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return s.join(many, "source", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") == F.col("a")).cast("int")), 6).alias("accuracy"))


# Observation: assistant turns as answers; the "company" is the most frequent long word of a conversation's first turn.
BRAND = "and"


@query("text_parser_flags", f"""SELECT conv_id, turn, contains(lower(text), '{BRAND}') AS mentioned, regexp_matches(text, 'https?://') AS has_url, len(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')) AS proper_nouns,
  CASE WHEN regexp_matches(lower(text), 'i cannot|i can''t|unable to') THEN 'refused' WHEN regexp_matches(lower(text), 'might|perhaps|possibly|may be') THEN 'hedged' ELSE 'plain' END AS tone FROM conversations WHERE role = 'assistant'""")
def text_parser_flags(t):
    c = t("conversations").filter("role = 'assistant'")
    low = F.lower("text")
    tone = F.when(low.rlike("i cannot|i can't|unable to"), "refused").when(low.rlike("might|perhaps|possibly|may be"), "hedged").otherwise("plain")
    return c.select("conv_id", "turn", F.contains(low, F.lit(BRAND)).alias("mentioned"), F.col("text").rlike("https?://").alias("has_url"), F.regexp_count("text", F.lit(MULTI)).cast("bigint").alias("proper_nouns"), tone.alias("tone"))


_POS = f"(instr(lower(text), '{BRAND}') - 1) / length(text)"


@query("mention_position", f"SELECT conv_id, turn, CASE WHEN instr(lower(text), '{BRAND}') = 0 THEN 'absent' WHEN {_POS} < 0.15 THEN 'opening' WHEN {_POS} < 0.70 THEN 'mid' ELSE 'closing' END AS position FROM conversations")
def mention_position(t):
    at = F.instr(F.lower("text"), BRAND)
    r = (at - 1) / F.length("text")
    return t("conversations").select("conv_id", "turn", F.when(at == 0, "absent").when(r < 0.15, "opening").when(r < 0.70, "mid").otherwise("closing").alias("position"))


_AUTH = rf"according to {BRAND}|{BRAND} (?:states?|explains?|notes?|reports?|defines?|describes?)|as {BRAND} (?:points out|highlights|emphasizes|mentions)|{BRAND}(?:'s| is) (?:the )?(?:leading|definitive|authoritative|official)|(?:the )?{BRAND} (?:documentation|guide|resource|platform) (?:is|provides|offers)"
_REC = rf"(?:i |we )?recommend (?:using |checking out |visiting )?{BRAND}|{BRAND} is (?:a |an )?(?:great|excellent|good|top|best|popular|well-known)|you (?:should|could|might want to) (?:use|try|check out|visit) {BRAND}|consider (?:using )?{BRAND}"
_LIST = rf"(?:companies|tools|platforms|services|providers) (?:like|such as|including) .*{BRAND}|{BRAND}(?:,| and| or) (?:\w+(?:,| and| or) )+|(?:\w+(?:,| and| or) )+{BRAND}"
_FRAME = f"CASE WHEN NOT contains(lower(text), '{BRAND}') THEN 'absent' WHEN regexp_matches(lower(text), '{_AUTH.replace(chr(39), chr(39) * 2)}') THEN 'authoritative' WHEN regexp_matches(lower(text), '{_REC}') THEN 'recommended' WHEN regexp_matches(lower(text), '{_LIST}') THEN 'listed' ELSE 'passing' END"


def framing(text):
    low = F.lower(text)
    return F.when(~F.contains(low, F.lit(BRAND)), "absent").when(low.rlike(_AUTH), "authoritative").when(low.rlike(_REC), "recommended").when(low.rlike(_LIST), "listed").otherwise("passing")


@query("brand_framing", f"SELECT conv_id, turn, {_FRAME} AS framing FROM conversations")
def brand_framing(t):
    return t("conversations").select("conv_id", "turn", framing(F.col("text")).alias("framing"))


@query("heuristic_depth", f"""WITH f AS (SELECT {_FRAME} AS framing, regexp_matches(text, 'https?://|@') AS url, len(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')) AS others FROM conversations),
b AS (SELECT others, least(5, CASE framing WHEN 'absent' THEN -9 WHEN 'authoritative' THEN 4 WHEN 'recommended' THEN 3 WHEN 'listed' THEN 1 ELSE 2 END + CAST(url AS INT)) AS base FROM f),
d AS (SELECT CASE WHEN base < 0 THEN 0 WHEN others >= 5 AND base > 2 THEN 2 WHEN others >= 3 AND base > 3 THEN 3 ELSE base END AS depth FROM b) SELECT depth, count(*) AS n FROM d GROUP BY depth""")
def heuristic_depth(t):
    f = t("conversations").select(framing(F.col("text")).alias("f"), F.col("text").rlike("https?://|@").cast("int").alias("url"), F.regexp_count("text", F.lit(MULTI)).alias("others"))
    base = F.least(F.lit(5), F.when(F.col("f") == "authoritative", 4).when(F.col("f") == "recommended", 3).when(F.col("f") == "listed", 1).otherwise(2) + F.col("url"))
    depth = F.when(F.col("f") == "absent", 0).when((F.col("others") >= 5) & (base > 2), 2).when((F.col("others") >= 3) & (base > 3), 3).otherwise(base)
    return f.select(depth.alias("depth")).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


#: Predictions by conversation, observations by its assistant turns; refused before cited before mentioned.
CMP = f"""sim AS (SELECT conv_id, max(CASE WHEN length(text) > 200 THEN 'answerable' ELSE 'not' END) AS sim FROM conversations WHERE role = 'user' GROUP BY conv_id),
obs AS (SELECT conv_id, bool_or(contains(lower(text), 'error')) AS refused, bool_or(regexp_matches(text, 'https?://|@')) AS cited, bool_or(contains(lower(text), '{BRAND}')) AS mentioned FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
j AS (SELECT conv_id, sim, CASE WHEN obs.conv_id IS NULL THEN 'unknown' WHEN refused THEN 'refused' WHEN cited THEN 'cited' WHEN mentioned THEN 'mentioned' ELSE 'omitted' END AS outcome FROM sim LEFT JOIN obs USING (conv_id))"""


def compared(t):
    c = t("conversations")
    sim = c.filter("role = 'user'").groupBy("conv_id").agg(F.when(F.max((F.length("text") > 200).cast("int")) == 1, F.lit("x")).alias("_x"), F.max(F.when(F.length("text") > 200, "answerable").otherwise("not")).alias("sim")).drop("_x")
    low = F.lower("text")
    obs = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.bool_or(F.contains(low, F.lit("error"))).alias("refused"), F.bool_or(F.col("text").rlike("https?://|@")).alias("cited"), F.bool_or(F.contains(low, F.lit(BRAND))).alias("mentioned"), F.lit(True).alias("there"))
    j = sim.join(obs, "conv_id", "left")
    return j.select("conv_id", "sim", F.when(F.col("there").isNull(), "unknown").when(F.col("refused"), "refused").when(F.col("cited"), "cited").when(F.col("mentioned"), "mentioned").otherwise("omitted").alias("outcome"))


VERDICT = "CASE WHEN outcome = 'unknown' THEN 'unknown' WHEN (sim = 'answerable') = (outcome IN ('cited', 'mentioned')) THEN 'correct' WHEN sim = 'answerable' THEN 'optimistic' ELSE 'pessimistic' END"


@query("sim_obs_compare", f"WITH {CMP}, v AS (SELECT {VERDICT} AS verdict FROM j) SELECT verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM v GROUP BY verdict")
def sim_obs_compare(t):
    v = compared(t).select(F.expr(VERDICT).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    return v.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("depth_summary", f"WITH {CMP} SELECT sim, outcome, count(*) AS n FROM j GROUP BY ALL")
def depth_summary(t):
    return compared(t).groupBy("sim", "outcome").agg(F.count(F.lit(1)).alias("n"))


#: Benchmark: user 0 is "you", users 1 to 3 competitors, event types the questions; a win is a larger mean value.
HEAD = "q AS (SELECT event_type AS question, user_id % 4 AS player, avg(value) AS v FROM events GROUP BY ALL), y AS (SELECT question, v AS mine FROM q WHERE player = 0), h AS (SELECT question, player, mine, v, CASE WHEN round(mine - v, 6) > 1 THEN 'win' WHEN round(mine - v, 6) < -1 THEN 'loss' ELSE 'tie' END AS outcome FROM y JOIN q USING (question) WHERE player > 0)"


def duels(t):
    q = t("events").groupBy(F.col("event_type").alias("question"), (F.col("user_id") % 4).alias("player")).agg(F.avg("value").alias("v"))
    y = q.filter("player = 0").select("question", F.col("v").alias("mine"))
    d = F.round(F.col("mine") - F.col("v"), 6)
    return y.join(q.filter("player > 0"), "question").withColumn("outcome", F.when(d > 1, "win").when(d < -1, "loss").otherwise("tie"))


@query("competitor_benchmark", f"WITH {HEAD} SELECT question, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses, count(*) FILTER (WHERE outcome = 'tie') AS ties, bool_and(outcome = 'win') AS unique_win FROM h GROUP BY question")
def competitor_benchmark(t):
    return duels(t).groupBy("question").agg(F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses"), F.count_if(F.col("outcome") == "tie").alias("ties"), F.bool_and(F.col("outcome") == "win").alias("unique_win"))


@query("head_to_head", f"WITH {HEAD} SELECT player, count(*) AS questions, round(count(*) FILTER (WHERE outcome = 'win') / count(*), 6) AS win_rate FROM h GROUP BY player")
def head_to_head(t):
    return duels(t).groupBy("player").agg(F.count(F.lit(1)).alias("questions"), F.round(F.count_if(F.col("outcome") == "win") / F.count(F.lit(1)), 6).alias("win_rate"))


@query("rank_v2", "WITH s AS (SELECT user_id % 10 AS player, round(sum(value), 2) AS total FROM events GROUP BY 1) SELECT player, total, rank() OVER (ORDER BY total DESC) AS rank, round(avg(total) OVER () , 4) AS mean FROM s")
def rank_v2(t):
    s = t("events").groupBy((F.col("user_id") % 10).alias("player")).agg(F.round(F.sum("value"), 2).alias("total"))
    return s.withColumn("rank", F.rank().over(Window.orderBy(F.desc("total"))).cast("bigint")).withColumn("mean", F.round(F.avg("total").over(Window.partitionBy()), 4))


@query("site_citation_rate", r"""WITH c AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org)')) AS d FROM conversations), q AS (SELECT conv_id, bool_or(d = 'example.com' OR ends_with(d, '.example.com')) AS hit, count(*) AS n FROM c GROUP BY conv_id) SELECT count(*) AS queries, count(*) FILTER (WHERE hit) AS cited FROM q""")
def site_citation_rate(t):
    """Conversations that name any domain, and those that name the site or a subdomain of it."""
    d = t("conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org)"), 0)).alias("d"))
    q = d.groupBy("conv_id").agg(F.bool_or((F.col("d") == "example.com") | F.endswith("d", F.lit(".example.com"))).alias("hit"))
    return q.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("hit")).alias("cited"))
