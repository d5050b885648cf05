"""Question generation over the sites of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import schema as S
from ..functions import urls as U
from ..operators import questions as Q
from .base import query
from .pages import HEADS
from .texts import HOST

_V = lambda *x: "(" + ", ".join(f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v) for v in x) + ")"
_FIT = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN {i}" for i, (p, _, _) in enumerate(Q.BY_HEADING)) + " END"


@query("question_expand", f"SELECT DISTINCT site, id, replace(q, '{{company}}', site) AS question, category, weight::DOUBLE AS weight FROM (SELECT {HOST} AS site FROM pages), (VALUES {', '.join(_V(i, q, c, w) for i, q, c, _, w in Q.UNIVERSAL)}) u(id, q, category, weight)")
def question_expand(t):
    """Each site's fifteen universal questions: templates are a literal array, exploded per site."""
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(q).alias("q"), F.lit(c).alias("category"), F.lit(w).alias("weight")) for i, q, c, _, w in Q.UNIVERSAL])
    x = sites(t).select("site", F.explode(rows).alias("u"))
    return x.select("site", "u.id", F.replace(F.col("u.q"), F.lit("{company}"), F.col("site")).alias("question"), "u.category", "u.weight")


def site():
    return F.coalesce(U.domain(F.col("url")), F.lit("")).alias("site")


def sites(t):
    return t("pages").select(site()).distinct().withColumn("company", F.col("site"))


@query("generated_questions", f"""WITH {HEADS}, hp AS (SELECT {HOST} AS site, level, page_id, pos, {_FIT} AS pattern FROM h JOIN pages USING (page_id) WHERE level <= 3),
hq AS (SELECT site, pattern, row_number() OVER (PARTITION BY site ORDER BY level, page_id, pos) AS n FROM hp WHERE pattern IS NOT NULL),
t AS (SELECT * FROM (VALUES {', '.join(_V(i, q, c) for i, (_, q, c) in enumerate(Q.BY_HEADING))}) v(pattern, q, category)),
s AS (SELECT DISTINCT {HOST} AS site FROM pages),
a AS (SELECT site, n, replace(q, '{{company}}', site) AS question, source, category, difficulty, weight::DOUBLE AS weight FROM s, (VALUES {', '.join(_V(k, q, 'universal', c, d, w) for k, (_, q, c, d, w) in enumerate(Q.UNIVERSAL))}) u(n, q, source, category, difficulty, weight)
  UNION ALL SELECT site, 100 + n, replace(q, '{{company}}', site), 'heading', category, 'medium', {Q.HEADING_WEIGHT} FROM hq JOIN t USING (pattern) WHERE n <= {Q.MAX_HEADINGS}),
d AS (SELECT *, row_number() OVER (PARTITION BY site, lower(question) ORDER BY n) AS k FROM a)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY n) AS number, question, source, category, difficulty, weight FROM d WHERE k = 1""")
def generated_questions(t):
    """Every site's questions from universal templates, structured data and headings."""
    p = t("pages").select("page_id", site(), "html")
    heads = p.select("page_id", "site", F.posexplode(H.headings(F.col("html"))).alias("pos", "h")).select("site", "h.level", F.struct("page_id", "pos").alias("place"), "h.text")
    types = S.all_instances(t("pages")).join(p.select("page_id", "site"), "page_id").select("site", "type", F.struct("page_id", "at").alias("place"))
    return Q.generated(sites(t), types, heads)
