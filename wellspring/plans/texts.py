"""Text and URL queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import retrieval as R
from .base import query
from .retrieval import TOK

PART = r"regexp_extract(trim(url), '^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?', {0})"
HOST = f"regexp_replace(regexp_replace(lower({PART.format(2)}), '^www\\.', ''), ':.*$', '')"


def _types(p: str) -> str:
    return " ".join(f"WHEN regexp_matches({p}, '{pattern}') THEN '{name}'" for name, pattern in U.PAGE_TYPES)


@query("url_domain_depth", rf"""SELECT page_id, nullif({HOST}, '') AS domain,
  CAST(CASE WHEN regexp_replace({PART.format(3)}, '^/+|/+$', '', 'g') = '' THEN 0 ELSE len(string_split(regexp_replace({PART.format(3)}, '^/+|/+$', '', 'g'), '/')) END AS BIGINT) AS depth,
  ({HOST} = 'example.com' OR ends_with({HOST}, '.example.com')) AS internal FROM pages""")
def url_domain_depth(t):
    u = F.col("url")
    return t("pages").select("page_id", U.domain(u).alias("domain"), U.depth(u).alias("depth"), U.is_internal(u, F.lit("www.Example.com")).alias("internal"))


@query("url_surface", rf"""SELECT CASE WHEN regexp_matches(regexp_replace(lower({PART.format(2)}), ':.*$', ''), '{U.DOCS_HOST}') OR regexp_matches(lower({PART.format(3)}), '{U.DOCS_PATH}') THEN 'docs' ELSE 'marketing' END AS surface, count(*) AS n FROM pages GROUP BY 1""")
def url_surface(t):
    return t("pages").groupBy(U.surface(F.col("url")).alias("surface")).agg(F.count(F.lit(1)).alias("n"))


_NORM = rf"""WITH p AS (SELECT page_id, trim(url) AS url, {PART.format(2)} AS h, {PART.format(3)} AS p, {PART.format(4)} AS q FROM pages),
kv AS (SELECT page_id, x, i, regexp_extract(x, '^[^=]*') AS k FROM (SELECT page_id, unnest(string_split(q, '&')) AS x, unnest(range(len(string_split(q, '&')))) AS i FROM p) WHERE regexp_matches(x, '^[^=]+=.') AND lower(regexp_extract(x, '^[^=]*')) NOT IN ({', '.join(f"'{x}'" for x in U.STRIP_PARAMS)})),
qs AS (SELECT page_id, string_agg(x, '&' ORDER BY k, i) AS q FROM kv GROUP BY page_id)
SELECT p.page_id, CASE WHEN h = '' OR regexp_matches(lower(p), '({'|'.join(e.replace('.', '[.]') for e in U.SKIP_ENDINGS)})$') OR regexp_matches(url, '{U.SKIP_URL}') THEN NULL
  ELSE 'https://' || regexp_replace(regexp_replace(lower(h), '^www[.]', ''), ':443|:80', '', 'g') || CASE WHEN p = '' OR regexp_matches(p, '^/+$') THEN '/' ELSE regexp_replace(p, '/+$', '') END || coalesce('?' || qs.q, '') END AS normalized
FROM p LEFT JOIN qs USING (page_id)"""


@query("url_normalize", _NORM)
def url_normalize(t):
    return t("pages").select("page_id", U.normalize(F.col("url")).alias("normalized"))


@query("page_type", f"SELECT page_id, CASE WHEN lower({PART.format(3)}) IN ('', '/', '/index.html', '/index.php') THEN 'homepage' {_types(f'lower({PART.format(3)})')} ELSE 'unknown' END AS page_type FROM pages")
def page_type(t):
    return t("pages").select("page_id", U.page_type(F.col("url")).alias("page_type"))


HASH = r"substr(md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 1, 12)"


@query("content_hash_dedupe", f"SELECT h AS hash, source, doc_id, new_index FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS new_index FROM (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS n FROM (SELECT doc_id, source, {HASH} AS h FROM documents)) WHERE n = 1)")
def content_hash_dedupe(t):
    d = t("documents").select("doc_id", "source", X.content_hash(F.col("text")).alias("hash"))
    first = d.groupBy("source", "hash").agg(F.min("doc_id").alias("doc_id"))
    return first.withColumn("new_index", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("bigint"))


_SPLIT = r"CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END"


@query("token_estimate", f"SELECT doc_id, CAST(floor(({_SPLIT}) * 13 / 10.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(t):
    return t("documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


_LINES = "string_split(trim(text, ' '), chr(10))"


def _most(pattern: str) -> str:
    return f"len(list_filter({_LINES}, lambda x: regexp_matches(x, '{pattern}'))) > 0.5 * len({_LINES})"


@query("chunk_type", rf"""SELECT doc_id, CASE WHEN contains(text, '```') THEN 'code' WHEN len({_LINES}) >= 2 AND {_most('[|]')} THEN 'table'
  WHEN len({_LINES}) >= 2 AND {_most(r'^\s*([-*•]|\d+[.)])\s')} THEN 'list' WHEN {_most(r'^\s*>')} THEN 'quote'
  WHEN len({_LINES}) = 1 AND regexp_matches(trim(text, ' '), '^#{{1,6}}\s') THEN 'heading' ELSE 'text' END AS chunk_type FROM documents""")
def chunk_type(t):
    return t("documents").select("doc_id", X.chunk_type(F.col("text")).alias("chunk_type"))


@query("jaccard_pairs", f"""WITH q AS (SELECT item_id, list_distinct({TOK.format('text')}) AS a FROM benchmark), d AS (SELECT doc_id, list_distinct({TOK.format('text')}) AS b FROM documents),
n AS (SELECT item_id, doc_id, len(list_intersect(a, b)) AS both_, len(a) + len(b) - len(list_intersect(a, b)) AS either_ FROM q, d)
SELECT item_id, doc_id, round(both_ / either_, 6) AS jaccard FROM n WHERE both_ > 0 AND round(both_ / either_, 6) >= 0.3""")
def jaccard_pairs(t):
    """Items and documents of word-set similarity 0.3 or more, by counting shared words in postings."""
    q = t("benchmark").select("item_id", F.array_distinct(X.tokenize(F.col("text"))).alias("a"))
    d = t("documents").select("doc_id", F.array_distinct(X.tokenize(F.col("text"))).alias("b"))
    qw = R.bounded(q.select("item_id", F.size("a").alias("na"), F.explode("a").alias("w")), R.BROADCAST_TOKENS)
    dw = d.select("doc_id", F.size("b").alias("nb"), F.explode("b").alias("w"))
    both = dw.join(qw, "w").groupBy("item_id", "doc_id", "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    out = both.select("item_id", "doc_id", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"))
    return out.filter("jaccard >= 0.3")


@query("keyword_topk", r"""WITH w AS (SELECT source, lower(unnest(regexp_extract_all(text, '[a-zA-Z]{3,}'))) AS w FROM documents),
c AS (SELECT source, w, count(*) AS n FROM w WHERE w NOT IN ('the', 'and', 'for', 'with', 'this', 'that', 'from', 'are', 'was') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS rank FROM c)
SELECT source, w AS keyword, n, rank FROM r WHERE rank <= 20 AND n >= 3""")
def keyword_topk(t):
    """The 2 x 10 most frequent words of each source, then those seen at least three times."""
    w = t("documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{3,}"), 0)).alias("w")).select("source", F.lower("w").alias("keyword"))
    stop = ["the", "and", "for", "with", "this", "that", "from", "are", "was"]
    c = w.filter(~F.col("keyword").isin(stop)).groupBy("source", "keyword").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "keyword"))
    return c.withColumn("rank", r.cast("bigint")).filter("rank <= 20 AND n >= 3")


_DOM = r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}')) AS domain FROM documents)
SELECT doc_id, regexp_replace(domain, '^www\.', '') AS domain, count(*) AS n FROM x GROUP BY ALL"""


@query("domain_extract", _DOM)
def domain_extract(t):
    pattern = r"[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.[a-z]{2,}"
    x = t("documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 0)).alias("domain"))
    return x.groupBy("doc_id", F.regexp_replace("domain", r"^www\.", "").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("question_ids", "SELECT item_id, substr(md5(text), 1, 8) AS question_id, md5('mini:' || text) AS cache_key FROM benchmark")
def question_ids(t):
    return t("benchmark").select("item_id", X.question_id(F.col("text")).alias("question_id"), X.cache_key("mini", F.col("text")).alias("cache_key"))


@query("chunk_documents")
def chunk_documents(t):
    """Chunks of every document; a fold over each text, checked in tests against invariants."""
    from ..operators import chunking as C

    return C.chunk(t("documents")).select("doc_id", "chunk_index", "chunk_type", "token_count", "content_hash", "position_ratio", "heading")


@query("chunk_page_stats")
def chunk_page_stats(t):
    """Chunks, tokens and mean chunk size of every document."""
    from ..operators import chunking as C

    return C.page_stats(C.chunk(t("documents")))


_PARA = r"p AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))"
_W = r"string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')"


@query("chunk_overlap", rf"""WITH {_PARA}, l AS (SELECT doc_id, i, x, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM p), c AS (SELECT *, array_to_string({_W.format('prev')}[greatest(len({_W.format('prev')}) - 4, 1):], ' ') || ' ' || x AS both_ FROM l)
SELECT doc_id, CAST(i AS BIGINT) AS i, md5(CASE WHEN prev IS NOT NULL AND floor(len(regexp_extract_all(both_, '[^\s]+')) * 13 / 10.0) <= 72 THEN both_ ELSE x END) AS content FROM c""")
def chunk_overlap(t):
    """Lines as chunks, each led by the last 5 words of the one before where both stay within 72 tokens."""
    from ..operators import chunking as C

    p = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    prev = F.lag("x").over(Window.partitionBy("doc_id").orderBy("i"))
    p = p.withColumn("prev", prev).withColumn("c", C.with_overlap(F.col("prev"), F.col("x"), 5, 60))
    return p.select("doc_id", F.col("i").cast("bigint").alias("i"), F.md5(F.col("c").cast("binary")).alias("content"))


@query("heading_asof", f"WITH {_PARA}, h AS (SELECT doc_id, i, x FROM p WHERE length(x) < 40) SELECT p.doc_id, CAST(p.i AS BIGINT) AS i, (SELECT arg_max(h.x, h.i) FROM h WHERE h.doc_id = p.doc_id AND h.i < p.i) AS heading FROM p")
def heading_asof(t):
    """Each line with the last short line before it: an as-of join as a running window."""
    p = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return p.select("doc_id", F.col("i").cast("bigint").alias("i"), F.last(F.when(F.length("x") < 40, F.col("x")), ignorenulls=True).over(w).alias("heading"))


_MARKS = r"(?i)\bwe\s+(?:found|tested|built|measured)\b|\bour\s+(?:team|data|research|approach)\b|\d{1,3}%\s+of|(?:per|/)\s*(?:month|year|user)|\bcase\s+stud|\btoken\s*=|\b\d+\.\d+\.\d+"
_FLUFF = ["world-class", "cutting-edge", "state-of-the-art", "seamless integration", "easy to use", "data-driven", "learn more", "best-in-class", "trusted by thousands", "all-in-one"]


@query("content_uniqueness", rf"""WITH {_PARA}, a AS (SELECT doc_id, avg(CAST(regexp_matches(x, '{_MARKS}') AS INT)) AS share, sum(len(regexp_extract_all(x, '{_MARKS}'))) AS marks, sum({' + '.join(f"CAST(contains(lower(x), '{f}') AS INT)" for f in _FLUFF)}) AS fluff, sum(greatest(1, len(regexp_extract_all(x, '[.!?](?:\s|$)')))) AS sentences FROM p WHERE x <> '' GROUP BY doc_id)
SELECT doc_id, round(0.40 * share + 0.25 * least(1.0, marks / 20) + 0.35 * greatest(0.0, 1 - fluff / sentences), 6) AS uniqueness FROM a""")
def content_uniqueness(t):
    """0.40 share of paragraphs with own evidence, 0.25 first-party marks (of 20), 0.35 without stock phrases."""
    p = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x")).filter("x <> ''")
    fluff = sum((F.contains(F.lower("x"), F.lit(f)).cast("int") for f in _FLUFF), F.lit(0))
    a = p.groupBy("doc_id").agg(F.avg(F.col("x").rlike(_MARKS).cast("int")).alias("share"), F.sum(F.regexp_count("x", F.lit(_MARKS))).alias("marks"), F.sum(fluff).alias("fluff"), F.sum(F.greatest(F.lit(1), F.regexp_count("x", F.lit(r"[.!?](?:\s|$)")))).alias("sentences"))
    s = 0.40 * F.col("share") + 0.25 * F.least(F.lit(1.0), F.col("marks") / 20) + 0.35 * F.greatest(F.lit(0.0), 1 - F.col("fluff") / F.col("sentences"))
    return a.select("doc_id", F.round(s, 6).alias("uniqueness"))
