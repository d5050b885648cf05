"""Link graph queries over pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkgraph as G
from .base import query
from .pages import CLEAN, STRIP

PARTS = "^(https?)://([^/?#]+)([^?#]*)"
_PLAIN = "lower(string_split(string_split(regexp_replace({0}, '/+$', ''), '#')[1], '?')[1])"
_DOMAIN = f"nullif(regexp_replace(regexp_replace(lower(regexp_extract(trim({{0}}), '{PARTS}', 2)), '^www\\.', ''), ':.*$', ''), '')"
_TIDY = """CASE WHEN regexp_matches({0}, '(^|/)\\.\\.?(/|$)') THEN array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split({0}, '/'), lambda s: [s])),
  lambda a, b: CASE b[1] WHEN '.' THEN a WHEN '..' THEN CASE WHEN len(a) > 1 THEN a[:len(a) - 1] ELSE a END ELSE list_concat(a, b) END), '/') ELSE {0} END"""
_OWN = "regexp_extract(h, '^([^?#]*)', 1)"
_FOLDER = "CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END"
_RESOLVED = f"""CASE WHEN h = '' THEN NULL WHEN regexp_matches(h, '(?i)^https?://') THEN h WHEN starts_with(h, '//') THEN scheme || ':' || h WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
  WHEN starts_with(h, '#') OR starts_with(h, '?') THEN root || path || h WHEN starts_with(h, '/') THEN root || {_TIDY.format(_OWN)} || substr(h, length({_OWN}) + 1)
  ELSE root || {_TIDY.format(f"({_FOLDER} || {_OWN})")} || substr(h, length({_OWN}) + 1) END"""

GRAPH = f"""
raw_pages AS (
  SELECT page_id, {_DOMAIN.format('url')} AS site, {_PLAIN.format('url')} AS url, lower(regexp_extract(trim(url), '{PARTS}', 1)) AS scheme,
         lower(regexp_extract(trim(url), '{PARTS}', 1)) || '://' || regexp_extract(trim(url), '{PARTS}', 2) AS root, regexp_extract(trim(url), '{PARTS}', 3) AS path,
         len(regexp_extract_all({STRIP.format(CLEAN.format("coalesce(html, '')"))}, '\\S+')) AS words, coalesce(html, '') AS html
  FROM pages
), kept AS (
  SELECT * FROM raw_pages WHERE site IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY page_id DESC) = 1
), anchors AS (
  SELECT page_id, site, url, scheme, root, path, trim(regexp_extract(unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>')), '(?i)href="([^"]*)"', 1)) AS h FROM kept
), resolved AS (
  SELECT site, url AS src, {_RESOLVED} AS target FROM anchors
), inside AS (
  SELECT site, src, {_PLAIN.format('target')} AS dst FROM resolved WHERE {_DOMAIN.format('target')} = site
), edges AS (
  SELECT i.site, src, dst, count(*) AS n FROM inside i JOIN kept k ON k.site = i.site AND k.url = i.dst GROUP BY ALL
), linked AS (
  SELECT e.*, b.src IS NOT NULL AS back FROM edges e LEFT JOIN edges b ON b.site = e.site AND b.src = e.dst AND b.dst = e.src
), degrees AS (
  SELECT k.site, k.url, k.page_id, k.words, coalesce(o.n, 0) AS outbound, coalesce(c.n, 0) AS inbound, coalesce(c.mutual, false) AS mutual FROM kept k
  LEFT JOIN (SELECT site, src AS url, count(*) AS n FROM inside GROUP BY ALL) o USING (site, url)
  LEFT JOIN (SELECT site, dst AS url, sum(n) AS n, bool_or(back) AS mutual FROM linked GROUP BY ALL) c USING (site, url)
), classes AS (
  SELECT *, CASE WHEN words < {G.THIN} THEN 'thin' WHEN words >= {G.PILLAR_WORDS} AND outbound >= {G.PILLAR_LINKS} THEN 'pillar' WHEN words >= {G.CLUSTER_WORDS} AND words < {G.PILLAR_WORDS} AND inbound > 0 THEN 'cluster'
    WHEN inbound = 0 AND regexp_replace(regexp_extract(url, '{PARTS}', 3), '^/+|/+$', '', 'g') NOT IN {G.HOMES} THEN 'orphan' ELSE 'normal' END AS kind FROM degrees
), members AS (
  SELECT l.site, l.src AS pillar, l.dst AS page, l.n, l.back, t.words FROM linked l JOIN classes p ON p.site = l.site AND p.url = l.src AND p.kind = 'pillar'
  JOIN classes t ON t.site = l.site AND t.url = l.dst WHERE t.kind IN ('cluster', 'normal') OR l.back
), clusters AS (
  SELECT site, pillar, sum(n)::BIGINT AS size, coalesce(sum(n) FILTER (WHERE back), 0)::BIGINT AS both_ways, sum(n * words) / sum(n) AS mean_words FROM members GROUP BY ALL HAVING sum(n) >= {G.CLUSTER_SIZE}
), sites AS (
  SELECT c.site, count(*) AS pages, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_pages" for k in ("pillar", "cluster", "orphan", "thin"))}, sum(outbound)::BIGINT AS links, count(*) FILTER (WHERE mutual) / count(*) AS share,
         any_value(coalesce(m.n, 0)) AS mutual_pairs, any_value(coalesce(k.n, 0)) AS clusters, any_value(coalesce(k.ratio, 0)) AS ratio
  FROM classes c LEFT JOIN (SELECT site, count(*) AS n FROM linked WHERE back AND src <= dst GROUP BY site) m USING (site) LEFT JOIN (SELECT site, count(*) AS n, avg(both_ways / size) AS ratio FROM clusters GROUP BY site) k USING (site) GROUP BY c.site
), scored AS (
  SELECT *, least(100, CASE WHEN clusters > 0 THEN 30 + (pillar_pages + cluster_pages) / pages * 30 + ratio * 40 WHEN pages < {G.SMALL_SITE} THEN 50 ELSE 0 END)::DOUBLE AS cluster_score,
    greatest(0, least(100, 50 - orphan_pages / pages * 30 + CASE WHEN links / pages BETWEEN 5 AND 15 THEN 25 WHEN links / pages >= 3 AND links / pages <= 25 THEN 15 WHEN links / pages < 3 THEN -10 ELSE 0 END + share * 25))::DOUBLE AS link_score FROM sites
)"""


def graph(t):
    p = G.site_pages(t("pages"))
    e = G.edges_of(p)
    return G.classified(p, e), e


@query("link_reciprocity", f"WITH {GRAPH} SELECT page_id, site, outbound::BIGINT AS outbound, inbound::BIGINT AS inbound, mutual, kind FROM classes")
def link_reciprocity(t):
    """Each page's links out and in within its site, whether any goes both ways, and its class."""
    return graph(t)[0].select("page_id", "site", "outbound", "inbound", "mutual", "kind")


@query("topic_cluster_members", f"WITH {GRAPH} SELECT site, pillar, page, n::BIGINT AS links, back FROM members WHERE (site, pillar) IN (SELECT (site, pillar) FROM clusters)")
def topic_cluster_members(t):
    """Pages of each topic cluster, and whether they link back to its pillar."""
    m = G.members(*graph(t))
    return m.join(G.clusters(m), ["site", "pillar"], "left_semi").select("site", "pillar", "page", F.col("n").alias("links"), "back")


@query("topic_clusters", f"""WITH {GRAPH} SELECT site, pages, pillar_pages, cluster_pages, orphan_pages, thin_pages, links, mutual_pairs, clusters, round(cluster_score, 6) AS cluster_score, round(link_score, 6) AS link_score,
  round(cluster_score * 0.6 + link_score * 0.4, 6) AS total_score, CASE WHEN cluster_score * 0.6 + link_score * 0.4 >= 70 THEN 'full' WHEN cluster_score * 0.6 + link_score * 0.4 >= 40 THEN 'partial' ELSE 'limited' END AS level FROM scored""")
def topic_clusters(t):
    """Cluster and link scores of every site."""
    classes, e = graph(t)
    s = G.scores(classes, e, G.clusters(G.members(classes, e)))
    return s.select("site", "pages", "pillar_pages", "cluster_pages", "orphan_pages", "thin_pages", "links", "mutual_pairs", "clusters", *[F.round(c, 6).alias(c) for c in ("cluster_score", "link_score", "total_score")], "level")
