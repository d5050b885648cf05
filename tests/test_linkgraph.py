"""Link resolution, page classes, clusters and scores on hand-written sites, in Spark and in the queries' SQL."""

import duckdb
import pytest

from wellspring.operators import linkgraph as G
from wellspring.plans import linkgraph as P
from wellspring.plans.catalogue import ORACLES

HREFS = [
    ("http://A.com/x/y", "/p?q=1#f", "http://a.com/p"),
    ("http://a.com/x/y", "z", "http://a.com/x/z"),
    ("http://a.com/x/y", "../z/", "http://a.com/z"),
    ("http://a.com/x/y/", "./../../../z", "http://a.com/z"),
    ("http://a.com", "z", "http://a.com/z"),
    ("https://a.com/x", "//b.com/Q", "https://b.com/q"),
    ("https://a.com/x?k", "?m=2", "https://a.com/x"),
    ("https://a.com/x", "#top", "https://a.com/x"),
    ("https://a.com/x", "HTTPS://A.com/Y/", "https://a.com/y"),
    ("https://a.com/x", "mailto:a@b.c", None),
    ("https://a.com/x", "javascript:go()", None),
    ("https://a.com/x", "", None),
    ("https://a.com/a..b/x", "c..d", "https://a.com/a..b/c..d"),
]


def page(i, url, words, links, title="T"):
    anchors = "".join(f'<a href="{x}">go</a> ' for x in links)
    return (i, url, f"<html><head><title>{title}</title></head><body><article>{'word ' * (words - 1 - len(links))}{anchors}</article></body></html>")


SUBS = [f"/guide/{k}" for k in "abcde"]
SITE = [
    page(1, "https://www.one.com/", 400, ["/guide"]),
    page(2, "https://one.com/guide", 3000, [*SUBS, "/guide/a", "https://other.org/x", "/gone"]),
    page(3, "https://one.com/guide/a", 1000, ["/guide", "b"]),
    page(4, "https://one.com/guide/b", 1200, ["../guide"]),
    page(5, "https://one.com/guide/c/", 900, ["/guide#x"]),
    page(6, "https://one.com/guide/d", 250, ["/guide"]),
    page(7, "https://one.com/guide/e", 250, []),
    page(8, "https://one.com/lone", 700, []),
    page(9, "https://one.com/guide/b?old", 1200, ["/guide"]),  # the last page of its URL
    page(10, "https://two.org/a", 500, ["/b"]),
    page(11, "https://two.org/b", 500, ["/a", "/a"]),
    page(12, "no url", 500, ["/a"]),
    (13, "https://three.net/", None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(SITE, "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", SITE)
    return con


def test_resolve(spark):
    df = spark.createDataFrame(HREFS, "url string, href string, want string")
    for r in df.select("*", G.plain(G.resolve(df.href, df.url)).alias("got")).collect():
        assert r.got == r.want, r


def test_classes_and_clusters(pages):
    p = G.site_pages(pages)
    e = G.edges_of(p)
    classes = {r.page_id: r for r in G.classified(p, e).collect()}
    assert {i: r.kind for i, r in classes.items()} == {1: "normal", 2: "pillar", 3: "cluster", 9: "cluster", 5: "cluster", 6: "thin", 7: "thin", 8: "orphan", 10: "normal", 11: "normal", 13: "thin"}
    assert (classes[2].outbound, classes[2].inbound, classes[2].mutual) == (7, 4, True) and (classes[10].inbound, classes[9].inbound) == (2, 2)
    m = G.members(G.classified(p, e), e)
    found = {r.page: (r.n, r.back) for r in m.collect()}
    # e is thin and does not link back; d is thin but does
    assert found == {"https://one.com/guide/a": (2, True), "https://one.com/guide/b": (1, True), "https://one.com/guide/c": (1, True), "https://one.com/guide/d": (1, True)}
    c = G.clusters(m).collect()
    assert [(r.pillar, r["size"], r.both_ways, r.mean_words) for r in c] == [("https://one.com/guide", 5, 5, (2 * 1000 + 1200 + 900 + 250) / 5)]
    assert G.clusters(m, 6).count() == 0


def test_scores(pages):
    p = G.site_pages(pages)
    e = G.edges_of(p)
    classes = G.classified(p, e)
    got = {r.site: r for r in G.scores(classes, e, G.clusters(G.members(classes, e))).collect()}
    one = got["one.com"]
    assert (one.pages, one.links, one.mutual_pairs, one.clusters) == (8, 13, 4, 1)
    assert one.cluster_score == pytest.approx(30 + 4 / 8 * 30 + 40) and one.link_score == pytest.approx(50 - 1 / 8 * 30 - 10 + 5 / 8 * 25)
    assert one.level == "full" and one.issues == []
    assert got["two.org"].cluster_score == 50 and got["two.org"].mutual_share == 1 and got["three.net"].issues == []


@pytest.mark.parametrize("name", ["link_reciprocity", "topic_cluster_members", "topic_clusters"])
def test_queries_equal_sql_on_sites(pages, duck, name):
    got = getattr(P, name)(lambda table: pages).toPandas()
    want = duck.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got)
    as_rows = lambda d: sorted(tuple(f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v) for v in r) for r in d[cols].astype(object).itertuples(index=False))
    assert as_rows(got) == as_rows(want)
