"""Edge cases and invariants of the operators, with published constants as goldens."""

import math

import pytest
from pyspark.sql import functions as F

from wellspring.functions import signals, text, urls
from wellspring.operators import calibration, chunking, retrieval, scoring
from wellspring.sources import crawl


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("http://www.Example.com:80/a/?utm_source=x&b=2&a=1", "https://example.com/a?a=1&b=2"), ("https://x.com", "https://x.com/"), ("//x.com/p/", "https://x.com/p"),
        ("https://x.com/a#top", None), ("https://x.com/a.PDF", None), ("https://x.com/feed/", None), ("mailto:a@b.c", None), (None, None), ("", None), ("https://x.com/?q=&r=1", "https://x.com/?r=1"),
    ],
)
def test_normalize_url(spark, raw, want):
    assert one(spark, urls.normalize(F.lit(raw).cast("string"))) == want


def test_url_parts(spark):
    assert one(spark, urls.domain(F.lit("https://www.A.com:8080/x"))) == "a.com"
    assert one(spark, urls.is_internal(F.lit("https://b.a.com/"), F.lit("a.com"))) is True
    assert one(spark, urls.is_internal(F.lit("https://ba.com/"), F.lit("a.com"))) is False
    assert one(spark, urls.surface(F.lit("https://docs.a.com/"))) == "docs"
    assert one(spark, urls.page_type(F.lit("https://a.com/blog/x"))) == "blog_post"
    assert one(spark, urls.page_type(F.lit("https://a.com/"))) == "homepage"


def test_text_functions(spark):
    assert one(spark, text.tokenize(F.lit("A Bc été_1 x"))) == ["bc", "été_1"]
    assert one(spark, text.estimate_tokens(F.lit("a b c d"))) == 5
    assert one(spark, text.estimate_tokens(F.lit("  "))) == 0
    assert one(spark, text.content_hash(F.lit("A  b\nC"))) == one(spark, text.content_hash(F.lit("a b c")))
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, text.letter_grade(F.lit(89.9))) == "B+"
    assert one(spark, text.next_milestone(F.lit(90))) is None
    import hashlib

    assert one(spark, text.mod_hash(F.lit("site-1"))) == int(hashlib.sha256(b"site-1").hexdigest(), 16) % 10_000


@pytest.mark.parametrize(("s", "want"), [("```x```", "code"), ("a|b\nc|d", "table"), ("- a\n- b", "list"), ("> q", "quote"), ("# T", "heading"), ("plain", "text")])
def test_chunk_type(spark, s, want):
    assert one(spark, text.chunk_type(F.lit(s))) == want


def test_bm25_formula_and_repeats(spark):
    docs = spark.createDataFrame([(1, "apple banana"), (2, "apple apple cherry"), (3, "cherry date"), (4, None)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "apple apple"), (2, ""), (3, "zebra")], "item_id bigint, text string")
    got = {(r.item_id, r.doc_id): r.score for r in retrieval.bm25(docs, q).collect()}
    idf, avg = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1), 7 / 4
    want = lambda tf, dl: 2 * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {(1, 1): pytest.approx(want(1, 2), abs=1e-6), (1, 2): pytest.approx(want(2, 3), abs=1e-6)}


def test_rrf_bounds_and_diversity(spark):
    a = spark.createDataFrame([(1, d, d) for d in range(1, 6)], "q bigint, d bigint, rank bigint")
    top = retrieval.rrf([a, a]).orderBy(F.desc("score")).first()
    assert top["score"] == pytest.approx(1 / 61)
    ranked = a.withColumn("page", F.when(F.col("d") < 5, F.lit("p")))
    assert [r.d for r in retrieval.diversify(ranked, "page").orderBy("rank").collect()] == [1, 2, 5]
    assert retrieval.diversify(ranked, "page", 0).count() == 5


def test_vector_search_skips_null(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    r = retrieval.vector_search(v, v.filter("vec_id = 1"), k=2).orderBy("rank").collect()
    assert [(x.id, x.score) for x in r] == [(1, 1.0), (4, 1.0)]


def test_chunking(spark):
    long = "\n\n".join(" ".join(f"Word{i} goes on here." for i in range(60)) for _ in range(5))
    assert chunking.split("") == [] and chunking.split("short") == ["short"]
    parts = chunking.split(long)
    assert all(chunking.tokens(p) <= 512 for p in parts) and " ".join(parts).split() == long.split()
    assert chunking.sentences("Dr. Who came. He left.") == ["Dr. Who came.", "He left."]
    d = spark.createDataFrame([(1, long), (2, None), (3, "x")], "doc_id bigint, text string")
    c = chunking.chunk(d).collect()
    assert {r.doc_id for r in c} == {1, 3}
    mine = sorted((r.chunk_index for r in c if r.doc_id == 1))
    assert mine == list(range(len(mine)))


def test_measures_guard_zero(spark):
    c = spark.createDataFrame([(0, 0, 0, 0), (5, 0, 5, 0)], "tp bigint, fp bigint, tn bigint, fn bigint")
    r = calibration.measures(c).orderBy("tp").collect()
    assert r[0].mcc == 0 and r[1].mcc == 1


def test_signals(spark):
    assert one(spark, signals.confidence(F.lit("Mail me at a@b.co"), "email address")) == 1.0
    assert one(spark, signals.confidence(F.lit("call 555-123-4567 now"), "phone")) == 1.0
    assert one(spark, signals.confidence(F.lit("99.99% of 555.123.45678"), "phone")) == 0.0
    assert one(spark, signals.confidence(F.lit("some quarterly words"), "quarterly numbers")) == 0.5


def test_crawl_sources(spark, tmp_path):
    robots = "User-agent: *\nDisallow: /private\nAllow: /private/open\n# c\nUser-agent: other\nDisallow: /other\n"
    d = spark.createDataFrame([("s", robots)], "site string, robots string")
    u = spark.createDataFrame([("s", "/private/x"), ("s", "/private/open/y"), ("s", "/z"), ("s", "/other")], "site string, path string")
    lax = {r.path: r.allowed for r in crawl.allowed(u, crawl.robots(d, "bot")).collect()}
    assert lax == {"/private/x": False, "/private/open/y": True, "/z": True, "/other": False}
    strict = {r.path: r.allowed for r in crawl.allowed(u, crawl.robots(d, "bot", strict=True)).collect()}
    assert strict["/other"] is True
    xml = '<urlset xmlns="x"><url><loc>https://a/1</loc><priority>0.5</priority></url><url><loc>https://a/1</loc></url><url><loc>https://a/2</loc></url></urlset>'
    s = crawl.sitemap(spark.createDataFrame([("s", xml)], "site string, xml string")).orderBy("loc").collect()
    assert [(r.loc, r.priority, r.kind) for r in s] == [("https://a/1", 0.5, "urlset"), ("https://a/2", None, "urlset")]
    t = crawl.llms_txt(spark.createDataFrame([("s", "# T\n> sum\n## A\n[x](y)\n")], "site string, text string")).first()
    assert (t.title, t.summary, t.sections, t.links, t.quality) == ("T", "sum", ["A"], 1, 59.5)
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "page_0000.html").write_text("<p>x</p>\n<p>y</p>")
    assert crawl.read_pages(spark, str(tmp_path)).first().html == "<p>x</p>\n<p>y</p>"


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_vector_search_holds_one_tile(spark, monkeypatch, metric):
    """Rows and queries go through tiles; the k best, ties by id, are those of the whole product."""
    import numpy as np

    monkeypatch.setattr(retrieval, "TILE", 7)
    v = np.random.default_rng(3).normal(size=(60, 4)).round(1)
    v[40:] = v[:20]  # ties
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id bigint, embedding array<float>").repartition(3)
    got = retrieval.vector_search(rows, rows.filter("vec_id % 3 = 0"), k=5, metric=metric)
    f = v.astype(np.float32).astype(float)
    want = {}
    for i in range(0, 60, 3):
        s = f @ f[i] if metric == "cosine" else 1 - np.sqrt(((f - f[i]) ** 2).sum(axis=1))
        s = np.round(s, 6)
        want[i] = [(j, s[j]) for j in sorted(range(60), key=lambda j: (-s[j], j))[:5]]
    out = {}
    for r in got.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    assert out == {i: [(j, pytest.approx(s, abs=2e-6)) for j, s in x] for i, x in want.items()}
    top = retrieval.Top(3, 2)
    for a in range(0, 30, 5):
        top.add(np.arange(15.0).reshape(3, 5) % 4 + a, np.arange(a, a + 5))
        assert len(top.id) <= 6 and len(top.query) == len(top.score) == len(top.id)


def test_chunks_are_made_of_small_slices():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 10, None, "", "b" * 95, "c" * 400, "d", "e"])], names=["id", "text"])
    cut = list(chunking.slices(b, 100))
    assert pa.Table.from_batches(cut) == pa.Table.from_batches([b])
    assert [x.num_rows for x in cut] == [3, 1, 1, 2]
    assert list(chunking.slices(b.slice(0, 0))) == []


def test_bm25_rows_scored_in_place(spark, monkeypatch):
    """Few queries are scored where the rows are: as joined postings, with no shuffle of postings or pairs of all rows."""
    texts = ["red fox red", "blue fox", "", None, "green hill over blue hill", "fox fox fox fox", "red hill"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    queries = spark.createDataFrame([(50, "red red fox"), (7, "hill blue unseen"), (8, "nothing"), (9, None)], "item_id bigint, text string")
    fast = retrieval.bm25(docs, queries, k=4)
    assert "SortMergeJoin" not in fast._jdf.queryExecution().toString() and "MapInArrow" in fast._jdf.queryExecution().toString()
    got = sorted(map(tuple, fast.collect()))
    twice = docs.union(docs.filter("doc_id = 1"))  # ids that clash go by postings
    both = sorted(map(tuple, retrieval.bm25(twice, queries, k=4).collect()))
    monkeypatch.setattr(retrieval, "DENSE_CELLS", 0)
    slow = retrieval.bm25(docs, queries, k=4)
    assert "MapInArrow" not in slow._jdf.queryExecution().toString()
    assert got == sorted(map(tuple, slow.collect())) and len(got) == 8
    assert both == sorted(map(tuple, retrieval.bm25(twice, queries, k=4).collect()))
