"""Template removal on hosts with copied pages and on very large hosts."""

from wellspring.llm import extract

PAGES = "page_id bigint, url string, html string"
BLOCK = "<div><p>Same words on every page of this host</p></div>"


def rows(n, first, host, blocks):
    return [(first + i, f"https://{host}/p", f"<body><p>own words {first + i}</p>{BLOCK if i < blocks else ''}</body>") for i in range(n)]


def test_exact_copies_do_not_hide_a_template(spark):
    own = rows(10, 0, "a.org", 10)
    copies = [(100 + i, *own[0][1:]) for i in range(90)]
    text = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(own + copies, PAGES)).collect()}
    assert text == {i: f"own words {i}" for i in range(10)} | {100 + i: "own words 0" for i in range(90)}


def test_many_surroundings_count_whatever_the_share(spark):
    pages = spark.createDataFrame(rows(100, 0, "b.org", 25), PAGES)
    kept = extract.extract(pages, many=26).filter("text like '%Same words%'").count()
    gone = extract.extract(pages, many=25).filter("text like '%Same words%'").count()
    assert (kept, gone) == (25, 0)
