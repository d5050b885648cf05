"""Template counts against brute force, pages that only the counts can clean, and hostile markup."""

import time
from collections import defaultdict

import pytest

from wellspring.llm import extract

PAGES = "page_id bigint, url string, html string"


def site(n):
    """Plain divs without telling names: a menu of varied words, a notice, the article's text."""
    menu = "<div><ul>" + "".join(f"<li><a href='/{k}'>part {k}</a></li>" for k in range(6)) + "<li>here {i}</li></ul></div>"
    return [(i, f"https://h.org/{i}", f"<body>{menu.replace('{i}', str(i))}<div><p>story {i} of its own</p></div><div><p>All rights kept by the makers</p></div></body>") for i in range(n)]


def test_counts_alone_decide(spark):
    pages = spark.createDataFrame(site(12), PAGES)
    on = {r.page_id: (r.text, r.n_template) for r in extract.extract(pages).collect()}
    off = {r.page_id: (r.text, r.n_template) for r in extract.extract(pages, min_contexts=10**9, many=10**9).collect()}
    assert on == {i: (f"story {i} of its own", on[i][1]) for i in range(12)} and all(n > 0 for _, n in on.values())
    assert all("part 3" in t and "rights" in t and n == 0 for t, n in off.values())


def test_counts_match_brute_force(spark):
    rows = site(9) + [(100 + i, "https://g.org/x", f"<body><p>one {i}</p><p>same</p></body>") for i in range(4)] + [(200, None, "<p>same</p>")]
    count, contents = defaultdict(set), defaultdict(set)
    for _, url, page in rows:
        if url:
            root = extract.parse(page)
            for h, p in extract.candidates(root):
                count[url[8:13], h].add(p)
            contents[url[8:13]].add(root.hash)
    want = {(host, h) for (host, h), p in count.items() if len(p) >= 3 and len(p) >= 0.5 * len(contents[host])}
    d = spark.createDataFrame([(u[8:13] if u else "", h) for _, u, h in rows], "host string, html string")
    got = {(r.host, h) for r in extract.templates(d, "host", "html", 3, 0.5).collect() for h in r.template}
    assert got == want and any(h == "g.org" for h, _ in got)


def test_passages_quoted_by_many_articles_stay(spark):
    quote = "<p>a passage that many articles of the host quote</p>"
    rows = [(i, "https://q.org/p", f"<body><div><p>short note</p></div><article><p>own {i}</p>{quote if i < 30 else ''}</article></body>" if i < 90 else f"<body><article><p>own {i}</p></article></body>") for i in range(400)]
    got = {r.page_id: r for r in extract.extract(spark.createDataFrame(rows, PAGES), many=25).collect()}
    assert got[3].text == "own 3\na passage that many articles of the host quote" and got[3].n_template == 1
    assert got[395].text == "own 395" and got[395].n_template == 0


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000, "<div class=nav>" * 20_000 + "<article><p>a</p></article>", "<i><div>" + "<b>" * 20_000 + "</i>" * 20_000, "<p><button>" + "<b>" * 20_000 + "<ul></ul>" * 20_000, "<article>" * 20_000 + "x"])
def test_hostile_pages_take_linear_time(page):
    t = time.process_time()
    extract.text_of(extract.content(page)[0])
    assert time.process_time() - t < 4


def test_own_columns_win_clashes(spark):
    d = spark.createDataFrame([(1, "https://a.org/", "<p>x", "mine", 7)], PAGES + ", text string, n_chars int")
    out = extract.extract(d)
    assert out.columns == ["page_id", "url", "text", "n_chars", "n_template"] and out.first().text == "x"
