"""Answer block, readability and FAQ scores on hand-written pages."""

import pytest
from pyspark.sql import functions as F

from wellspring.functions import html as H
from wellspring.functions import structure as X

W = lambda n: " ".join(["word"] * n)
GOOD = f"Acme is a tool that {W(40)}."
PAGES = {
    1: f"<body><article><h1>T</h1><p>short</p><p>{GOOD}</p><p>later {W(50)}</p></article></body>",
    2: f"<article><p>The start {W(60)} is long.</p></article>",  # no h1; begins with The
    3: "<article><h1>T</h1><p>tiny</p></article>",
    4: f"<main><h1>T</h1><p>Bold<b> one </b>two {W(29)}</p></main>",
    5: None,
}


def answers(spark):
    df = spark.createDataFrame(list(PAGES.items()), "page_id int, html string")
    p = df.select("page_id", X.first_answer(F.col("html")).alias("t"), H.main_text(F.col("html")).alias("main"))
    return {r.page_id: r for r in p.select("page_id", "t", *[c.alias(k) for k, c in X.answer_parts(F.col("t"), F.col("main")).items()]).collect()}


def test_answer_block(spark):
    got = answers(spark)
    assert got[1].t == GOOD and (got[1].answer_words, got[1].optimal, got[1].standalone, got[1].topic, got[1].has_block) == (45, True, True, True, True)
    assert got[1].place == pytest.approx(100 - len("T short ") / 10) and got[1].answer_score == 40 + 25 + 15 + 10 + 10
    assert (got[2].topic, got[2].standalone, got[2].has_block) == (False, True, True)  # "The start ... is long" stands alone
    assert got[3].t is None and got[3].answer_score == 0 and got[5].answer_score == 0
    assert got[4].t.startswith("Boldonetwo word") and got[4].place == 0 and (got[4].answer_words, got[4].has_block) == (30, True)
    assert got[4].answer_score == 40 + 15 + 10


def test_readability(spark):
    sentence = W(18).capitalize() + ". "
    pages = {
        1: "<article><h1>a</h1><h2>b</h2><ul></ul>" + f"<p>{sentence * 3}</p>" * 4 + "</article>",
        2: f"<article><p>{W(200)}</p></article>",
        3: "<article>no paragraphs</article>",
        4: "<article></article>",
        5: f"<article><p>{W(30)}. {W(30)}. {W(30)}.</p><p>too short</p></article>",
    }
    df = spark.createDataFrame(list(pages.items()), "page_id int, html string")
    p = df.select("page_id", "html", X.paragraphs(F.col("html")).alias("ps"), F.regexp_count(H.visible(F.col("html")), F.lit(r"\S+")).alias("n_words"))
    p = p.select("page_id", "n_words", *[c.alias(k) for k, c in X.readable_parts(F.col("html"), F.col("ps"), F.col("n_words")).items()])
    got = {r.page_id: r for r in p.withColumn("score", X.readable_score()).collect()}
    assert (got[1].paragraphs, got[1].mean_words, got[1].mean_sentences, got[1].mean_sentence, got[1].short_share, got[1].longest) == (4, 54, 3, 18, 1, 54)
    assert got[1].score == 50 + 15 + 15 + 10 + 5 + 5
    assert (got[2].longest, got[2].long_share) == (200, 1) and got[2].score == 50 - 5 - 10 - 15 - 10
    assert got[3].score == 50 and got[4].score == 0
    assert (got[5].paragraphs, got[5].mean_sentences, got[5].long_share) == (1, 3, 1) and got[5].score == 50 + 15 - 10 - 10


def test_faq(spark):
    pages = ["<h2>Frequently asked questions</h2><h3>Why?</h3>", "<h2>A?</h2><dl><dt>b</dt></dl><details>c</details>", "<h2>A?</h2>", "<h5>Q &amp; A</h5><h4>q & a</h4>" + "<h3>x?</h3>" * 9 + "FAQPage", "<h5>faq</h5>", ""]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    assert [r.s for r in df.orderBy("i").select(X.faq_score(F.col("h")).alias("s")).collect()] == [55, 65, 0, 100, 0, 0]
    assert sum(X.SHARES.values()) == pytest.approx(1)
