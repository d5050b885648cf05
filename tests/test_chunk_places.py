"""Chunk places, headings and page statistics, and the row form of the column expressions."""

import pytest
from pyspark.sql import functions as F

from wellspring.functions import text as X
from wellspring.operators import chunking as C

WORDS = "alpha beta gamma delta epsilon".split()
PARA = lambda n, k: " ".join(f"{WORDS[i % 5]}{k}" for i in range(n)) + "."
TEXT = "\n\n".join(["# One", PARA(300, 1), PARA(200, 2), "## Two", PARA(350, 3), "### Three ", PARA(350, 4), PARA(350, 3), PARA(120, 5)])


def test_places_of_verbatim_chunks():
    got = C.placed(TEXT, 512, 100, 0)
    at = 0
    for content, h, ratio, heading in got:
        pos = TEXT.find(content, at)
        if pos >= 0:
            assert ratio == round(pos / len(TEXT), 3)
            at = pos + len(content)
    assert [r for _, _, r, _ in got] == sorted(r for _, _, r, _ in got) and got[0][2] == 0.0 and got[0][3] is None
    assert len({h for _, h, _, _ in got}) == len(got)


def test_overlapped_chunks_are_placed_by_number():
    raw = C.split(TEXT, 512, 100)
    got = C.placed(TEXT, 512, 100, 50)
    assert got[0][0] == raw[0] and got[1][0].split()[:50] == raw[0].split()[-50:]
    lost = [(i, c) for i, c in enumerate(got) if c[0] not in TEXT]
    assert lost and all(c[2] == round(i / len(raw), 3) for i, c in lost)


def test_headings():
    text = "intro " * 600 + "\n\n# First head\n\n" + PARA(450, 1) + "\n\n## Second\n\n" + PARA(450, 2)
    got = C.placed(text, 512, 1, 0)
    assert [h for _, _, _, h in got][0] is None and {h for _, _, _, h in got} >= {"First head"} and got[-1][3] in ("First head", "Second")


def test_repeats_go_and_numbers_are_gapless(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, " "), (4, "short"), (5, PARA(400, 1) + "\n\n# h\n\n" + PARA(400, 1) + "\n\n" + PARA(300, 2))], "doc_id bigint, text string")
    rows = C.chunk(df, overlap=0).collect()
    for i in (1, 4, 5):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in own] == list(range(len(own))) and len({r.content_hash for r in own}) == len(own)
    assert not [r for r in rows if r.doc_id in (2, 3)]
    stats = {r.doc_id: r for r in C.page_stats(C.chunk(df, overlap=0)).collect()}
    for i in (1, 4, 5):
        own = [r.token_count for r in rows if r.doc_id == i]
        assert (stats[i].total_chunks, stats[i].total_tokens, stats[i].avg_chunk_size) == (len(own), sum(own), pytest.approx(sum(own) / len(own), abs=0.051))
    assert C.chunk(df.limit(0)).count() == 0


def test_row_forms_equal_the_expressions(spark):
    texts = ["A b c", " x\t\ty\n ", "", "Ünï  CODE", "w " * 700, "a b c d e f g h"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts] + [(None, b) for b in texts], "prev string, raw string")
    for r in df.select("prev", "raw", C.with_overlap(F.col("prev"), F.col("raw"), 5, 60).alias("c"), X.content_hash(F.col("raw")).alias("h")).collect():
        assert C.led(r.prev, r.raw, 5, 60) == r.c and C.key(r.raw) == r.h
