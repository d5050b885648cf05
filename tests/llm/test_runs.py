"""op11 against brute force over all periods, and its edge cases."""

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wellspring.llm import runs

SF = "/root/testdata/sf0.001"


def brute(w):
    """Every maximal repetition of length >= max(6, 4 * smallest period), by trying all periods."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p - i), p)  # the smallest period of a stretch comes first
            i = j + 1
    return sorted((s, k, p) for (s, k), p in found.items())


def expected(text, doc_id, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = brute(w)
    gone = {i for s, k, p in r for i in range(s + p, s + k)}
    best = None
    for s, k, p in r:
        if best is None or (k * best[2], -s, -p) > (best[1] * p, -best[0], -best[2]):
            best = (s, k, p)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(r), *top, sha("".join(f"{s},{k},{p}\n" for s, k, p in r)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(0, 9), st.lists(st.integers(0, 2), max_size=12))
def test_runs_are_all_maximal_repetitions(head, unit, times, tail):
    w = head + unit * times + tail
    assert runs.Words(w).runs() == brute(w)


def test_nested_and_overlapping_runs():
    w = ([1] * 6 + [2]) * 5 + [1] * 3 + [1, 2] * 4
    assert runs.Words(w).runs() == brute(w)
    assert {p for _, _, p in brute(w)} == {1, 2, 7}


def test_false_hash_stretches_are_caught():
    w = runs.Words([1, 2, 3, 4] * 8)
    w._lists = ([0] * 33, [0] * 33)  # every two stretches hash alike
    assert w.lce(0, 1, (32, 32)) == 0 and w.lce(0, 4, (32, 32)) == 28
    assert not w.holds(0, 31, 4) and w.holds(0, 32, 4)


def test_long_texts(spark):
    texts = ["a b c d " * 50_000 + "e", "x " * 120_000, " ".join(str(i % 997) for i in range(60_000))]
    got = runs.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [(r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in got] == [(1, 0, 200_000, 4, 50_000_000), (1, 0, 120_000, 1, 120_000_000), (1, 0, 60_000, 997, 60_180)]
    assert [r.collapsed for r in got] == ["a b c d e", "x", " ".join(map(str, range(997)))]


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, "a a a a a a\xa0a", 5), (None, "b b b b b b", 5), (4, "a a a a a a\xa0a", 5), (7, "a\x0ba\x0ca\ra a\ta b", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_runs int")
    got = {r.doc_id: r for r in runs.find(df).collect()}
    assert runs.find(df).count() == 7 and got[1].n_runs == got[2].n_runs == got[3].n_runs == 0 and got[1].start is None
    assert got[4].n_runs == 0 and got[None].length == 6 and (got[7].start, got[7].length) == (0, 6)
    assert got[1].runs_sha256 == hashlib.sha256(b"").hexdigest() == got[1].collapsed_sha256
    assert got[7].collapsed == "a b" and [tuple(x) for x in got[7].runs] == [(0, 6, 1)]
    assert runs.find(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_query_equals_brute_force(spark, sf):
    got = runs.op11_runs(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(docs) and any(r.n_runs for r in got)
    short = [r for r in got if len((docs[r.doc_id] or "").split()) < 1500]
    assert len(short) > 150
    for r in short:
        assert tuple(r)[1:] == expected(docs[r.doc_id], r.doc_id), r.doc_id
