"""Brute-force checks and edge cases of ops 2, 3, 6, 8 and 9."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from wellspring.llm import decontaminate, graph, mixing, quality, sharding, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "   \n\t ", None, "a", 6), (4, "one", "en", "b", 3), (5, "one two three four five", "de", "b", 23),
    (6, "w " * 60 + "end", "en", "a", 0), (6, "w " * 60 + "end", "en", "a", 0), (7, "x y z " * 20_000, "en", "a", 0), (None, "alone here", None, None, 10),
    (8, " ".join(f"t{i}" for i in range(400)), "fr", "c", 0), (9, " ".join(f"t{i}" for i in range(400)), "fr", "c", 0), (10, "Ünïcode ÉTÉ été", "fr", "c", 0),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words2(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute2(docs, items, window=10):
    out = []
    for d, t in docs:
        w, hit, ids = words2(t), set(), set()
        for i, b in items:
            q = words2(b)
            n = min(window, len(q))
            for s in range(len(q) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "t5 t6 t7 t8 t9 t10 t11 t12 t13 t14 t15 t16"), (2, "one"), (3, None), (4, ""), (5, "ÉTÉ été"), (6, "w w w w w w w w w w"), (10, "T5 T6 t7"), (11, "absent words")]


@pytest.mark.parametrize("shard_words,block", [(1_000_000, 16_000_000), (50, 10)])
def test_decontaminate_matches_brute_force(spark, edge, shard_words, block):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = edge.filter("doc_id is null or doc_id != 7")
    got = decontaminate.report(docs, bench, ["doc_id"], shard_words=shard_words, block_bytes=block)
    rows = sorted([tuple(r)[:6] for r in got.collect()], key=str)
    assert rows == brute2([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    longest = {m.item_id: m.words for r in got.collect() if r.doc_id == 8 for m in r.matches}
    assert longest == {"1": 12, "10": 3}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if not r[5])


def test_decontaminate_empty(spark, edge, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(edge, none, ["doc_id"]).filter("contaminated").count() == 0
    assert decontaminate.report(empty, none, ["doc_id"]).count() == 0


def fill(sizes, weights, share=1.5, cap=2.0):
    total, fixed, t = share * sum(sizes.values()), {}, {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weights[s] for s in free)
        t = {s: rest * weights[s] / w for s in free} if free else {}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixture(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(edge)
    rows = [r.asDict() for r in mixing.plan_of(docs, "doc_id", "text", "source", ["doc_id"]).collect()]
    again = [r.asDict() for r in mixing.plan_of(docs.repartition(7), "doc_id", "text", "source", ["doc_id"]).collect()]
    key = lambda r: (str(r["_c0"]), r["size"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["copies"] <= 2
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-4
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    out = mixing.mix(edge)
    assert out.columns == edge.columns
    assert mixing.mix(empty).count() == 0


def stats6(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g, cov = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if g[tuple(w[i : i + 3])] > 1:
            cov |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov)


def test_quality_counts_and_verdict(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(edge)
    c = quality.with_counts(docs.select("doc_id", "text"), docs["text"])
    for r in c.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats6(r.text), r.doc_id
    out = quality.quality(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert quality.quality(empty).count() == 0


def test_quality_wide_path_equals_fast_path(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(80)))) for i in range(40)]
    monkeypatch.setattr(quality, "INDEX_BITS", 4)
    c = quality.with_counts(spark.createDataFrame(texts, "doc_id bigint, text string"), quality.F.col("text"))
    assert {r.doc_id: r.n_repeat_words for r in c.collect()} == {i: stats6(t)[4] for i, t in texts}


def test_quality_finds_outliers(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("etaoinshr") for _ in range(n))
    good = [(i, " ".join(word(rng.randrange(2, 9)) for _ in range(120)), "en", "s", 0) for i in range(150)]
    bad = [(1000 + i, " ".join(word(4) + "###" for _ in range(120)), "en", "s", 0) for i in range(15)]
    kept = {r.doc_id for r in quality.quality(spark.createDataFrame(good + bad, DOCS)).collect()}
    assert kept == {g[0] for g in good}


def test_best_fit_decreasing_matches_naive():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 60))]
        bins, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [(c, b) for b, c in enumerate(bins) if c >= sizes[i]]
            if fit:
                b = min(fit)[1]
            else:
                bins.append(max(60, sizes[i]))
                b = len(bins) - 1
            bins[b] -= sizes[i]
            want[i] = b
        assert sharding.best_fit_decreasing(sizes, 60) == want


def test_every_group_is_packed_as_naive_packing_does(spark):
    """Bin loads over whole documents of sf0.01 equal those of naive best fit over all groups."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size, rows = Counter(), docs.collect()
    for r in rows:
        size[r.text] += len((r.text or "").encode()) + 1
    shards = 16
    low = max(max(size.values()), -(-sum(size.values()) // shards))
    own = sorted(size.values(), reverse=True)

    def naive(capacity):
        bins = []
        for s in own:
            fit = [(c, b) for b, c in enumerate(bins) if c >= s]
            if not fit and len(bins) == shards:
                return None
            if not fit:
                bins.append(max(capacity, s))
                fit = [(bins[-1], len(bins) - 1)]
            bins[min(fit)[1]] -= s
        return [capacity - c for c in bins]

    capacity = low
    got = Counter()
    for r in sharding.pack(docs).collect():
        got[r.shard] += len((r.text or "").encode()) + 1
    step = max(1, sum(size.values()) // shards >> 16)
    while naive(capacity) is None:
        capacity += max(1, step // 2)
    assert len(got) == len(naive(capacity)) and max(got.values()) <= capacity + 2 * step
    by_hand = sharding.best_fit_decreasing(own, capacity, shards)
    load = [0] * shards
    for s, b in zip(own, by_hand):
        load[b] += s
    assert load == naive(capacity)


def test_sharding(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(edge)
    rows = sharding.pack(docs, shards=4).collect()
    slots, where, bytes_ = defaultdict(list), {}, Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        assert where.setdefault(r.text, r.shard) == r.shard
        bytes_[r.shard] += len((r.text or "").encode()) + 1
    assert len(rows) == docs.count() and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.pack(empty).count() == 0
    full = sharding.pack(docs, shards=None, capacity=300_000)
    load = Counter()
    for r in full.collect():
        load[r.shard] += len((r.text or "").encode()) + 1
    assert max(load.values()) <= 300_000


def simhash_brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fs}


def test_simhash_matches_brute_force(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(edge).select("doc_id", "text")
    base = simhash.scratch.table(simhash.with_fingerprint(docs, [simhash.F.col("doc_id")], simhash.F.col("text")))
    fp = [simhash_brute(r.text) for r in docs.collect()]
    ids = [r.doc_id for r in docs.collect()]
    comp = brute_components(fp)
    least = {}
    for i, f in zip(ids, fp):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = sorted(((i, f"{f:016x}", least.get(comp[f])) for i, f in zip(ids, fp)), key=str)
    got = simhash.classes(base).select("doc_id", simhash.hex_of(simhash.F.col("fp")), "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    kept = simhash.dedup(edge)
    assert kept.columns == edge.columns
    assert kept.count() == len({comp[simhash_brute(r[1])] for r in EDGE})
    assert simhash.dedup(empty).count() == 0


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_links_lose_nothing(spark, blocks):
    rng = np.random.default_rng(blocks)
    center = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(map(int, center))
    for c in center[:20]:
        for _ in range(30):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    e = simhash.links(spark.createDataFrame(signed, "fp bigint"), 4, blocks)
    roots = {r.node: r.root for r in graph.components(e).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for f in fps:
        s = f - 2**64 if f >= 2**63 else f
        got[roots.get(s, s)].add(f)
    for f, r in brute_components(fps).items():
        want[r].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
