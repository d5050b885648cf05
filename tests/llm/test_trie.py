"""op12 against a dictionary of prefixes and its SQL, over blocks of every size."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from wellspring.llm import trie

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """convs: id -> list of (turn, words); the nodes by a dictionary of prefixes."""
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    below = defaultdict(set)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].add(p)
    out = []
    for p, m in members.items():
        kids = [q for q in below[p] if len(q) == len(p) + 1]
        leaves = [q for q in below[p] if below[q] == {q}]
        saved = sum((len(members[q]) - 1) * (q[-1][1] if q else 0) for q in below[p])
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def frame(spark, convs, parts=3):
    data = [(c, [(0, hashlib.md5(str(t).encode()).hexdigest(), w) for t, w in seq]) for c, seq in convs.items()]
    return spark.createDataFrame(data, "conv_id bigint, turns array<struct<turn:bigint,name:string,words:int>>").repartition(parts)


def local(convs, sizes):
    """The three passes in plain Python over sorted conversations cut into blocks of the given sizes."""
    key = lambda seq: b"".join(hashlib.md5(str(t).encode()).digest() for t, _ in seq)
    order = sorted((key(s), c, [w for _, w in s]) for c, s in convs.items())
    blocks, at = [], 0
    while at < len(order):
        own = order[at : at + sizes[len(blocks) % len(sizes)]]
        at += len(own)
        lcp = [0, *(trie.shared(a[0], b[0]) for a, b in zip(own, own[1:]))]
        blocks.append({"block": len(blocks), "conv": [x[1] for x in own], "length": [len(x[2]) for x in own], "lcp": lcp, "words": [w for x in own for w in x[2]], "first_key": own[0][0], "last_key": own[-1][0]})
    seam, n = trie.seams(blocks), [len(b["conv"]) for b in blocks]
    state = trie.merged([trie.Block(b, *seam[b["block"]]).summary() for b in blocks], n)
    out = []
    for b, s in zip(blocks, state):
        path = list(s["path"])
        for k, d, size, least, children, leaves, saved in sorted(trie.Block(b, *seam[b["block"]]).nodes(s["offset"], s["carry"])[0]):
            del path[d:]
            path.append(least)
            out.append((least, d, path[d - 1] if d else None, size, children, leaves, saved))
    return sorted(out, key=str)


def test_blocks_of_every_size_agree_with_a_dictionary():
    r = random.Random(3)
    for _ in range(400):
        ids = r.sample(range(-50, 500), r.randint(1, 25))
        words = {t: r.randint(0, 9) for t in range(3)}
        convs = {c: [(t, words[t]) for t in (r.randrange(r.choice([1, 2, 3])) for _ in range(r.randint(0, 6)))] for c in ids}
        want = [x[:7] for x in brute(convs)]
        for sizes in ([1], [2], [1, 3, 2], [7], [100]):
            assert local(convs, sizes) == sorted(want, key=str), (convs, sizes)


@pytest.mark.parametrize("block", [1, 3, 50_000])
def test_spark_agrees_with_a_dictionary(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK_CONVS", block)
    r = random.Random(block)
    convs = {c: [(t, t + 1) for t in (r.randrange(2) for _ in range(r.randint(0, 5)))] for c in r.sample(range(1000), 60)}
    convs |= {c: [(5, 6), (6, 7)] for c in range(2000, 2040)}  # one list of ids over many blocks
    convs |= {3000: [(i % 3, i % 3 + 1) for i in range(300)], 3001: [(i % 3, i % 3 + 1) for i in range(299)]}
    assert rows(trie.trie(frame(spark, convs))) == brute(convs)


def test_rebuilding(spark):
    data = [(20, None, None, "x y"), (20, 1, "u", None), (20, 1, "u", None), (23, 0, "a", "p"), (23, 1, "a", "q"), (23, 2, "a", "r"), (23, 3, "a", "s"), (45, 0, "b", "z"), (None, 0, "c", "z"), (-3, 5, "d", "w")]
    turns = spark.createDataFrame([(*x, "clash") for x in data], "conv_id bigint, turn bigint, role string, text string, turns string")
    own = {r.conv_id: [t.name for t in r.turns] for r in trie.conversations_of(turns).collect()}
    assert len(own[20]) == 3 and own[20][1] == own[20][2] and set(own) == {20, 23, 45, -3}
    got = {r.conv_id: [t.name for t in r.turns] for r in trie.rebuilt(trie.conversations_of(turns)).collect()}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - c % 20 if c >= 0 else c - -(-c % 20), [])
        assert got[c] == base[:h] + own[c][h:], c


def test_edges(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert trie.trie(trie.rebuilt(trie.conversations_of(none))).count() == 0
    only = {7: [], 9: []}  # turnless conversations are members of a root without children
    assert rows(trie.trie(frame(spark, only))) == brute(only) == [(7, 0, None, 2, 0, 1, 0, hashlib.sha256(b"7,9").hexdigest())]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cols = ", ".join(COLUMNS)
    want = sorted((tuple(r) for r in con.execute(f"SELECT {cols} FROM ({trie.ORACLE})").fetchall()), key=str)
    assert rows(trie.op12_trie(spark, SF)) == want
