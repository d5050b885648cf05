"""Every training document trains the attention model."""

import numpy as np

from wellspring.llm import lm


def test_each_document_trains_the_attention(spark):
    text = "red green blue " * 40
    for doc_id in (None, 1, 2, 3):
        docs = spark.createDataFrame([(doc_id, text)], "doc_id bigint, text string")
        path = lm.tokenizer_path()
        counts = lm.word_counts(docs.select("text"))
        speller = spark.sparkContext.broadcast(lm.Speller(*lm.spelling_counts(counts, path), lm.VOCAB))
        assert np.abs(lm.fit(docs, speller, path) - lm.Attention().flat).max() > 1e-3


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = []
    for d in (docs.coalesce(1), docs.repartition(3), docs.repartition(7, "text")):
        got.append({r.doc_id: (r.score, r.base_score) for r in lm.score(d).collect()})
    for other in got[1:]:
        assert set(other) == set(got[0])
        assert all(np.allclose(other[i], got[0][i], rtol=1e-6, atol=1e-5) for i in other)


def test_score_matches_brute_force(spark):
    """One text against a plain loop over positions: attention, spelling, gate and mixture."""
    rows = [(i, " ".join(f"red green blue w{i % 7} tail{j % 5}" for j in range(12))) for i in range(30)]
    docs, path = spark.createDataFrame(rows, "doc_id bigint, text string"), lm.tokenizer_path()
    train = docs.filter(~lm.held_out())
    counts = lm.word_counts(train.select("text"))
    speller = lm.Speller(*lm.spelling_counts(counts, path), lm.VOCAB)
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    model = lm.Attention(lm.fit(train, spark.sparkContext.broadcast(speller), path))
    words = lm.Words(lm.Spelling(path), speller)
    n, v = sum(c.values()), len(c)
    low, p_end = n + 0.1 * (v + 1), (c[lm.END] + 0.5) / (n + 1.0)
    own = lm.tokens(rows[3][1].encode())
    types = words.types(own)
    ids, base, ends = words.gather(types)
    lead, step = lm.WINDOW - lm.STRIDE, lm.STRIDE
    p, z = np.zeros(len(ids)), np.zeros(len(ids))
    for t in range(len(ids)):
        first = max(0, t // step * step - lead)  # the window that scores t
        prev = lambda j: lm.VOCAB if j == 0 else ids[j - 1]
        e = np.array([np.exp(model.q[prev(t)] @ model.k[prev(j)] * model.scale + model.bias[t - j]) for j in range(first, t)])
        s = np.exp(model.sentinel[prev(t)])
        pad = np.array([np.exp(model.q[prev(t)] @ model.k[lm.VOCAB] * model.scale + model.bias[t - j]) for j in range(t // step * step - lead, first)])
        total = e.sum() + pad.sum() + s
        p[t], z[t] = (e @ (ids[first:t] == ids[t]) + s * base[t]) / total if t > first else s * base[t] / total, s / total
    want, at = np.log10((1 - lm.LEAST) * (c[lm.END] + 0.1) / low + lm.LEAST * p_end), 0
    for w, k, end in zip(own, types, ends):
        g = min(max(lm.MOST * (1 - z[at]) ** 2, lm.LEAST), lm.MOST)
        want += np.log10((1 - g) * (c.get(w, 0) + 0.1) / low + g * np.prod(p[at:end]) * 10 ** words.go[k] * (1 - p_end))
        at = end
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    assert abs(got[3] - want) < 1e-3 * abs(want)


def test_sums_of_parts_are_the_sum_of_the_whole():
    rng = np.random.default_rng(5)
    m = lm.Attention(vocab=9, width=4, window=8)
    ids, prev, base = rng.integers(-1, 9, (6, 8)), rng.integers(0, 10, (6, 8)), rng.uniform(0.05, 0.4, (6, 8)).astype(np.float32)
    whole, parts = lm.Sums(m), lm.Sums(m)
    whole.add(prev, ids, base, 4)
    for i in range(6):
        parts.add(prev[i : i + 1], ids[i : i + 1], base[i : i + 1], 4)
    assert whole.n == parts.n == (ids[:, 4:] >= 0).sum()
    assert np.allclose(whole.gradient(), parts.gradient(), atol=1e-5)


def test_a_worker_spells_a_word_once():
    path = lm.tokenizer_path()
    speller = lm.Speller(np.ones((lm.BUCKETS, lm.VOCAB + 1)), np.ones((lm.VOCAB + 1, lm.VOCAB + 1)), lm.VOCAB)
    words, asked = lm.words_of(path, speller), []
    many = words.spelling.many
    words.spelling.many = lambda new: asked.extend(new) or many(new)
    first = words.types([b"red", b"green", b"red"])
    again = lm.words_of(path, speller).counted({b"green": 4}).types([b"green", b"red", b"blue"])
    assert asked == [b"red", b"green", b"blue"]
    assert first.tolist() == [0, 1, 0] and again.tolist() == [1, 0, 2]
    assert words.count[again].tolist() == [4, 0, 0]
