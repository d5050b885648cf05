"""Texts are scored in tiles, with the neighbours of a full scan; words are found without the pattern."""

import numpy as np
import pyarrow as pa

from wellspring.llm import toxicity


def vectors(rng, n, terms):
    m = np.where(rng.random((n, terms)) < 0.08, rng.random((n, terms)), 0.0)
    m[:, 0] += 0.01
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def test_tiles_have_the_neighbours_of_a_full_scan():
    rng, k = np.random.default_rng(3), 7
    for dense in (0, 5, 60):  # all terms in lists, some, all in the table
        own = vectors(rng, 900, 60)
        own[800:] = own[:100]  # ties
        e, t = np.nonzero(own)
        index = toxicity.Index(e, t, own[e, t], np.arange(900), np.arange(900) % 2, 60, block=16, dense=dense)
        m = np.concatenate([vectors(rng, toxicity.TILE + 9, 60), own[::60]])
        but = [-1] * (toxicity.TILE + 9) + list(range(0, 900, 60))
        queries = [(np.flatnonzero(v), v[v > 0], b) for v, b in zip(m, but)] + [(np.zeros(0, dtype=np.int64), np.zeros(0), -1)]
        got = list(index.votes(queries, k))
        assert got[-1][0] is None and len(got) == len(queries)
        for (terms, q, b), v, (vote, near) in zip(queries, m, got):
            cos = own @ v
            cos[b if b >= 0 else []] = -1
            best = np.sort(cos)[::-1][:k]
            assert b not in near and len(set(near)) == k
            assert np.allclose(cos[near], best, atol=2e-6)
            one, alone = index.vote(terms, q, k, b)
            assert one == vote and alone.tolist() == near.tolist()
            for a, c in zip(near, near[1:]):  # equal examples: lower first
                assert a < c or not np.array_equal(own[a], own[c])


def test_words_are_those_of_the_pattern():
    odd = ["", "a_b1c", "Über naïve–“Wort” x² ٣ß", "中文。字", "é́x​y", "x\x1cy\x85z", "".join(map(chr, range(0x2000, 0x2800))) + "a", "".join(map(chr, range(0x80, 0x700)))]
    for t in odd:
        assert toxicity.words(t) == toxicity.TERM.findall(t)


def test_terms_are_numbered_once():
    names = pa.array(["a", "b"])
    assert toxicity.number_of(names) == {"a": 0, "b": 1}
    assert toxicity.number_of(names) is toxicity.number_of(names)
