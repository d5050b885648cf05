"""Texts lie side by side as columns; windows, probabilities and gradients are those of each text's own windows."""

import numpy as np

from wellspring.llm import lm


def own_windows(ids, base):
    """Overlapping windows of one text, led by padding; each subword is in the scored half of one."""
    lead, n = lm.WINDOW - lm.STRIDE, -(-len(ids) // lm.STRIDE)
    x, b, p = np.full(n * lm.STRIDE + lead, -1), np.ones(n * lm.STRIDE + lead, dtype=np.float32), np.full(n * lm.STRIDE + lead, lm.VOCAB)
    x[lead : lead + len(ids)], b[lead : lead + len(ids)], p[lead + 1 : lead + len(ids)] = ids, base, ids[:-1]
    at = np.arange(n)[:, None] * lm.STRIDE + np.arange(lm.WINDOW)
    return p[at], x[at], b[at]


def texts(rng):
    """Of few subwords, so that many repeat; empty, short, just full and longer ones."""
    return [(rng.integers(0, 9, n), rng.uniform(0.05, 0.4, n).astype(np.float32)) for n in (0, 1, 16, 17, 0, 32, 33, 150, 5, 0)]


def laid(docs):
    return np.concatenate([i for i, _ in docs]), np.concatenate([b for _, b in docs]), np.concatenate([[0], np.cumsum([len(i) for i, _ in docs])])


def test_probabilities_are_those_of_own_windows_in_any_parts():
    docs, m = texts(np.random.default_rng(5)), lm.Attention()
    want = [np.concatenate([x.ravel()[: len(i)] for x in m.forward(*own_windows(i, b), lm.WINDOW - lm.STRIDE)]) for i, b in docs if len(i)]
    got = lm.scored(m, docs)
    assert [len(p) for p, _ in got] == [len(i) for i, _ in docs]
    assert np.array_equal(np.concatenate(want), np.concatenate([np.concatenate(x) for x in got if len(x[0])]))
    panels = lm.Panels(*laid(docs))
    for most in (1, 3, 4096):
        p = np.zeros(panels.shape, dtype=np.float32)
        for own, part in panels.parts(most):
            p[:, own] = m._forward(*part, lm.WINDOW - lm.STRIDE)[0]
        assert np.array_equal(p.ravel()[panels.place], np.concatenate([x for x, _ in got]))


def test_gradients_are_those_of_own_windows():
    docs, m = texts(np.random.default_rng(6)), lm.Attention()
    one, other = lm.Sums(m), lm.Sums(m)
    for i, b in docs:
        if len(i):
            one.add(*own_windows(i, b), lm.WINDOW - lm.STRIDE)
    for _, part in lm.Panels(*laid(docs)).parts(3):
        other.add_turned(*part, lm.WINDOW - lm.STRIDE)
    assert one.n == other.n == sum(len(i) for i, _ in docs)
    assert np.allclose(one.gradient(), other.gradient(), atol=1e-9) and np.isclose(one.loss, other.loss)


def test_texts_without_subwords():
    assert lm.scored(lm.Attention(), []) == []
    assert [len(p) for p, _ in lm.scored(lm.Attention(), [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32))])] == [0]
