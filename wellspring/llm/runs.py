"""Periodic runs of words (maximal repetitions) from longest Lyndon words.

Every run has, under the order of its word numbers or under the reverse order, a root that is the longest Lyndon
word starting at its place. One scan from right to left for each order finds these words with a stack (kept
as links to the next smaller suffix). Suffixes that begin alike are compared by their longest common extension (LCE):
a binary search over rolling hashes, whose stretch is then checked word by word; a checked stretch serves later
comparisons at the same distance, so a long repetition is hashed and checked once, not once a word. Roots
are extended to both sides by the same search, for all roots of a text at once, and each run found is checked word
by word. No suffix array is built.

Defined results: null and empty texts have no words and no runs; words are cut at the ASCII white space
``\\x20\\x09-\\x0D`` alone; a stretch that several roots lead to is one run; ties for the best run go to the smallest
start, then period; repeated rows are each answered; an empty table gives an empty result; a very long text is one
row of one task, which takes time proportional to its words (and their logarithm) and about 300 bytes a word. The
operator returns ``doc_id`` and its own columns only, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

MIN_LENGTH, MIN_PERIODS = 6, 4
NEAR = 4  # words compared one by one before hashes are asked
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # any odd number

OUT = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Words:
    """The words of one text as numbers, and the LCE of any two places."""

    def __init__(self, number: list[int]):
        self.n = len(number)
        self.number = np.asarray(number, dtype=np.int64)
        self._sums = self._lists = None

    @property
    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of mixed numbers times powers of BASE, and the powers, modulo 2**64."""
        if self._sums is None:
            power = np.full(self.n + 1, BASE, dtype=np.uint64)
            power[0] = 1
            power = np.cumprod(power, dtype=np.uint64)
            x = self.number.astype(np.uint64) + np.uint64(1)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            self._sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * power[:-1], dtype=np.uint64)]), power
        return self._sums

    def lce(self, i: int, j: int, checked: tuple[int, int]) -> int:
        """How many words from i and from j > i are alike: hashes, then the words themselves, but for those in a stretch that was checked at this distance."""
        if self._lists is None:
            self._lists = tuple(a.tolist() for a in self.sums)
        s, power = self._lists
        si, sj, shift = s[i], s[j], power[j - i]
        low, high = 0, self.n - j
        while low < high:
            m = (low + high + 1) // 2
            if ((s[i + m] - si) * shift - s[j + m] + sj) & MASK:
                high = m - 1
            else:
                low = m
        new = low if i + low < checked[0] else checked[0] - i
        same = self.number[i : i + new] == self.number[j : j + new]
        if not same.all():
            return int(same.argmin())
        return low if new == low else checked[1] - i

    def alike(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the k words from i and from j >= i have the same hash."""
        s, power = self.sums
        return (s[i + k] - s[i]) * power[j - i] == s[j + k] - s[j]

    def extend(self, i: np.ndarray, j: np.ndarray, left: bool) -> np.ndarray:
        """LCEs of all pairs of places, to the right from i and j > i or to the left before them, by hashes."""
        low, high = np.zeros(len(i), dtype=np.int64), (i if left else self.n - j).copy()
        while (open_ := low < high).any():
            m = (low + high + 1) // 2
            a, b = (i - m, j - m) if left else (i, j)
            same = self.alike(a, b, m)
            low, high = np.where(open_ & same, m, low), np.where(open_ & ~same, m - 1, high)
        return low

    def lyndon(self, reverse: bool) -> np.ndarray:
        """For each place the end of the longest Lyndon word that starts there: the next smaller suffix."""
        n = self.n
        w = (self.number.max() - self.number if reverse else self.number).tolist()
        w.append(-1)  # the end is smaller than any word
        after = [n] * (n + 1)
        known: dict[int, tuple[int, int]] = {}  # distance -> a checked stretch of like words, up to the first unlike one
        for i in range(n - 2, -1, -1):
            a, j = w[i], i + 1
            while True:
                c = w[j]
                if a < c:
                    j = after[j]
                    continue
                if a > c:
                    break
                k = 1
                while k < NEAR and w[i + k] == w[j + k]:
                    k += 1
                if k == NEAR:
                    first, end = known.get(j - i, (n, n))
                    if i < first - 1:
                        end = i + self.lce(i, j, (first, end))
                    known[j - i] = (i, end)
                    k = end - i
                if w[i + k] < w[j + k]:
                    j = after[j]
                else:
                    break
            after[i] = j
        return np.asarray(after[:n], dtype=np.int64)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run of MIN_LENGTH words and MIN_PERIODS periods at least, by start, then period."""
        n, w = self.n, self.number
        found: dict[tuple[int, int], int] = {}
        if n < MIN_LENGTH:
            return []
        for reverse in (False, True):
            root = np.arange(n)
            period = self.lyndon(reverse) - root
            # the first root of a run that long is followed by itself
            root = root[root + 2 * period <= n]
            period = period[root]
            alike = (w[root] == w[root + period]) & (w[root + period - 1] == w[root + 2 * period - 1])
            root, period = root[alike], period[alike]
            if not len(root):
                continue
            before = np.maximum(root - period, 0)
            first = (root < period) | ~self.alike(before, root, np.where(root < period, 0, period))
            root, period = root[first], period[first]  # a root that follows its like is one of the same run
            start = root - self.extend(root, root + period, True)
            length = root + period + self.extend(root, root + period, False) - start
            long = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * period)
            for s, p, k in zip(start[long].tolist(), period[long].tolist(), length[long].tolist()):
                found[s, p] = k
        return sorted((s, k, p) for (s, p), k in found.items() if self.holds(s, k, p))

    def holds(self, start: int, length: int, period: int) -> bool:
        """Whether the stretch keeps the period word by word and neither neighbour does."""
        w, end = self.number, start + length
        inside = np.array_equal(w[start : end - period], w[start + period : end])
        return inside and (start == 0 or w[start - 1] != w[start - 1 + period]) and (end == self.n or w[end] != w[end - period])


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for s, k, p in runs:
        depth[s + p] += 1
        depth[s + k] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def answer(words: list[bytes]) -> tuple:
    """The result columns after doc_id for one text's words."""
    number: dict[bytes, int] = {}
    runs = Words([number.setdefault(x, len(number)) for x in words]).runs()
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()
    kept = b" ".join(collapsed(words, runs))
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    spans = [{"start": s, "length": k, "period": p} for s, k, p in runs]
    return (len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest(), spans, kept.decode())


def planted(words: list[bytes], h: int | None) -> list[bytes]:
    """Words from place a on repeat the first p of them, in texts whose h ends in 0 (h: crc32 of the id)."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // p))[: n - a]


def find(docs: DataFrame, plant: Column | None = None) -> DataFrame:
    """docs (doc_id bigint, text) -> the columns of OUT, one row per row; ``plant`` is planted()'s h."""
    h = F.lit(None) if plant is None else plant

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [answer(planted((t.as_py() or "").encode().split(), x)) for t, x in zip(b.column(1), b.column(2).to_pylist())]
            own = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])), pa.string()]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(own, kinds))], names=names)

    return docs.select("doc_id", "text", h.cast("bigint").alias("_h")).mapInArrow(run, OUT)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of documents, after the contract's planting."""
    docs = scratch.docs_of(spark, sf_dir).select("doc_id", "text")
    return find(docs, F.crc32(F.col("doc_id").cast("string").cast("binary"))).drop("runs", "collapsed")
