"""LM scoring: causal self-attention over subword ids, trained in numpy, on corpus word statistics.

The probability of a word is a mixture of its share in all training tokens and a subword model:

    P(word) = (1 - g) * (c + 0.1) / (N + 0.1 * (V + 1)) + g * P_sub(word)

over the same events as the base score (words seen in training, and the unseen). The gate g is the
squared share of attention that does not go to the sentinel where the word begins, so it opens where a
text repeats itself. P_sub spells the word in subwords of a public tokenizer's first ``VOCAB`` ranks
(never trained here). Each
subword is predicted by single-head causal self-attention with a sentinel: the query is the embedding
of the previous subword, keys are embeddings of what stood before earlier subwords, attention
weights with a bias by distance vote for those subwords, and the sentinel's weight goes to a spelling
model (interpolated counts of subwords by the two before within the word, from the vocabulary of all
training texts). Word ends come from the spelling model. Embeddings, distance bias and sentinel are
trained with Adam: every training document belongs by its text's hash to one of ``STEPS`` steps, whose gradient is summed
over the cluster, so the layout of the rows changes no score beyond rounding. Texts are scored in windows of ``WINDOW`` subwords moved by
``STRIDE``: each subword is scored once, with at least WINDOW - STRIDE subwords before it where the text has them.

Counts of the ``HEAD`` most frequent words are broadcast (a fixed bound); other words meet their counts
in a shuffle that carries one row per occurrence of a rare word.

Defined results: a null text is an empty text of one end token; a null doc_id is training text;
repeated rows are counted and scored one by one; equal counts at the edge of the head are ordered by word and change no score; very long
texts are scored whole, window by window; with no training tokens base_score is 0; an empty table gives an empty result; other
columns of docs are left out of the result, whatever their names.
"""

from __future__ import annotations

import base64
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, partial
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

TOKENIZER = "byte_bpe_50k.tiktoken"
VOCAB, WINDOW, STRIDE, WIDTH = 1024, 32, 16, 16
HEAD = 200_000
LEAST, MOST = 0.002, 0.95  # of the gate
BUCKETS = 1 << 11  # at most (BUCKETS + VOCAB + 1) * (VOCAB + 1) counts reach the driver: 50 MB
STEPS, RATE = 8, 0.08
END = b" "  # cannot be a word
PAD = 1 << 30  # no subword
SLICE_WORDS = 200_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Spelling:
    """Subword ids of words by the first VOCAB ranks of a public byte-level BPE."""

    def __init__(self, path: str, vocab: int = VOCAB):
        import tiktoken

        with open(path, "rb") as f:
            pairs = (line.split() for line in f)
            ranks = {base64.b64decode(a): int(b) for a, b in pairs if int(b) < vocab}
        self.encode = partial(tiktoken.Encoding("first_ranks", pat_str=r"[^ ]{1,48}| ", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy, disallowed_special=())
        self.vocab, self.space = vocab, ranks[b" "]

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each closed by vocab, and the end offset of each; words hold no space."""
        flat = np.append(self.encode(b" ".join(words).decode("utf-8", "replace")).astype(np.int32), np.int32(self.vocab))
        flat[flat == self.space] = self.vocab
        return flat, np.flatnonzero(flat == self.vocab) + 1


def context(a, b):
    """Bucket of the two subwords before; -1 stands for the word's start."""
    return ((a + 1) * 1031 + (b + 1)) * 2654435761 & (BUCKETS - 1)  # a power of 2


def before(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One and two subwords before each position within its word; -1 before the word."""
    b = np.concatenate([[-1], flat[:-1]]).astype(np.int64)
    b[ends[:-1]] = -1
    a = np.concatenate([[-1], b[:-1]])
    a[b < 0] = -1
    return b, a


class Speller:
    """P(subword or end | two subwords before within the word), interpolated with one before and none."""

    def __init__(self, two: np.ndarray, one: np.ndarray, vocab: int):
        """two: (BUCKETS, vocab + 1) and one: (vocab + 1, vocab + 1) counts; the last column is the word's end, the last row of one its start."""
        zero = one.sum(axis=0) + 0.5
        self.one = ((one + 8.0 * zero / zero.sum()) / (one.sum(axis=1, keepdims=True) + 8.0)).astype(np.float32)
        self.two, self.total, self.vocab = two.astype(np.float32), two.sum(axis=1), vocab

    def spell(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """flat: ids of words, each closed by vocab at ends - 1. Per subword its probability given that the
        word goes on, and per word log10 of the probability that it goes on and ends just so."""
        b, a = before(flat, ends)
        c, v = context(a, b), self.vocab
        n = self.total[c] + 4.0
        two, one = c * (v + 1), np.where(b < 0, v, b) * (v + 1)
        end = np.where(b >= 0, (self.two.take(two + v) + 4.0 * self.one.take(one + v)) / n, 0.0)
        p = (self.two.take(two + flat) + 4.0 * self.one.take(one + flat)) / n / np.maximum(1.0 - end, 1e-9)
        last = flat == v
        go = np.log10(np.maximum(np.where(last, end, 1.0 - end), 1e-12))
        return p[~last].astype(np.float32), np.add.reduceat(go, np.concatenate([[0], ends[:-1]]))


class Attention:
    """The trained part: query and key embeddings, distance bias, sentinel logit by previous subword."""

    def __init__(self, params: np.ndarray | None = None, vocab: int = VOCAB, width: int = WIDTH, window: int = WINDOW):
        self.shapes = [(vocab + 1, width), (vocab + 1, width), (window,), (vocab + 1,)]
        if params is None:
            rng = np.random.default_rng(7)
            e = rng.normal(0, 1.0, (vocab + 1, width))
            params = np.concatenate([e.ravel(), e.ravel(), np.zeros(window), np.full(vocab + 1, 6.0)])
        self.flat = np.array(params, dtype=np.float32)
        parts = np.split(self.flat, np.cumsum([math.prod(s) for s in self.shapes])[:-1])
        self.q, self.k, self.bias, self.sentinel = [p.reshape(s) for p, s in zip(parts, self.shapes)]
        np.clip(self.flat, -4.0 - 0.25 * width, 4.0 + 0.25 * width, out=self.flat)  # logits stay far from overflow
        self.window, self.scale = window, 1.0 / math.sqrt(width)

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp of every logit of a query and a key subword, of the bias by distance and of the sentinel, of the parameters as they are at first use.

        A query whose logits are beyond 60 has all of them lowered alike, which changes no share.
        """
        e = np.matmul(self.q * np.float32(self.scale), self.k.T)
        over = np.maximum(np.maximum(e.max(axis=1) + self.bias.max(), self.sentinel) - np.float32(60.0), np.float32(0.0))
        return np.exp(e - over[:, None]).ravel(), np.exp(self.bias), np.maximum(np.exp(self.sentinel - over), np.float32(1e-30))

    def _forward(self, prev: np.ndarray, ids: np.ndarray, base: np.ndarray, first: int, train: bool = False):
        """forward() of what turned() or panels() give, one distance after another."""
        w, rows = ids.shape[0], self.q.shape[0]
        table, bias, sentinel = self.tables
        at, ez, lags = prev[first:] * rows, sentinel[prev[first:]], []
        total, hit = ez.copy(), ez * base
        pair, e, same, equal = (np.empty(at.shape, dtype=x) for x in (np.intp, np.float32, np.float32, np.bool_))
        for back in range(1, w):
            t = max(first, back)
            if train:
                pair, e, same = (np.empty(at[t - first :].shape, dtype=x.dtype) for x in (pair, e, same))
            elif t > first:
                pair, e, same = pair[: w - t], e[: w - t], same[: w - t]
            np.add(at[t - first :], prev[t - back : w - back], out=pair)
            np.take(table, pair, out=e, mode="clip")
            e *= bias[min(back, self.window - 1)]
            total[t - first :] += e
            np.multiply(e, np.equal(ids[t:], ids[t - back : w - back], out=equal[: w - t]), out=same)
            hit[t - first :] += same  # e where the subwords are the same, else 0
            if train:
                lags.append((back, t - first, pair, e, same))
        return hit / total, ez / total, (total, lags)

    def forward(self, prev: np.ndarray, ids: np.ndarray, base: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Probability of ids[:, first:], of windows (n, window), and the sentinel's weight there; positions of id -1 are padding.

        Masked attention: position t sees values j < t of its own window.
        """
        p, z, _ = self._forward(*turned(prev, ids, base, first), first)
        return p.T, z.T

    def step(self, prev: np.ndarray, ids: np.ndarray, base: np.ndarray, first: int) -> tuple[float, np.ndarray]:
        """Mean loss of the scored positions and its gradient."""
        sums = Sums(self)
        sums.add(prev, ids, base, first)
        return sums.loss / max(1, sums.n), (sums.gradient() / max(1, sums.n)).astype(np.float32)


def turned(prev: np.ndarray, ids: np.ndarray, base: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, window) with positions in rows and windows in columns, padding as PAD; base of the scored positions alone."""
    return np.ascontiguousarray(prev.T, dtype=np.intp), np.ascontiguousarray(np.where(ids.T < 0, PAD, ids.T), dtype=np.int32), np.ascontiguousarray(base.T[first:])


class Sums:
    """Loss of a model and its derivatives by the logit of each pair of subwords, by distance and by sentinel, summed over windows."""

    def __init__(self, model: Attention):
        rows = model.q.shape[0]
        self.model, self.n, self.loss = model, 0, 0.0
        self.pair, self.bias, self.sentinel = np.zeros(rows * rows), np.zeros(model.window), np.zeros(rows)

    def add(self, prev: np.ndarray, ids: np.ndarray, base: np.ndarray, first: int) -> None:
        self.add_turned(*turned(prev, ids, base, first), first)

    def add_turned(self, prev: np.ndarray, ids: np.ndarray, base: np.ndarray, first: int) -> None:
        p, z, (total, lags) = self.model._forward(prev, ids, base, first, True)
        live, least = ids[first:] != PAD, np.maximum(p, np.float32(1e-12))
        self.n += int(live.sum())
        self.loss -= float(np.log(least[live]).sum(dtype=np.float64))
        g = np.where(live, 1 / least, np.float32(0.0))
        g0 = g / total
        dense = p * g0
        for back, t, pair, e, same in lags:
            e *= dense[t:]
            same *= g0[t:]
            e -= same
            ds = e.ravel().astype(np.float64)
            self.bias[min(back, self.model.window - 1)] += ds.sum()
            np.add.at(self.pair, pair.ravel(), ds)
        dz = -z * (base - p) * g
        self.sentinel += np.bincount(prev[first:].ravel(), dz.ravel(), minlength=len(self.sentinel))

    def gradient(self) -> np.ndarray:
        """By parameter, in the order of the model's."""
        m, pair = self.model, self.pair.reshape(len(self.sentinel), -1) * self.model.scale
        return np.concatenate([(pair @ m.k).ravel(), (pair.T @ m.q).ravel(), self.bias, self.sentinel])


def adam(params: np.ndarray, grads: Iterator[np.ndarray], rate: float = RATE) -> np.ndarray:
    """Parameters after one Adam step for each gradient; grads may look at params, which is updated in place."""
    m, v = np.zeros(len(params)), np.zeros(len(params))
    for i, g in enumerate(grads, 1):
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params -= (rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return params


def put(old: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """new written into old from position at on; a longer copy where old is too short."""
    if at + len(new) > len(old):
        old = np.concatenate([old[:at], np.empty(max(len(new), at // 2), dtype=old.dtype)])
    old[at : at + len(new)] = new
    return old


class Words:
    """Spelled word types: subword ids, their base probabilities and the rest factor, gathered by type number."""

    def __init__(self, spelling: Spelling, speller: Speller, head: dict[bytes, int] | None = None, most: int = 400_000):
        self.spelling, self.speller, self.head, self.most = spelling, speller, head or {}, most
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # the next number
        self.ids, self.p = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)  # these and the next may be longer than what they hold
        self.start, self.go, self.count = np.zeros(1, dtype=np.int64), np.zeros(0), np.zeros(0)
        self.met = np.zeros(0, dtype=np.int32)  # calls of types() that asked for it

    def forget(self) -> None:
        """The half of ``most`` that was met most often stays, under new numbers; other words are spelled again when they come."""
        words = list(self.number)
        stay = np.sort(np.argsort(-self.met[: len(words)], kind="stable")[: self.most // 2])
        self.ids, self.p, ends = self.gather(stay)
        self.start, self.go, self.count, self.met = np.concatenate([[0], ends]), self.go[stay], self.count[stay], self.met[stay]
        self.number.clear()
        self.number.update(zip(map(words.__getitem__, stay.tolist()), range(len(stay))))

    def types(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, good until the next call."""
        if len(self.number) > self.most:
            self.forget()
        old = len(self.number)
        out = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self.number) > old:
            new = list(islice(reversed(self.number), len(self.number) - old))[::-1]
            v = self.speller.vocab
            flat, at = self.spelling.many(new)
            p, go = self.speller.spell(flat, at)
            held = int(self.start[old])
            self.start = put(self.start, old + 1, held + at - np.arange(1, len(at) + 1))  # without the ends of words
            self.ids, self.p, self.go = put(self.ids, held, flat[flat != v]), put(self.p, held, p), put(self.go, old, go)
            self.count, self.met = put(self.count, old, self._counts(new)), put(self.met, old, np.zeros(len(new), dtype=np.int32))
        self.met[out] += 1
        return out

    def _counts(self, words) -> np.ndarray:
        return np.fromiter(map(self.head.get, words, repeat(0)), dtype=np.float64, count=len(words))

    def counted(self, head: dict[bytes, int]) -> Words:
        """From now on counts are those of head."""
        if head is not self.head:
            self.head = head
            self.count = self._counts(self.number)
        return self

    def gather(self, types: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subword ids, base probabilities and the end offset of each word."""
        n = self.start[types + 1] - self.start[types]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[types] - (ends - n), n)
        return self.ids[at], self.p[at], ends


_spelled: list[Words] = []


def words_of(path: str, speller: Speller) -> Words:
    """The Python worker's spelled words under this speller; its later tasks find what earlier ones have spelled."""
    if not _spelled or _spelled[0].speller is not speller:
        _spelled[:] = [Words(Spelling(path), speller)]
    return _spelled[0]


class Panels:
    """Texts as columns of STRIDE subwords side by side, each text led by a column of padding.

    A column and the one before it are a window of WINDOW = 2 * STRIDE subwords whose later half is scored, so
    every subword is scored once; columns of padding score nothing.
    """

    def __init__(self, ids: np.ndarray, base: np.ndarray, cut: np.ndarray, bos: int = VOCAB):
        """Text i holds ids and base from cut[i] to cut[i + 1]."""
        n = np.diff(cut)
        columns = -(-n // STRIDE) + 1
        at = np.arange(len(ids)) + np.repeat((np.cumsum(columns) - columns + 1) * STRIDE - cut[:-1], n)
        self.shape, column = (STRIDE, int(columns.sum())), at // STRIDE
        self.place = (at - column * STRIDE) * self.shape[1] + column  # of each subword in the flattened panel
        self.prev, self.ids, self.base = np.full(self.shape, bos, dtype=np.intp), np.full(self.shape, PAD, dtype=np.int32), np.ones(self.shape, dtype=np.float32)
        prev = np.concatenate([ids[:1], ids[:-1]])
        prev[cut[:-1][n > 0]] = bos
        self.prev.ravel()[self.place], self.ids.ravel()[self.place], self.base.ravel()[self.place] = prev, ids, base

    def parts(self, most: int = 4096) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Columns, and their windows as turned() gives them."""
        for a in range(1, self.shape[1], most):
            b = min(a + most, self.shape[1])
            yield slice(a, b), (*(np.concatenate([x[:, a - 1 : b - 1], x[:, a:b]]) for x in (self.prev, self.ids)), np.ascontiguousarray(self.base[:, a:b]))


def scored(model: Attention, docs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Probability of each subword of each text (ids, base), and the sentinel's weight there."""
    if not docs:
        return []
    ends = np.cumsum([len(i) for i, _ in docs])
    p, z = scored_flat(model, *(np.concatenate(x) for x in zip(*docs)), np.concatenate([[0], ends]))
    return list(zip(np.split(p, ends[:-1]), np.split(z, ends[:-1])))


def scored_flat(model: Attention, ids: np.ndarray, base: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """scored() of texts that lie one after another, from cut[i] to cut[i + 1]."""
    panels = Panels(ids, base, cut)
    p, z = np.zeros(panels.shape, dtype=np.float32), np.zeros(panels.shape, dtype=np.float32)
    for own, part in panels.parts():
        p[:, own], z[:, own], _ = model._forward(*part, WINDOW - STRIDE)
    return p.ravel()[panels.place], z.ravel()[panels.place]


def tokens(text: bytes | None) -> list[bytes]:
    """Words of one text; split_words() gives the same for many."""
    return text.lower().split() if text else []  # at \x20 and \x09-\x0d


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (strings), one text after another, and their number in each."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(text))
    full = pc.fill_null(pc.greater(pc.binary_length(bare), 0), False)
    parts = pc.ascii_split_whitespace(bare.filter(full))
    n = np.zeros(len(text), dtype=np.int64)
    n[full.to_numpy(zero_copy_only=False)] = pc.list_value_length(parts).to_numpy()
    return parts.flatten().cast(pa.binary()), n


def listed(words: pa.Array) -> list[bytes]:
    """Words as Python objects, faster than one by one; they hold no space."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py().split(b" ")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], i: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices: texts, in column i, of 6 * SLICE_WORDS bytes, the last of them whole."""
    for b in batches:
        upto, a = np.cumsum(pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while a < b.num_rows:
            end = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + 6 * SLICE_WORDS)) + 1
            yield b.slice(a, end - a)
            a = end


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (text) -> (word binary, c): occurrences of every word, and of END once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def summed() -> pa.Table:
            return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        for b in slices(batches, 0):
            texts += b.num_rows
            word, c = split_words(b.column(0))[0].value_counts().flatten()
            held.append(pa.RecordBatch.from_arrays([word, c], names=["word", "c"]))
            size += len(word)
            if size > 600_000:  # words are met again in later slices; their sums take their place
                held, size = (t := summed()).to_batches(), t.num_rows
                if size > 300_000:
                    yield from held
                    held, size = [], 0
        if held:
            yield from summed().to_batches()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([texts], pa.int64())], names=["word", "c"])

    return docs.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def spelling_counts(counts: DataFrame, path: str, vocab: int = VOCAB) -> tuple[np.ndarray, np.ndarray]:
    """Subword successions in the vocabulary, each word once: by bucket of two before, and by one before.

    The tables have fixed size (BUCKETS and vocab squared); tasks send sums, merged in Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, keys = Spelling(path, vocab), [np.zeros(0, dtype=np.int64)]
        for b in batches:
            words = listed(b.column(0).filter(pc.not_equal(b.column(0), pa.scalar(END, pa.binary()))))
            if words:
                flat, ends = spell.many(words)
                one, two = before(flat, ends)
                k = np.concatenate([context(two, one) << 12 | flat, (BUCKETS + one + 1) << 12 | flat])
                keys.append(k)
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

    rows = counts.select("word").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = rows["k"].to_numpy(), rows["n"].to_numpy()
    two, one = np.zeros((BUCKETS, vocab + 1)), np.zeros((vocab + 1, vocab + 1))
    b, s = k >> 12, k & 4095
    lo = b < BUCKETS
    two[b[lo], s[lo]] = n[lo]
    one[b[~lo] - BUCKETS - 1, s[~lo]] = n[~lo]  # row -1, the last, is the word's start
    return two, one


def most_frequent(counts: DataFrame, head: int) -> dict[bytes, int]:
    """Counts of the ``head`` most frequent words, equal counts by word.

    Classes of counts, at most 64 * 63, tell where the head ends; only its words, and in one task only those of the
    class at its edge, are moved, however many there are.
    """
    level = F.floor(F.log2("c") * 64)
    left, whole, edge = head, None, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["level"]):
        if r["n"] > left:
            edge = r["level"]
            break
        left, whole = left - r["n"], r["level"]
    parts = [counts.filter(level >= whole)] if whole is not None else []
    if edge is not None and left:
        parts.append(counts.filter(level == edge).orderBy(F.desc("c"), "word").limit(left))
    got = [p.select("word", "c").toArrow() for p in parts]
    return {w: c for t in got for w, c in zip(t["word"].to_pylist(), t["c"].to_pylist())}


def fit(train_docs: DataFrame, speller, path: str, steps: int = STEPS) -> np.ndarray:
    """Attention parameters after one Adam step for each hash bucket of the training documents."""
    model = Attention()
    size = len(model.flat)

    def gradient(step: int) -> np.ndarray:
        params = model.flat.copy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, sums = words_of(path, speller.value), Sums(Attention(params))
            for b in slices(batches, 0):
                flat, n = split_words(b.column(0))
                if not len(flat):
                    continue
                own = flat.dictionary_encode()
                ids, base, ends = words.gather(words.types(listed(own.dictionary))[own.indices.to_numpy()])
                cut = np.concatenate([[0], ends[np.cumsum(n[n > 0]) - 1]])
                for _, part in Panels(ids, base, cut).parts():
                    sums.add_turned(*part, WINDOW - STRIDE)
            if sums.n:
                total = sums.gradient()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), sums.n, dtype=np.int64))], names=["i", "x", "n"])

        own = train_docs.filter(F.pmod(F.xxhash64("text"), F.lit(steps)) == step).select("text")
        got = own.mapInArrow(run, "i bigint, x double, n bigint").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
        g = np.zeros(size)
        g[got["i"].to_numpy()] = got["x"].to_numpy()
        return np.round(g, 7)  # sums in another order differ far below

    return adam(model.flat, (gradient(t) for t in range(steps)))


def score(docs: DataFrame, path: str | None = None, head: int = HEAD) -> DataFrame:
    """docs (doc_id, text) -> the contract's columns."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    docs = docs.select("doc_id", "text")
    train_docs = docs.filter(~held_out())
    counts = scratch.table(word_counts(train_docs.select("text")), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(counts, head)
    speller = spark.sparkContext.broadcast(Speller(*spelling_counts(counts, path), VOCAB))
    params = fit(train_docs, speller, path)
    known = spark.sparkContext.broadcast(top)  # at most `head` words
    unseen, low = math.log10(0.1 / (n + 0.1 * (v + 1))), n + 0.1 * (v + 1)
    p_end = (top.get(END, 0) + 0.5) / (n + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        words, model = words_of(path, speller.value).counted(known.value), Attention(params)
        names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp", "word", "psub", "gate"]
        types = [pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.float64(), pa.float64()]
        c_end = known.value.get(END, 0)
        end = (1, int(c_end > 0), math.log10((c_end + 0.1) / low), math.log10((1 - LEAST) * (c_end + 0.1) / low + LEAST * p_end))

        def rows(cols: list) -> pa.RecordBatch:
            m = len(cols[0])
            return pa.RecordBatch.from_arrays([pa.nulls(m, t or kind) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, types)], names=names)

        def emit(ids: pa.Array, held: pa.Array, text: pa.Array, first: int) -> Iterator[pa.RecordBatch]:
            flat, n = split_words(text)
            flat = flat.dictionary_encode()
            own = words.types(listed(flat.dictionary))[flat.indices.to_numpy()]
            doc = np.repeat(np.arange(len(n)), n)
            sub_ids, sub_p, ends = words.gather(own)
            last = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]  # subwords up to each text's end
            c, spelled, gate = words.count[own], np.zeros(0), np.zeros(0)
            if len(flat):
                p, z = scored_flat(model, sub_ids, sub_p, last)
                begin = np.concatenate([[0], ends[:-1]])
                spelled = 10 ** (np.add.reduceat(np.log10(np.maximum(p, 1e-30)), begin) + words.go[own]) * (1 - p_end)
                gate = np.clip(MOST * (1.0 - z[begin].astype(np.float64)) ** 2, LEAST, MOST)
            h = c > 0
            per = lambda x: np.bincount(doc[h], x, minlength=len(n))
            yield rows([np.arange(first, first + len(n)), ids, held, n + end[0], per(np.ones(int(h.sum()))).astype(np.int64) + end[1], per(np.log10((c[h] + 0.1) / low)) + end[2], per(np.log10((1 - gate[h]) * (c[h] + 0.1) / low + gate[h] * spelled[h])) + end[3], None, None, None])
            rare = np.flatnonzero(~h)
            if len(rare):
                yield rows([first + doc[rare], None, None, None, None, None, None, flat.take(pa.array(rare)).dictionary_decode(), (gate * spelled)[rare], gate[rare]])

        for part in slices(batches, 2):
            kind = part.column(0).type
            yield from emit(part.column(0), part.column(1), part.column(2), rid)
            rid += part.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("h"), "text").mapInArrow(run, f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, lp double, word binary, psub double, gate double")
    rows = scratch.table(rows, "scores")
    tail = rows.filter(F.col("word").isNotNull()).select("rid", "word", "psub", "gate")
    c = F.coalesce(F.col("c"), F.lit(0))
    part = tail.join(counts, "word", "left").select("rid", (c > 0).cast("bigint").alias("k"), F.when(c > 0, F.log10((c + 0.1) / F.lit(low))).otherwise(F.lit(unseen)).alias("b"), F.log10((1 - F.col("gate")) * (c + 0.1) / F.lit(low) + F.col("psub")).alias("s"))
    part = part.groupBy("rid").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    d = rows.filter(F.col("word").isNull()).drop("word", "psub", "gate").join(part, "rid", "left")
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return d.select("doc_id", "held_out", "n_tokens", add("n_known", "k").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), add("base", "b").alias("base_score"), add("lp", "s").alias("score"))


def op5_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents."""
    return score(scratch.docs_of(spark, sf_dir))
