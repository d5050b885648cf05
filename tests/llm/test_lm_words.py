"""Words of many texts at once: those of each text, each different one looked up, spelled and sent once."""

import numpy as np
import pyarrow as pa

from wellspring.llm import lm

TEXTS = ["  Red\tgreen\x0b\x0cblue\r\nRED ", "", None, " \n ", "één ÉÉN\x1cx\x85y z", "x", "A" * 70 + " b", "red " * 300]


def test_words_are_those_of_each_text():
    for kind in (pa.string(), pa.large_string()):
        for texts in (TEXTS, [], ["", None, " "]):
            flat, n = lm.split_words(pa.array(texts, kind))
            want = [lm.tokens(t.encode() if t is not None else None) for t in texts]
            assert flat.type == pa.binary() and n.tolist() == [len(w) for w in want]
            assert flat.to_pylist() == [x for w in want for x in w]
            assert lm.listed(flat) == flat.to_pylist()
    raw = pa.array([b"\xffA \xc3", b"b"], pa.binary())
    flat, n = lm.split_words(pa.Array.from_buffers(pa.string(), 2, raw.buffers()))
    assert flat.to_pylist() == [b"\xffa", b"\xc3", b"b"] and n.tolist() == [2, 1]


def test_slices_keep_every_row_and_whole_texts():
    texts = ["x" * 700_000, None, "y" * 3_000_000, "", "z", "x" * 700_000, "x" * 700_000]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], names=["text"]) for t in (texts, [], texts[::-1])]
    got = [b.column(0).to_pylist() for b in lm.slices(iter(batches), 0)]
    assert [x for b in got for x in b] == texts + texts[::-1]
    assert len(got) > 4 and all(sum(len(x or "") for x in b[:-1]) <= 6 * lm.SLICE_WORDS for b in got)


def test_counts_are_those_of_plain_loops_over_merged_slices(spark):
    texts = [" ".join(f"W{(i * 131 + j * j) % 90_000 if j % 3 else j % 7}" for j in range(400)) for i in range(900)] + [None, "", " "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    want: dict[bytes, int] = {lm.END: len(texts)}
    for t in texts:
        for w in lm.tokens(t and t.encode()):
            want[w] = want.get(w, 0) + 1
    got = lm.word_counts(docs).collect()
    assert len(got) == len(want) and {bytes(r["word"]): r["c"] for r in got} == want
    assert lm.word_counts(docs.limit(0)).count() == 0


def test_a_slice_looks_up_each_different_word_once(spark, monkeypatch):
    """A text that says one word over and over asked for it at each occurrence before."""
    docs = spark.createDataFrame([(1, "red green " * 500), (10, "blue " * 500)], "doc_id bigint, text string").coalesce(1)
    counts, path = lm.word_counts(docs.select("text")), lm.tokenizer_path()
    speller = lm.Speller(*lm.spelling_counts(counts, path), lm.VOCAB)
    seen = []
    monkeypatch.setattr(lm, "words_of", lambda path, speller: Asked(lm.Words(lm.Spelling(path), speller), seen))
    run = task(monkeypatch, lambda: lm.fit(docs, Held(speller), path, steps=1))
    list(run(iter([pa.RecordBatch.from_arrays([pa.array(["red green " * 500, None, "blue " * 500])], names=["text"])])))
    assert [sorted(w) for w in seen] == [[b"blue", b"green", b"red"]]


class Held:
    def __init__(self, value):
        self.value = value


class Asked:
    """Words that note what they were asked for."""

    def __init__(self, words, seen):
        self.words, self.seen = words, seen

    def types(self, words):
        self.seen.append(list(words))
        return self.words.types(words)

    def __getattr__(self, name):
        return getattr(self.words, name)


def task(monkeypatch, call):
    """The function that call() would hand to the first mapInArrow."""
    from pyspark.sql.classic.dataframe import DataFrame

    class Got(Exception):
        pass

    def stop(self, run, *a, **b):
        raise Got(run)

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "mapInArrow", stop)
        try:
            call()
        except Got as e:
            return e.args[0]


def test_held_words_outgrow_their_arrays():
    path, rng = lm.tokenizer_path(), np.random.default_rng(3)
    speller = lm.Speller(rng.integers(0, 9, (lm.BUCKETS, lm.VOCAB + 1)), rng.integers(0, 9, (lm.VOCAB + 1, lm.VOCAB + 1)), lm.VOCAB)
    vocabulary = [f"word{i}é{i * 7 % 13}".encode() for i in range(500)]
    whole, grown = lm.Words(lm.Spelling(path), speller, {vocabulary[3]: 8}), lm.Words(lm.Spelling(path), speller, {vocabulary[3]: 8})
    want = whole.gather(whole.types(vocabulary))
    for a in range(0, 500, 37):
        grown.types(vocabulary[: a + 37])
    got = grown.gather(grown.types(vocabulary))
    assert all(np.array_equal(x, y) for x, y in zip(got, want))
    t = grown.types(vocabulary)
    assert np.array_equal(grown.go[t], whole.go[t]) and grown.count[t].sum() == 8 == grown.count[t][3]


def test_words_met_often_stay_when_others_are_forgotten():
    path = lm.tokenizer_path()
    speller = lm.Speller(np.ones((lm.BUCKETS, lm.VOCAB + 1)), np.ones((lm.VOCAB + 1, lm.VOCAB + 1)), lm.VOCAB)
    words, whole, asked = lm.Words(lm.Spelling(path), speller, {b"red": 4}, most=10), lm.Words(lm.Spelling(path), speller, {b"red": 4}), []
    many = words.spelling.many
    words.spelling.many = lambda new: asked.extend(new) or many(new)
    for i in range(12):
        call = [f"new{i}-{j}".encode() for j in range(4)] + [b"red", b"green"]
        t, u = words.types(call), whole.types(call)
        assert all(np.array_equal(x, y) for x, y in zip(words.gather(t), whole.gather(u)))
        assert np.array_equal(words.go[t], whole.go[u]) and words.count[t].tolist() == [0, 0, 0, 0, 4, 0]
        assert len(words.number) <= 16
    assert asked.count(b"red") == asked.count(b"green") == 1


def test_head_is_the_most_frequent_words(spark):
    rows = [(f"w{i:03}".encode(), 1 + i * i * i // 4000 % 500) for i in range(300)] + [(b"top", 10**12), (b"next", 10**12 - 1)]
    counts = spark.createDataFrame(rows, "word binary, c bigint").repartition(5)
    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    for head in (0, 1, 2, 3, 57, 250, 302, 1000):
        assert lm.most_frequent(counts, head) == dict(ranked[:head]), head
    assert lm.most_frequent(counts.limit(0), 5) == {}
