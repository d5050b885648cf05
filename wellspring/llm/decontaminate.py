"""Benchmark decontamination with suffix arrays over shards of the training text.

Every shard (a bounded slice of whole documents in one task) is turned into word ids of the
benchmark's vocabulary, a suffix array is built over it, and every suffix of every benchmark item is
binary-searched there. A suffix that cannot match for ``min_words`` words (its first words form no
benchmark gram) is left out of the array: this is lossless, as only matches of whole windows count.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no
windows; repeated documents are judged one by one, repeated items each count by their own id; empty
tables give empty or all-clean results; an item of null id hits words but is neither counted nor listed; of equally long matches the one
found first, by item position and then document position, is reported; very long texts are searched whole; extra columns pass through
``decontaminate`` untouched whatever their names, and in ``report`` its own columns replace kept ones of their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 16_000_000
GRAM = 3


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words; bytes.lower changes ASCII only."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Queries:
    """A block of benchmark items: vocabulary, windows as id rows, and the items that hold each window."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.item_ids = [i for i, _ in items]
        texts = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(t)] for _, t in items]
        self.texts = [np.array(t, dtype=np.int32) for t in texts]
        owners: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, t in enumerate(texts):
            n = min(window, len(t))
            for i in range(len(t) - n + 1 if n else 0):
                owners.setdefault(tuple(t[i : i + n]), []).append((k, i))
        self.windows: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
        for n in sorted({len(w) for w in owners}):
            own = sorted((w, o) for w, o in owners.items() if len(w) == n)
            self.windows[n] = (np.array([w for w, _ in own], dtype=np.int32), [o for _, o in own])

    def has_windows(self) -> bool:
        return bool(self.windows)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of ids as byte strings whose order is the rows' lexicographic order."""
    be = np.ascontiguousarray(rows.astype(">i4"))
    return be.view(f"S{4 * rows.shape[1]}").ravel()


def _grams(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class SuffixArray:
    """Suffixes of ``ids`` (0 ends every document) that begin with one of the wanted grams, in order of their first ``depth`` ids."""

    def __init__(self, ids: np.ndarray, depth: int, wanted: np.ndarray):
        self.depth = depth
        self.ids = np.concatenate([ids, np.zeros(depth, dtype=np.int32)])
        g = min(GRAM, depth)
        pos = np.flatnonzero(ids)
        for k in range(1, depth):  # a suffix with an end or unknown word within depth matches no window
            pos = pos[self.ids[pos + k] != 0]
            if k == g - 1 or g == 1:
                heads = _grams(np.stack([self.ids[pos + j] for j in range(g)], axis=1)) if len(pos) else np.zeros(0, np.uint64)
                pos = pos[np.isin(heads, wanted)]
                g = -1
        if g == 1 and len(pos):
            pos = pos[np.isin(_grams(self.ids[pos][:, None]), wanted)]
        keys = _keys(np.stack([self.ids[pos + k] for k in range(depth)], axis=1)) if len(pos) else np.zeros(0, dtype=f"S{4 * depth}")
        order = np.argsort(keys, kind="stable")
        self.sa, self.keys = pos[order], keys[order]

    def ranges(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of each window: the slice of the array that starts with it."""
        k = _keys(windows)
        return np.searchsorted(self.keys, k, "left"), np.searchsorted(self.keys, k, "right")


def search(q: Queries, docs: list[list[bytes]]) -> list[tuple[np.ndarray, dict[int, tuple[int, int, int]]]]:
    """For each document the mask of hit words, and per item its longest match (words, item position, document position)."""
    out = [(np.zeros(len(d), dtype=bool), {}) for d in docs]
    if not q.has_windows() or not docs:
        return out
    get = q.vocab.get
    lens = np.array([len(d) + 1 for d in docs])
    base = np.concatenate([[0], np.cumsum(lens)])
    ids = np.zeros(base[-1], dtype=np.int32)
    for d, b in zip(docs, base):
        if d:
            ids[b : b + len(d)] = np.fromiter((get(w, 0) for w in d), dtype=np.int32, count=len(d))
    for n, (windows, owners) in q.windows.items():
        wanted = np.unique(_grams(windows[:, : min(GRAM, n)]))
        sa = SuffixArray(ids, n, wanted)
        if not len(sa.sa):
            continue
        lo, hi = sa.ranges(windows)
        for w in np.flatnonzero(hi > lo):
            for p in sa.sa[lo[w] : hi[w]]:
                d = int(np.searchsorted(base, p, "right")) - 1
                at = int(p - base[d])
                mask, best = out[d]
                mask[at : at + n] = True
                for item, i in owners[w]:
                    if item in best and best[item][0] >= len(q.texts[item]):
                        continue
                    t = q.texts[item]
                    have = best.get(item)
                    if have and have[1] <= i and i + n <= have[1] + have[0] and at - i == have[2] - have[1]:
                        continue  # inside the match already known
                    m = n
                    while i + m < len(t) and ids[p + m] == t[i + m]:
                        m += 1
                    if not have or m > have[0]:
                        best[item] = (m, i, at)
    return out


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[Queries]:
    """The stated query set in blocks of bounded bytes, one at a time on the driver."""
    now, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        now.append((r["i"], r["t"]))
        size += len(r["t"] or "")
        if size >= block_bytes:
            yield Queries(now, window)
            now, size = [], 0
    if now:
        yield Queries(now, window)


REPORT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, matches array<struct<item_id:string,words:bigint,item_at:bigint,doc_at:bigint>>"


def report(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document the columns ``keep`` and REPORT; ``matches`` has each item's longest verbatim match and its places.

    One scan of docs, no shuffle. Benchmark blocks are broadcast one by one, each at most about
    ``block_bytes`` of text, and a task holds one block and one shard at a time.
    """
    spark = docs.sparkSession
    keep = [c for c in keep if c not in scratch.schema(REPORT).names]
    parts = [spark.sparkContext.broadcast(b) for b in blocks_of(benchmark, item_col, bench_text, block_bytes, window)]
    fields = [docs.schema[c] for c in keep] + list(scratch.schema(REPORT).fields)
    out_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def shard(texts: list[str | None]) -> list[tuple]:
        docs_ = [words_of(t) for t in texts]
        masks = [np.zeros(len(d), dtype=bool) for d in docs_]
        found: list[dict] = [{} for _ in docs_]
        for b in parts:
            q = b.value
            for k, (mask, best) in enumerate(search(q, docs_)):
                if best:
                    masks[k] |= mask
                    for item, m in best.items():
                        if q.item_ids[item] is None:
                            continue
                        i = str(q.item_ids[item])
                        found[k][i] = max(found[k].get(i, (0, 0, 0)), m)
            if len(parts) > 1:
                b.__dict__.pop("_value", None)  # one block at a time; read again from its local file for the next shard
        rows = []
        for d, mask, hit in zip(docs_, masks, found):
            n, items = int(mask.sum()), sorted(hit, key=str.encode)
            matches = [{"item_id": i, "words": int(hit[i][0]), "item_at": int(hit[i][1]), "doc_at": int(hit[i][2])} for i in items]
            rows.append((len(d), n, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n > 0, matches))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        for batch in batches:
            text, n, start = batch.column(len(keep)), batch.num_rows, 0
            while start < n:
                stop, size = start, 0
                while stop < n and (stop == start or size < 6 * shard_words):  # some six bytes a word
                    v = text[stop].as_py()
                    size += len(v) if v else 0
                    stop += 1
                rows = shard(text.slice(start, stop - start).to_pylist())
                cols = [batch.column(i).slice(start, stop - start).cast(arrow.field(i).type) for i in range(len(keep))]
                cols += [pa.array([r[k] for r in rows], type=arrow.field(len(keep) + k).type) for k in range(6)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
                start = stop

    return docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, out_schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """docs without the documents that hold a benchmark window; columns unchanged."""
    cols = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)])
    out = report(own, benchmark, own.columns, text_col=f"_c{cols.index(text_col)}", **kw)
    return out.filter(~F.col("contaminated")).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``report`` over whole documents and benchmark."""
    docs = scratch.docs_of(spark, sf_dir)
    bench = scratch.docs_of(spark, sf_dir, "benchmark")
    return report(docs, bench, ["doc_id"]).drop("matches")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
it AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM it GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
