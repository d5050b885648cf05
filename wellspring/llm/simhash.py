"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments (packed in one bigint).
The Manhattan distance of two such vectors never exceeds the fingerprints' Hamming distance, so pairs
within ``bits`` lie within that Manhattan range. The grid: segments are dealt to B blocks; vectors
within range r differ in at most r blocks, so they agree on B - r of them, and every choice of B - r
blocks is one grid key. Rows that meet in a cell pass the Manhattan bound, then the exact check.

Only distinct fingerprints are joined. A cell emits a spanning forest of its links, found by searching
outward from a member among the members not yet reached, never all its pairs; B grows with the
number of fingerprints, so cells stay small on spread-out data. Links then go through components().

Defined results: null or wordless texts have fingerprint 0 and link like any other; fewer words than a
shingle make one shingle of all words; repeated rows share a component; a null doc_id is grouped but
never names a component unless all are null; an empty table gives an empty result; extra columns are
kept by ``dedup``, which keeps of each component its row of least doc_id (nulls last, then text).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import graph, scratch

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SHINGLE, BITS, SEED = 4, 4, 42
SLICE_BYTES = 4_000_000


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: a bit is 1 if set in over half the XXH64 hashes of its shingles."""
    out = np.zeros(len(texts), dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for k, t in enumerate(texts):
        words = WORD.findall(t.lower()) if t else []
        if not words:
            continue
        n = len(words) - shingle + 1
        if n <= 1:
            out[k] = digest(b" ".join(words), SEED)
            continue
        line = b" ".join(words)
        ends = list(itertools.accumulate([len(w) + 1 for w in words]))
        starts = [0] + ends[:n - 1]
        h = np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])), dtype=np.uint64, count=n)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, n, 1 << 16):
            part = h[i : i + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits((ones * 2 > n), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprint(docs: DataFrame, keep: list[Column], text: Column, shingle: int = SHINGLE) -> DataFrame:
    """keep columns and ``fp`` (bigint holding the 64 bits). One scan, no shuffle."""
    sel = docs.select(*keep, text.alias("_text"))
    n = len(keep)
    out_schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in sel.schema.fields[:n]] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_schema)
        for b in batches:
            texts = b.column(n).cast(pa.large_binary())
            fps = [fingerprints(texts.slice(i, 500).to_pylist(), shingle) for i in range(0, b.num_rows, 500)]
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(i).cast(arrow.field(i).type) for i in range(n)] + [pa.array(fp.view(np.int64))], schema=arrow)

    return sel.mapInArrow(run, out_schema)


def blocks_for(n: int, bits: int) -> int:
    """The fewest blocks whose cells expect at most 1/4 other member of n spread-out fingerprints.

    A two-bit segment's count carries 1.5 bits of entropy; a key covers (B - bits) / B of 32 segments.
    """
    for b in range(bits + 2, bits + 6):
        if n <= 0.25 * 2 ** (48 * (b - bits) / b):
            return b
    return bits + 6


def embed(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, two bits each in one bigint."""
    half, next_ = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(next_).bitwiseAND(half).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_).bitwiseAND(half), 1))


def masks(blocks: int, bits: int) -> list[int]:
    """One mask of whole segments for every choice of blocks - bits blocks, as signed 64-bit integers."""
    seg = [sum(3 << 2 * s for s in range(32) if s * blocks // 32 == b) for b in range(blocks)]
    out = [sum(seg[b] for b in c) for c in itertools.combinations(range(blocks), blocks - bits)]
    return [m - 2**64 if m >= 2**63 else m for m in out]


def popcounts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Spanning links among fps (uint64) within ``bits``: search outward among members not yet reached."""
    links: list[tuple[int, int]] = []
    half, ones = np.uint64(0x5555555555555555), np.uint64(1)
    vec = (fps & half) + ((fps >> ones) & half)
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            # Manhattan distance of two-bit counts 0..2 is at least the distance of their sums; the exact check follows
            d = (vec[left] & np.uint64(0x3333333333333333)) + ((vec[left] >> np.uint64(2)) & np.uint64(0x3333333333333333))
            e = (vec[i] & np.uint64(0x3333333333333333)) + ((vec[i] >> np.uint64(2)) & np.uint64(0x3333333333333333))
            low = np.abs(_bytes(d) - _bytes(np.array([e]))).sum(axis=1) <= bits
            near = np.zeros(len(left), dtype=bool)
            near[low] = popcounts(fps[left[low]] ^ fps[i]) <= bits
            for j in left[near]:
                links.append((i, j))
            queue.extend(left[near])
            left = left[~near]
    return links


def _bytes(d: np.ndarray) -> np.ndarray:
    """Counts of the sixteen four-bit segments as signed bytes."""
    b = np.ascontiguousarray(d).view(np.uint8).reshape(len(d), 8)
    return np.concatenate([b & 15, b >> 4], axis=1).astype(np.int8)


def links(reps: DataFrame, bits: int = BITS, blocks: int | None = None) -> DataFrame:
    """Distinct fp (bigint) -> links (a, b) whose components are those of all pairs within ``bits``."""
    b = blocks or blocks_for(reps.count(), bits)
    vec = embed(F.col("fp"))
    keys = reps.select("fp", F.posexplode(F.array(*[vec.bitwiseAND(F.lit(m)) for m in masks(b, bits)])).alias("k", "cell"))
    dealt = keys.repartition(F.col("k"), F.col("cell")).sortWithinPartitions("k", "cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold: list[np.ndarray] = []  # the rows of the cell that the last batch ended in

        def cells(block: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((block[1:, 0] != block[:-1, 0]) | (block[1:, 1] != block[:-1, 1])) + 1
            edge = np.concatenate([[0], new, [len(block)]])
            size = np.diff(edge)
            fp = np.ascontiguousarray(block[:, 2]).view(np.uint64)
            a, z = [], []
            two = edge[:-1][size == 2]
            if len(two):  # the common case at once
                ok = two[popcounts(fp[two] ^ fp[two + 1]) <= bits]
                a.append(fp[ok]), z.append(fp[ok + 1])
            for s, m in zip(edge[:-1][size > 2], size[size > 2]):
                own = fp[s : s + m]
                got = np.array(forest(own, bits), dtype=np.int64).reshape(-1, 2)
                a.append(own[got[:, 0]]), z.append(own[got[:, 1]])
            cat = lambda x: pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64))
            return pa.RecordBatch.from_arrays([cat(a), cat(z)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)], axis=1)
            last = int(np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))[-1]) + 1 if (rows[0, :2] != rows[-1, :2]).any() else 0
            if last == 0 and hold and (hold[-1][-1, :2] == rows[0, :2]).all():
                hold.append(rows)
                continue
            if hold:
                rows_in = np.concatenate([*hold, rows[:last]])
            else:
                rows_in = rows[:last]
            hold = [rows[last:]]
            if len(rows_in):
                yield cells(rows_in)
        if hold:
            yield cells(np.concatenate(hold))

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def classes(base: DataFrame, bits: int = BITS, blocks: int | None = None, edges: DataFrame | None = None) -> DataFrame:
    """base (doc_id, fp, ...), stable when read twice -> with component_id; edges (a, b) of fp stand in for links()."""
    reps = scratch.table(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "reps")
    roots = scratch.table(graph.components(links(reps.select("fp"), bits, blocks) if edges is None else edges), "roots")
    near = reps.join(roots, F.col("fp") == F.col("node"))
    ids = near.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = scratch.table(roots.join(ids, "root").select(F.col("node").alias("_fp"), F.col("component_id").alias("_moved")), "ids")
    own = reps.select(F.col("fp").alias("_ofp"), F.col("least").alias("_own"))
    all_ids = scratch.table(own.join(moved, F.col("_ofp") == F.col("_fp"), "left").select("_ofp", F.coalesce("_moved", "_own").alias("component_id")), "classes")
    return base.join(all_ids, F.col("fp") == F.col("_ofp"), "left").drop("_ofp")


def print_pairs(base: DataFrame, bits: int = BITS) -> DataFrame:
    """base (_print, fp, ...) -> pairs (a, b) of unlike fp whose fingerprints _print are equal or linked, one of each fingerprint with the others."""
    own = scratch.table(base.select("_print", "fp").distinct(), "prints")
    least = scratch.table(own.groupBy("_print").agg(F.min("fp").alias("a")), "prints")
    within = own.join(least, "_print").select("a", F.col("fp").alias("b"))
    found = scratch.table(links(least.select(F.col("_print").alias("fp")), bits), "links")
    left = found.join(least.withColumnRenamed("_print", "_left"), found["a"] == F.col("_left")).select(least["a"].alias("x"), found["b"].alias("_right"))
    across = left.join(least, F.col("_right") == F.col("_print")).select("x", F.col("a").alias("y"))
    return within.union(across).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def dedup(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, jaccard: bool = False) -> DataFrame:
    """docs with one row of every component of near copies; columns unchanged.

    Near copies are texts whose fingerprints link at ``bits`` or fewer differing bits. With ``jaccard`` such a link must pass an exact
    check of five-word Jaccard similarity 0.8, and a set join adds the pairs of that similarity that fingerprints do not tell.
    """
    cols = docs.columns
    keep = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(cols)]
    docs = docs.select(*keep)
    doc, text = f"_c{cols.index(doc_col)}", f"_c{cols.index(text_col)}"
    keys = [F.col(doc).alias("doc_id"), F.xxhash64(text).alias("_h")]
    if jaccard:
        from . import jaccard as sets

        own = with_fingerprint(docs, [*keys, F.col(text)], F.col(text), shingle).withColumnRenamed("fp", "_print")
        base = scratch.table(sets.with_signature(own, [F.col(x) for x in ("doc_id", "_h", "_print")], F.col(text)), "fp")
        c = classes(base, edges=sets.links(base, docs.select(F.col(text).alias("text")), print_pairs(base, bits)))
    else:
        base = scratch.table(with_fingerprint(docs, keys, F.col(text), shingle), "fp")
        c = classes(base, bits)
    # the row that stays: the least doc_id, then the least text hash; equal rows are told apart by a count
    pick = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_h"))
    root = F.struct(F.col("component_id").isNull(), F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")))
    kept = c.groupBy(root.alias("r")).agg(F.min(pick).alias("p")).select(F.col("p.doc_id").alias("_kd"), F.col("p._h").alias("_kh")).distinct()
    kept = scratch.table(kept, "kept")
    hit = docs.join(kept, F.col(doc).eqNullSafe(F.col("_kd")) & (F.xxhash64(text) == F.col("_kh")), "left_semi")
    if base.groupBy("doc_id", "_h").count().filter(F.col("count") > 1).limit(1).count():  # repeated rows: one stays
        one = F.row_number().over(W.partitionBy(doc, F.xxhash64(text)).orderBy(F.lit(1)))
        hit = hit.withColumn("_n", one).filter(F.col("_n") == 1)
    return hit.select(*[F.col(f"_c{i}").alias(x) for i, x in enumerate(cols)])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents."""
    docs = scratch.docs_of(spark, sf_dir)
    base = scratch.table(with_fingerprint(docs, [F.col("doc_id")], F.col("text")), "fp")
    return classes(base).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
