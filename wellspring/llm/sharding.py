"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) in falling order of size each enter the fullest bin that still holds them, found
in a balanced search tree of remaining capacities; a bin is opened only when none fits. For a fixed
number of shards the smallest capacity that packs into them is searched.

The packing is exact over all groups, but the driver sees only (size, number of groups) classes: equal groups
are interchangeable, and as many of a class as fit go into a bin at once, since a bin stays the tightest
while it holds another. Classes of different sizes that total B bytes are at most sqrt(2 B), 16 bytes each:
225 MB for 100 TB. The answer is a list of runs (size, rank within the class, bin), at most one per class
and filled bin; each group finds its run by its rank, counted in Spark. A group larger than a shard's
fair share is still one item and sets the capacity by itself.

Defined results: a null text is a group of its own of size 1; empty texts are one group; very long texts are groups
like any other; ties between equal groups fall by hash; repeated rows keep their rows and take a slot each; an empty
table gives an empty result; ``pack`` keeps extra columns, but for those named shard or slot, which its own replace.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

SHARDS, RANKS = 16, 1024
MAP_ROWS = 1_000_000


class Capacities:
    """A treap of (remaining capacity, bin) with best-fit search; priorities are hashed, so runs agree."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        x = (key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)
        return (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & (2**64 - 1)

    def insert(self, key: tuple[int, int]) -> None:
        small, large = self._split(self.root, key)
        self.root = self._join(self._join(small, [key, self._priority(key), None, None]), large)

    def remove(self, key: tuple[int, int]) -> None:
        small, rest = self._split(self.root, key)
        _, large = self._split(rest, (key[0], key[1] + 1))
        self.root = self._join(small, large)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least key with remaining capacity of at least ``size``."""
        node, best = self.root, None
        while node:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            return [node[0], node[1], node[2], a], b
        a, b = self._split(node[2], key)
        return a, [node[0], node[1], b, node[3]]

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._join(a[3], b)]
        return [b[0], b[1], self._join(a, b[2]), b[3]]


def best_fit_classes(sizes: list[int], counts: list[int], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Runs (class, groups, bin) of best-fit decreasing over sizes in falling order, bins numbered as opened.

    None if more than ``most`` bins would be needed.
    """
    tree, bins, out = Capacities(), 0, []
    for c, (size, left) in enumerate(zip(sizes, counts)):
        while left:
            fit = tree.tightest(size)
            if fit is None:
                if bins == most:
                    return None
                fit, bins = (max(capacity, size), bins), bins + 1
            else:
                tree.remove(fit)
            n = min(left, fit[0] // size)
            out.append((c, n, fit[1]))
            left -= n
            tree.insert((fit[0] - n * size, fit[1]))
    return out


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size by best_fit_classes; equal sizes in their given order."""
    count = Counter(sizes)
    own = sorted(count, reverse=True)
    runs = best_fit_classes(own, [count[x] for x in own], capacity, most)
    if runs is None:
        return None
    order, out, at = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), [0] * len(sizes), 0
    for _, n, b in runs:
        for i in order[at : at + n]:
            out[i] = b
        at += n
    return out


def pack_classes(sizes: list[int], counts: list[int], shards: int) -> list[tuple[int, int, int]]:
    """best_fit_classes at the smallest capacity (to 1/65536 of a fair share) that needs at most ``shards`` bins."""
    if not sizes:
        return []
    total = sum(s * n for s, n in zip(sizes, counts))
    low = max(sizes[0], -(-total // shards))
    step = max(1, total // shards >> 16)
    if (out := best_fit_classes(sizes, counts, low, shards)) is not None:
        return out
    fail, good = low, low
    while (out := best_fit_classes(sizes, counts, good, shards)) is None:
        fail, good = good, good + max(step, good // 64)
    while good - fail > step:
        mid = (fail + good) // 2
        new = best_fit_classes(sizes, counts, mid, shards)
        fail, good, out = (mid, good, out) if new is None else (fail, mid, new)
    return out


def group_shards(groups: DataFrame, shards: int | None, capacity: int | None = None) -> DataFrame:
    """groups (group, bytes), stable when read twice -> (group, shard)."""
    spark = groups.sparkSession
    classes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bytes")).toArrow()
    sizes, counts = classes["bytes"].to_pylist(), classes["n"].to_pylist()
    runs = pack_classes(sizes, counts, shards) if shards else best_fit_classes(sizes, counts, capacity)
    c, n, bins = (np.array([r[i] for r in runs], dtype=np.int64) for i in range(3))
    first = np.cumsum(n) - n
    first -= first[np.searchsorted(c, c)]  # rank of the run's first group within its class; runs lie in order of class
    table = pa.table({"_bytes": pa.array(np.array(sizes, dtype=np.int64)[c]), "_lo": pa.array(first), "_hi": pa.array(first + n - 1), "shard": pa.array(bins.astype(np.int32)), "_whole": pa.array(n == np.array(counts, dtype=np.int64)[c])})
    plan = scratch.table(spark.createDataFrame(table), "runs")
    whole = plan.filter("_whole").select("_bytes", "shard")
    split = plan.filter("NOT _whole")
    one = groups.join(scratch.small(whole), F.col("bytes") == F.col("_bytes")).select("group", "shard")
    some = groups.join(scratch.small(split.select("_bytes").distinct()), F.col("bytes") == F.col("_bytes"), "left_semi")
    ranked = scratch.ranked(scratch.table(some, "split"), "bytes", "group", ["group"], "_rank", max(4, -(-sum(counts) // 200_000)))
    cells = split.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / RANKS), F.floor(F.col("_hi") / RANKS))))
    near = (F.col("bytes") == F.col("_bytes")) & (F.floor(F.col("_rank") / RANKS) == F.col("_cell"))
    rest = ranked.join(scratch.small(cells), near & F.col("_rank").between(F.col("_lo"), F.col("_hi"))).select("group", "shard")
    return one.unionByName(rest)


def assign(base: DataFrame, shards: int | None, capacity: int | None = None) -> DataFrame:
    """base (group bigint, size bigint, ...) -> with shard. base is stable when read twice."""
    groups = scratch.table(base.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    where = scratch.table(group_shards(groups, shards, capacity), "where").withColumnRenamed("group", "_g")
    return base.join(scratch.small(where, MAP_ROWS), F.col("group") == F.col("_g")).drop("_g")


def group_of(text):
    """One key per distinct text; null apart from empty."""
    return F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(text))


def _base(docs: DataFrame, doc_col: str, text_col: str, carry: list[str]) -> DataFrame:
    t = F.col(f"`{text_col}`")
    return scratch.table(docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.col(f"`{doc_col}`").alias("_doc"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint").alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), group_of(t).alias("group")), "shard")


def pack(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """docs with ``shard`` and ``slot`` (gapless within the shard) after their own columns.

    Give ``shards`` for near-equal sizes in that many shards, or ``shards=None`` and ``capacity`` in
    bytes for as few shards of that capacity as best fit needs.
    """
    cols = [c for c in docs.columns if c not in ("shard", "slot")]
    out = _placed(_base(docs, doc_col, text_col, cols), shards, capacity)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)], "shard", "slot")


def _placed(base: DataFrame, shards: int | None, capacity: int | None = None) -> DataFrame:
    placed = assign(base, shards, capacity).withColumn("_spread", F.xxhash64("_doc", "size", "text_crc32"))
    buckets = max(4, -(-base.count() // 20_000))
    return scratch.ranked(placed, "shard", "_spread", ["_doc", "size", "text_crc32"], "slot", buckets)


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over whole documents, under the law ``bytes``."""
    out = _placed(_base(scratch.docs_of(spark, sf_dir), "doc_id", "text", []), SHARDS)
    return out.select(F.col("_doc").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
