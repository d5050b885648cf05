"""Prefix trie of conversations from the LCP array of the sorted conversations.

A turn is named by 128 bits of the SHA-256 of its role and text, a conversation by the names of its turns in
order, and Spark sorts all conversations by (names, conv_id) over range partitions. Each partition becomes *blocks*
of bounded size, one row each: ids, lengths, words and the LCP (turns shared with the conversation before).

The Cartesian tree over that LCP array is the trie's branching skeleton: a place and its nearest smaller LCPs on both sides
bound one node, equal LCPs in one pair of bounds are one node, and depths between a node's LCP and its parent's are the missing
single-child nodes. All nearest smaller values come in three parallel passes over the blocks: (1) build blocks; the
driver gets their first and last names, for the LCPs at the seams; (2) each block solves what it can with a stack and gives, for each
depth open at its seams, the place of its first smaller LCP with the sums up to it; the driver merges these minima, from
the last block to the first and back, in arrays as long as the shared prefix at each seam; (3) each block finishes its nodes with
what its neighbours handed in. Counts, minima and sums of a node's members are aggregates of its interval of places.

The id lists behind ends_sha256 are hashed where they lie; a list that spans blocks (many equal conversations) is handed on as one
piece of text for each block and hashed in a stream, piece by piece, never held whole.

Defined results: turns of one conversation with equal turn numbers are taken in order of the names of role and text; repeated
rows are repeated turns; a null role or text is empty; rows without conv_id are no conversation and are left out; a conversation without
turns is a member of the root alone; an empty table has no root and gives an empty result; texts of any length cost their name
alone; other columns are ignored, whatever their names. A conversation's names (16 bytes a turn) are held in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

NAME = 16  # bytes of a turn's name
BLOCK_CONVS, BLOCK_TURNS = 50_000, 400_000

BLOCKS = "block bigint, conv array<bigint>, length array<int>, lcp array<int>, words array<int>, first_key binary, last_key binary"
SUMMARY = "block bigint, head array<struct<place:bigint,least:bigint,leaves:bigint,children:bigint,saved:bigint>>, open array<struct<place:bigint,least:bigint,words:bigint>>, copies bigint, last_group bigint"
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, piece bigint"


def conversations_of(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, turns): names and words of the turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    one = turns.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn"), name.alias("name"), words.alias("words")).alias("x"))
    return one.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % group before its own after the h-th; h: crc32(c) % heads."""
    base = convs.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, heads).alias("_head"))
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    none = F.slice("turns", 1, 0)
    both = convs.join(base, c - c % group == F.col("_base"), "left")
    seq = F.concat(F.slice(F.coalesce("_head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return both.select("conv_id", seq.alias("turns"))


def blocks_of(convs: DataFrame) -> DataFrame:
    """(conv_id, turns) -> BLOCKS, in order of block; lcp of a block's first conversation is left to seams()."""
    flat = convs.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("key"), "conv_id", F.transform("turns", lambda t: t["words"]).alias("words"))
    flat = scratch.table(flat, "conversations")  # read twice by the range sort

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        conv, length, lcp, words, first, last = [], [], [], [], b"", b""

        def out() -> pa.RecordBatch:
            row = {"block": (task << 32) + made, "conv": conv, "length": length, "lcp": lcp, "words": words, "first_key": first, "last_key": last}
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

        for batch in batches:
            for key, c, w in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                key = key.as_py()
                if len(conv) >= BLOCK_CONVS or len(words) >= BLOCK_TURNS:
                    yield out()
                    made += 1
                    conv, length, lcp, words = [], [], [], []
                if not conv:
                    first = key
                lcp.append(shared(last, key) if conv else 0)
                conv.append(c)
                length.append(len(w))
                words += w
                last = key
        if conv:
            yield out()

    ordered = flat.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return scratch.table(ordered.mapInArrow(run, BLOCKS), "blocks")


def shared(a: bytes, b: bytes) -> int:
    """How many names two conversations share at their start."""
    low, high = 0, min(len(a), len(b)) // NAME
    while low < high:
        m = (low + high + 1) // 2
        if a[NAME * low : NAME * m] == b[NAME * low : NAME * m]:
            low = m
        else:
            high = m - 1
    return low


class Block:
    """One block's conversations between two seams; ``right`` is the LCP at the seam after it (-1: the end)."""

    def __init__(self, row: dict, left: int, right: int):
        self.conv, self.length, self.right = row["conv"], row["length"], right
        self.lcp = [left, *row["lcp"][1:]]
        self.n = len(self.conv)
        self.at = [0, *accumulate(self.length)]
        self.words = row["words"]
        after = [*self.lcp[1:], right]
        self.leaf = [int(a < k) for a, k in zip(after, self.length)]  # nothing goes on from here and no copy follows
        self.starts = [int(k > a) for a, k in zip(self.lcp, self.length)]  # a child of the node at depth lcp starts here
        self._link()

    def _link(self) -> None:
        """For each place the nearest later smaller LCP, with least id and children over the stretch before it."""
        n, lcp = self.n, self.lcp
        self.next, self.least, self.children = [n] * n, list(self.conv), list(self.starts)
        for k in range(n - 1, -1, -1):
            j, a = k + 1, lcp[k]
            while j < n and lcp[j] >= a:
                self.least[k] = min(self.least[k], self.least[j])
                if lcp[j] == a:
                    self.children[k] += self.children[j]
                j = self.next[j]
            self.next[k] = j

    def nodes(self, offset: int = 0, carry: list[dict] | None = None) -> tuple[list[tuple], list[dict], list[int]]:
        """(nodes, open nodes by depth, suffix sums of what the nodes starting at each place save).

        A node is (place, depth, n_convs, least, children, leaves, saved). Nodes that reach the seam at a depth both
        sides share are finished with carry, or else are returned as open, from depth 0 to right.
        """
        n, lcp = self.n, self.lcp
        leaves = [0] * (n + 1)
        for k in range(n - 1, -1, -1):
            leaves[k] = leaves[k + 1] + self.leaf[k]
        out, open_, save = [], [None] * (self.right + 1), [0] * (n + 1)
        for k in range(n - 1, -1, -1):
            j, least, own = k + 1, self.conv[k], 0
            for d in range(self.length[k], lcp[k], -1):
                children = int(self.length[k] > d)
                while j < n and lcp[j] >= d:
                    least = min(least, self.least[j])
                    if lcp[j] == d:
                        children += self.children[j]
                    j = self.next[j]
                words = self.words[self.at[k] + d - 1] if d else 0
                tail, reach, low, more = leaves[k] - leaves[j], offset + j, least, 0
                if j == n and d <= self.right:
                    if carry is None:
                        open_[d] = {"place": k, "least": least, "words": words}
                        continue
                    c = carry[d]
                    reach, low, tail, children, more = c["place"], min(least, c["least"]), tail + c["leaves"], children + c["children"], c["saved"]
                size = reach - offset - k
                own += (size - 1) * words
                out.append((k, d, size, low, children, tail, save[k + 1] - save[j] + own + more))
            save[k] = save[k + 1] + own
        return out, open_, save

    def summary(self) -> dict:
        """What the neighbours need: sums up to the first LCP below each depth from 0 to the left seam's, and the open nodes."""
        _, open_, save = self.nodes()
        before = [0, *accumulate(self.leaf)]
        head, j, least = [], 0, self.conv[0]
        for d in range(self.lcp[0], -1, -1):
            children = 0
            while j < self.n and self.lcp[j] >= d:
                least = min(least, self.least[j])
                if self.lcp[j] == d:
                    children += self.children[j]
                j = self.next[j]
            head.append({"place": j, "least": least, "leaves": before[j], "children": children, "saved": save[0] - save[j]})
        copies = 0
        while copies < self.n and self.lcp[copies] == self.length[copies] == self.length[0]:
            copies += 1
        group = self.n - 1
        while group and self.lcp[group] == self.length[group] == self.length[group - 1]:
            group -= 1
        # a head that runs through the block leaves out what the open nodes save; merged() adds it
        return {"head": head[::-1], "open": open_, "copies": copies, "last_group": group}


def seams(keys: list[dict]) -> dict[int, tuple[int, int]]:
    """(left, right) LCP of every block from the first and last names of all."""
    lcp = [-1, *(shared(a["last_key"], b["first_key"]) for a, b in zip(keys, keys[1:])), -1]
    return {k["block"]: (lcp[i], lcp[i + 1]) for i, k in enumerate(keys)}


def merged(rows: list[dict], sizes: list[int]) -> list[dict]:
    """From the summaries of all blocks in order: offset, carry from the right, and least ids on the path at the left seam of each."""
    offset = [0, *accumulate(sizes)]
    carry, out = [], [None] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        own, below, done = rows[i]["open"], 0, []
        for d in range(len(own) - 1, -1, -1):
            if own[d] is not None:
                below += (carry[d]["place"] - offset[i] - own[d]["place"] - 1) * own[d]["words"]
                done.append((d, min(own[d]["least"], carry[d]["least"])))
        out[i] = {"offset": offset[i], "carry": carry, "open_least": done}
        here = []
        for d, x in enumerate(rows[i]["head"]):
            x = dict(x)
            if x["place"] == sizes[i]:  # no smaller LCP in this block
                x["saved"] += below
                if d < len(carry):
                    c = carry[d]
                    x = {"place": c["place"], "least": min(x["least"], c["least"]), "leaves": x["leaves"] + c["leaves"], "children": x["children"] + c["children"], "saved": x["saved"] + c["saved"]}
                else:
                    x["place"] = offset[i + 1]
            else:
                x["place"] += offset[i]
            here.append(x)
        carry = here
    path: list[int] = []
    for i, row in enumerate(rows):
        out[i]["path"] = path[: len(row["head"])]
        path = path[: len(row["open"])] + [0] * (len(row["open"]) - len(path))
        for d, least in out[i].pop("open_least"):
            path[d] = least
    return out


def groups(rows: list[dict], sizes: list[int], keys: list[dict]) -> tuple[dict, dict]:
    """Lists of equal conversations that span blocks: by block the list that runs in from the left, and that which runs out."""
    come, go = {}, {}
    for i in range(len(rows) - 1):
        if keys[i]["last_key"] != keys[i + 1]["first_key"]:
            continue
        b = keys[i]["block"]
        whole = b in come and rows[i]["copies"] == sizes[i]
        go[b] = come[b] if whole else (b, rows[i]["last_group"])
        come[keys[i + 1]["block"]] = go[b]
    return come, go


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """A batch of rows of bigint, string and binary columns as in ddl."""
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    names, types = zip(*(x.split() for x in ddl.split(", ")))
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=list(names))


def trie(convs: DataFrame) -> DataFrame:
    """(conv_id, turns) -> one row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    blocks = blocks_of(convs)
    keys = [r.asDict() for r in blocks.select("block", "first_key", "last_key", F.size("conv").alias("n")).orderBy("block").collect()]  # one row a block
    sizes, seam = [k["n"] for k in keys], seams(keys)
    seam_b = spark.sparkContext.broadcast(seam)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = {"block": row["block"], **Block(row, *seam_b.value[row["block"]]).summary()}
                yield pa.RecordBatch.from_pylist([s], schema=summary_schema)

    head, open_ = (pa.list_(pa.struct([(x, pa.int64()) for x in names])) for names in (("place", "least", "leaves", "children", "saved"), ("place", "least", "words")))
    summary_schema = pa.schema([("block", pa.int64()), ("head", head), ("open", open_), ("copies", pa.int64()), ("last_group", pa.int64())])
    rows = [r.asDict(recursive=True) for r in blocks.mapInArrow(summarise, SUMMARY).orderBy("block").collect()]
    state = merged(rows, sizes)
    come, go = groups(rows, sizes, keys)
    piece_no = {g: i for i, g in enumerate(sorted(set(go.values())))}
    known_b = spark.sparkContext.broadcast({k["block"]: s for k, s in zip(keys, state)})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, known = row["block"], known_b.value[row["block"]]
                b = Block(row, *seam_b.value[block])
                path, out, last = list(known["path"]), [], go.get(block)
                for k, d, size, least, children, leaves, saved in sorted(b.nodes(known["offset"], known["carry"])[0]):
                    del path[d:]
                    path.append(least)
                    ends, piece = "", None
                    if d == b.length[k]:
                        e = k + 1
                        while e < b.n and b.lcp[e] == d == b.length[e]:
                            e += 1
                        if last and e == b.n:
                            piece = piece_no[last]
                        else:
                            ends = ",".join(map(str, b.conv[k:e]))
                    sha = None if piece is not None else hashlib.sha256(ends.encode()).hexdigest()
                    out.append((least, d, path[d - 1] if d else None, size, children, leaves, saved, sha, piece))
                    if len(out) == 10_000:
                        yield batch_of(out, NODES)
                        out = []
                yield batch_of(out, NODES)

    nodes = blocks.mapInArrow(finish, NODES)
    if not piece_no:
        return nodes.drop("piece")
    spanning = {k["block"]: (piece_no.get(come.get(k["block"])), rows[i]["copies"], piece_no.get(go.get(k["block"])), rows[i]["last_group"]) for i, k in enumerate(keys) if k["block"] in come or k["block"] in go}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block in spanning:
                    left, copies, right, at = spanning[block]
                    if left is not None:
                        out.append((left, block, ",".join(map(str, conv[:copies]))))
                    if right is not None and right != left:
                        out.append((right, block, ",".join(map(str, conv[at:]))))
            yield batch_of(out, "piece bigint, block bigint, ids string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            for piece, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if piece != now:
                    if h:
                        yield batch_of([(now, h.hexdigest())], "piece bigint, sha string")
                    now, h = piece, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.as_py().encode())
        if h:
            yield batch_of([(now, h.hexdigest())], "piece bigint, sha string")

    lists = blocks.select("block", "conv").mapInArrow(pieces, "piece bigint, block bigint, ids string")
    sha = lists.repartition("piece").sortWithinPartitions("piece", "block").mapInArrow(hashed, "piece bigint, sha string")
    both = nodes.join(scratch.small(sha), "piece", "left").withColumn("ends_sha256", F.coalesce("sha", "ends_sha256"))
    return both.drop("piece", "sha")


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of an ASCII string expression."""
    step = "xor(a, b)"
    for _ in range(8):
        step = f"list_transform([{step}], lambda v: xor(v >> 1, (v & 1) * 3988292384))[1]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: {step}), 4294967295)"


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)
), built AS (
  SELECT c.conv_id, 0 AS part, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth, sha256(length(role) || ':' || role || text) AS name,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM built
), prefix AS (
  SELECT conv_id, depth, string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, words FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), ends AS (
  SELECT conv_id, max(depth) AS depth FROM prefix GROUP BY conv_id
), nodes AS (
  SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(p.words) AS saved,
         sha256(coalesce(string_agg(CASE WHEN e.depth = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM prefix p JOIN ends e USING (conv_id) GROUP BY p.depth, p.path
), linked AS (
  SELECT n.*, u.path AS up, u.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN prefix q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 LEFT JOIN nodes u ON u.depth = q.depth AND u.path = q.path
), children AS (
  SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), kinds AS (
  SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN children k ON k.depth = l.depth AND k.path = l.path
), sums AS (
  SELECT a.depth, a.path, sum(k.saved) AS saved_tokens, sum((k.n_children = 0)::BIGINT) AS n_leaves
  FROM kinds k JOIN prefix a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY a.depth, a.path
)
SELECT k.conv_id, k.depth::BIGINT AS depth, k.parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM kinds k JOIN sums s ON s.depth = k.depth AND s.path = k.path
"""


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations after the contract's rebuilding."""
    return trie(rebuilt(conversations_of(scratch.docs_of(spark, sf_dir, "conversations"))))
