"""Chunking: sections, paragraphs, lines or sentences packed to a token limit, small pieces merged.

Packing, overlap, deduplication and positions are folds over each text and run as one Arrow pass; types and token
counts are column expressions over the chunk rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_type, estimate_tokens

MOST, LEAST, OVERLAP = 512, 100, 50
SLICE_BYTES = 2_000_000
HEADING = re.compile(r"^#{1,6}\s+.+$", re.M)
ABBREVIATION = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Jr|Sr|[A-Z])\.$")
SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
LISTED = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+", re.M)


def tokens(text: str) -> int:
    return len(text.split()) * 13 // 10


def sentences(text: str) -> list[str]:
    """Split after . ! ? before a capital, not after an abbreviation or initial."""
    out: list[str] = []
    for part in SENTENCE.split(text):
        if out and ABBREVIATION.search(out[-1]):
            out[-1] += " " + part
        else:
            out.append(part)
    return [s.strip() for s in out if s.strip()]


def pack(pieces: list[str], glue: str, most: int) -> list[str]:
    """Fill chunks with pieces in order; a piece that is too large alone goes by words."""
    out, now, size = [], [], 0
    for p in pieces:
        n = tokens(p)
        if size + n > most and now:
            out.append(glue.join(now))
            now, size = [], 0
        if n > most and " " in p:
            out += pack(p.split(), " ", most)
        else:
            now.append(p)
            size += n
    return out + ([glue.join(now)] if now else [])


def split(text: str | None, most: int = MOST, least: int = LEAST) -> list[str]:
    """A text's chunks before overlap."""
    text = (text or "").strip()
    if not text:
        return []
    if tokens(text) <= most:
        return [text]
    cuts = [m.start() for m in HEADING.finditer(text)]
    sections = [text[a:b].strip() for a, b in zip([0, *cuts], [*cuts, len(text)])]
    pieces: list[str] = []
    for s in filter(None, sections):
        if tokens(s) <= most:
            pieces.append(s)
            continue
        for para in filter(None, (p.strip() for p in re.split(r"\n\s*\n", s))):
            if tokens(para) <= most:
                pieces.append(para)
                continue
            lines = para.split("\n")
            shaped = sum("|" in x or bool(LISTED.match(x)) for x in lines) > len(lines) / 2 and len(lines) > 1
            pieces += pack(lines, "\n", most) if shaped else pack(sentences(para), " ", most)
    merged = pieces[:1]
    for p in pieces[1:]:
        if tokens(merged[-1]) < least and tokens(merged[-1] + " " + p) <= most:
            merged[-1] += "\n\n" + p
        else:
            merged.append(p)
    return merged


SPACES = re.compile(r"[ \t\n\x0b\f\r]+")  # white space of the column expressions


def led(prev: str | None, raw: str, words: int, most: int) -> str:
    """with_overlap() of one chunk."""
    if prev is None or not words:
        return raw
    lead = " ".join(SPACES.sub(" ", prev).strip(" ").split(" ")[-words:])
    both = f"{lead} {raw}"
    flat = SPACES.sub(" ", both).strip(" ")
    return both if (len(flat.split(" ")) if flat else 0) * 13 // 10 <= most * 1.2 else raw


def key(text: str) -> str:
    """content_hash() of one chunk."""
    return hashlib.md5(SPACES.sub(" ", text.lower()).strip(" ").encode()).hexdigest()[:12]


def placed(text: str | None, most: int, least: int, overlap: int) -> list[tuple]:
    """(content, hash, position ratio, heading) of a text's chunks in order, the first of equal ones.

    A chunk is looked for from the end of the one found before; what is not found verbatim (overlap, merged pieces) is placed by
    its number among the chunks. Its heading is the last one before it.
    """
    text = text or ""
    raw = split(text, most, least)
    heads = [(m.start(), m.group().lstrip("#").strip()) for m in HEADING.finditer(text)]
    out, seen, at = [], set(), 0
    for i, r in enumerate(raw):
        content = led(raw[i - 1] if i else None, r, overlap, most)
        h = key(content)
        if h in seen:
            continue
        seen.add(h)
        pos = text.find(content, at)
        if pos >= 0:
            at, ratio = pos + len(content), pos / len(text)
        else:
            ratio = i / len(raw)
        before = bisect_left(heads, (pos if pos >= 0 else at,))
        out.append((content, h, round(ratio, 3), heads[before - 1][1] if before else None))
    return out


def slices(b: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of b (id, text) of about ``size`` bytes of text, one row at least, so that only so much is held as chunks at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield b.slice(at, end - at)
        at = end


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, content, chunk_type, token_count, content_hash, position_ratio, heading): chunks with overlap, the first of equal ones of a row.

    One pass over the rows, no shuffle: a text's chunks are made, led by overlap, deduplicated and placed where the text is.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b):
                ids, parts = [], []
                for i, t in zip(x.column(0), x.column(1)):
                    own = placed(t.as_py(), most, least, overlap)
                    ids += [i.as_py()] * len(own)
                    parts += [(k, *c) for k, c in enumerate(own)]
                cols = list(zip(*parts)) or [()] * 5
                kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, x.column(0).type), *map(pa.array, cols, kinds)], names=["id", "chunk_index", "content", "content_hash", "position_ratio", "heading"])

    rows = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, chunk_index bigint, content string, content_hash string, position_ratio double, heading string")
    out = rows.withColumns({"chunk_type": chunk_type(F.col("content")), "token_count": estimate_tokens(F.col("content"))})
    return out.withColumnRenamed("id", id_col).select(id_col, "chunk_index", "content", "chunk_type", "token_count", "content_hash", "position_ratio", "heading")


def page_stats(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, total_chunks, total_tokens, avg_chunk_size) of pages with any chunk."""
    n, t = F.count(F.lit(1)), F.sum("token_count")
    return chunks.groupBy(id_col).agg(n.alias("total_chunks"), t.alias("total_tokens"), F.round(t / n, 1).alias("avg_chunk_size"))


def with_overlap(prev: Column, raw: Column, words: int, most: int) -> Column:
    """raw led by the last ``words`` words of prev, where that stays within 1.2 x most tokens."""
    if not words:
        return raw
    w = F.split(F.trim(F.regexp_replace(prev, r"\s+", " ")), " ")
    lead = F.array_join(F.slice(w, F.greatest(F.size(w) - words + 1, F.lit(1)), words), " ")
    both = F.concat(lead, F.lit(" "), raw)
    return F.when(prev.isNotNull() & (estimate_tokens(both) <= most * 1.2), both).otherwise(raw)


def heading_before(positions: Column, headings: Column) -> Column:
    """As-of lookup: the last of headings (array of (pos, text) in order) before a position; null if none."""
    return F.try_element_at(F.filter(headings, lambda h: h["pos"] < positions), F.lit(-1))["text"]
