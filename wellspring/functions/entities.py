"""Names, dates and embeddings: company variations, proper nouns, date parsing, hashed-feature vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w{2,}")

# Date formats in order, company suffixes, entities and words that are no competitors.
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
SUFFIX = r"(?i),?\s+(inc|llc|ltd|corp|corporation|company|co|gmbh|plc)\.?$"
IGNORED = (
    "wikipedia reddit quora stackoverflow youtube twitter linkedin facebook instagram tiktok github medium substack google bing yahoo duckduckgo chrome safari firefox microsoft apple amazon aws europe london "
    "json html http https api url seo roi saas crm cms erp smtp ssl gdpr"
).split() + ["stack overflow", "united states", "north america", "south america", "new york", "san francisco", "los angeles"]
# Word edges and white space are ASCII, as RE2 takes them; Java's \b goes by all letters and its \s has the vertical tab.
MULTI = r"(?<!\w)[A-Z][a-z]+(?:[\t\n\f\r ]+[A-Z][a-z]+)+(?!\w)"
CAMEL = r"(?<!\w)[A-Z][a-z]*[A-Z]\w*(?!\w)"


def parse_date(s: Column) -> Column:
    """The first of the known formats that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DATE_FORMATS])


def company_variations(name: Column) -> Column:
    """Distinct lower-cased forms: the name, without suffix, without "The", and its first word of three letters or more."""
    n = F.lower(F.trim(name))
    bare = F.regexp_replace(n, SUFFIX, "")
    plain = F.regexp_replace(bare, r"^the\s+", "")
    first = F.substring_index(plain, " ", 1)
    return F.array_distinct(F.filter(F.array(n, bare, plain, F.when(F.length(first) >= 3, first)), lambda x: x.isNotNull() & (x != "")))


def competitors(text: Column, company: str, domain: str, ignored: list[str] = IGNORED) -> Column:
    """How many distinct capitalised phrases or CamelCase words are neither the company nor ignored."""
    text = F.coalesce(text, F.lit(""))
    found = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(MULTI), 0), F.filter(F.regexp_extract_all(text, F.lit(CAMEL), 0), lambda x: F.length(x) > 2)))
    keep = F.filter(found, lambda x: ~F.lower(x).isin(ignored) & ~F.contains(F.lower(x), F.lit(company.lower())) & ~F.contains(F.lower(x), F.lit(domain.lower())))
    return F.size(keep).cast("bigint")


def hashed_vectors(texts: DataFrame, key: str, text: str, width: int = 64) -> DataFrame:
    """(key, embedding): unit vectors of signed hashed word counts; the zero vector for a text without words.

    Reproducible across processes; one Arrow pass with numpy.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, width))
            for row, t in zip(out, b.column(1)):
                h = np.array([zlib.crc32(w.encode()) for w in WORD.findall((t.as_py() or "").lower())], dtype=np.int64)
                np.add.at(row, h % width, np.where(h >> 20 & 1, 1.0, -1.0))
            out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)
            flat = pa.array(out.astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width), flat)], names=["k", "embedding"])

    return texts.select(key, text).mapInArrow(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)
