"""Prefix search and sentence-aware chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunk size and overlap of the splitter, in units of the size function (characters).
CHUNK, OVERLAP = 1024, 20


def begins_with(c: str, prefix: str) -> Column:
    """Whether a text begins with `prefix`, letter case aside; nothing in the prefix is a wildcard."""
    return F.startswith(F.lower(c), F.lit(prefix.strip().lower()))


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_no, chunk: texts in chunks of whole sentences up to `size` characters.

    A chunk takes sentences while they fit; a sentence longer than `size` stands alone, cut into pieces of that size. A chunk
    begins with the end of the one before, `overlap` characters, where its first sentence leaves room for it. Null and blank texts
    have no chunks.
    """
    parts = F.filter(F.split(F.col(text), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)
    pieces = F.flatten(F.transform(parts, lambda s: F.transform(F.sequence(F.lit(0), ((F.length(s) - 1) / size).cast("int")), lambda i: F.substr(s, i * size + 1, F.lit(size)))))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(a: Column, s: Column) -> Column:
        joined = F.when(a["open"] == "", s).otherwise(F.concat(a["open"], F.lit(" "), s))
        tail = F.right(a["open"], F.lit(overlap))
        fresh = F.when(F.length(s) + overlap + 1 <= size, F.concat(tail, F.lit(" "), s)).otherwise(s)
        full = F.length(joined) > size
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(full, fresh).otherwise(joined).alias("open"))

    packed = F.aggregate(pieces, empty, add, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
    return df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(packed).alias("chunk_no", "chunk"))
