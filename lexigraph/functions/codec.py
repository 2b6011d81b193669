"""Variable-byte coding of ascending lists, and what it would save on the index."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def encode(value: int) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow."""
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at a place and the place after it; data that ends early gives what was read."""
    value = shift = 0
    while at < len(data):
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            break
    return value, at


def compress(ids: Sequence[int]) -> bytes:
    """Their number, then the gaps of an ascending list, the first from zero."""
    gaps: Iterable[int] = (b - a for a, b in zip([0, *ids], ids))
    return encode(len(ids)) + b"".join(map(encode, gaps))


def decompress(data: bytes) -> list[int]:
    if not data:
        return []
    count, at = decode(data)
    out, last = [], 0
    for _ in range(count):
        gap, at = decode(data, at)
        last += gap
        out.append(last)
    return out


def encoded_length(value: Column) -> Column:
    """Bytes of a number's code."""
    return F.when(value < 1 << 7, 1).when(value < 1 << 14, 2).when(value < 1 << 21, 3).when(value < 1 << 28, 4).otherwise(5)


def list_length(positions: Column) -> Column:
    """Bytes of an ascending array's code."""
    gaps = F.transform(positions, lambda x, i: encoded_length(x - F.when(i > 0, F.get(positions, i - 1)).otherwise(0)))
    return encoded_length(F.size(positions)) + F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


#: Bits of a document's id below its stretch; a term's list is cut there, so that no task sorts a whole one.
STRETCH_BITS = 20
#: Rows that a task sorts, on average; a stretch is at most 1 << STRETCH_BITS.
SORTED_ROWS = 1_000_000


def id_gaps(postings: DataFrame) -> DataFrame:
    """(term, doc_id, gap): each document's distance from the term's one before.

    Rows are counted, which a stored table answers from its footers, and dealt to as many tasks as they
    fill, so that a task's sort is as large in any corpus.
    """
    rows = postings.select("term", "doc_id", F.shiftright("doc_id", STRETCH_BITS).alias("stretch"))
    parts = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SORTED_ROWS))
    rows = rows.repartition(parts, "term", "stretch")
    before = F.lag("doc_id").over(Window.partitionBy("term", "stretch").orderBy("doc_id"))
    # the first of a stretch follows the last of the term's stretch before
    ends = rows.groupBy("term", "stretch").agg(F.max("doc_id").alias("end"))
    ends = ends.select("term", "stretch", F.lag("end").over(Window.partitionBy("term").orderBy("stretch")).alias("end")).where("end IS NOT NULL")
    met = rows.withColumn("before", before).join(ends, ["term", "stretch"], "left")
    return met.select("term", "doc_id", (F.col("doc_id") - F.coalesce("before", "end", F.lit(0))).alias("gap"))


def compression_stats(postings: DataFrame) -> DataFrame:
    """One row: original_bytes, compressed_bytes, ratio, savings_percent."""
    gaps = id_gaps(postings).groupBy("term").agg(F.count("*").alias("df"), F.sum(encoded_length(F.col("gap"))).alias("bytes"))
    ids = gaps.agg(F.coalesce(F.sum(F.col("bytes") + encoded_length(F.col("df"))), F.lit(0)).alias("id_bytes"))
    own = postings.agg(
        F.coalesce(F.sum(8 + 4 * F.size("positions")), F.lit(0)).cast("long").alias("original_bytes"),
        F.coalesce(F.sum(list_length(F.col("positions")) + 4), F.lit(0)).cast("long").alias("position_bytes"),
    )
    both = own.crossJoin(F.broadcast(ids))  # two single rows
    compressed = (F.col("position_bytes") + F.col("id_bytes")).cast("long")
    ratio = F.when(F.col("original_bytes") > 0, compressed / F.col("original_bytes")).otherwise(1.0)
    return both.select("original_bytes", compressed.alias("compressed_bytes"), ratio.alias("ratio"), ((1 - ratio) * 100).alias("savings_percent"))


def _hex(byte: Column) -> Column:
    return F.lpad(F.hex(byte), 2, "0")


def encoded_hex(value: Column) -> Column:
    """A number's code as hexadecimal digits."""
    bits = lambda k: F.shiftright(value, 7 * k).bitwiseAND(0x7F)
    last = encoded_length(value) - 1
    return F.concat(*[F.when(last > k, _hex(bits(k) + 0x80)).when(last == k, _hex(bits(k))).otherwise("") for k in range(5)])


def compressed(ids: Column) -> Column:
    """The bytes of ``compress`` for an ascending array, without Python."""
    gaps = F.transform(ids, lambda x, i: encoded_hex((x - F.when(i > 0, F.get(ids, i - 1)).otherwise(0)).cast("long")))
    return F.unhex(F.concat(encoded_hex(F.size(ids).cast("long")), F.array_join(gaps, "")))


def decompressed(data: Column) -> Column:
    """The array of longs whose bytes these are. Sums along an array take square time in column form, so Arrow batches go to Python."""

    @F.pandas_udf("array<long>")
    def run(codes: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else decompress(c) for c in codes], dtype=object)

    return run(data)
