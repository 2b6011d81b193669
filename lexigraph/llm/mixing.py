"""Mix sources to target weights by hash-threshold histograms (DataFrame operations only).

A source's target is its share of a word budget. Every row of a source is taken ``base`` whole
times, and the rows whose hash lies under the source's threshold once more. The threshold is
found by nested histograms: words are summed by source and the top bits of the hash, the
cumulated sums name the bucket in which the budget ends, and only that bucket is refined by the
next bits until it holds a single hash. The rows are then filtered by comparison with the
threshold; nothing is sorted and no row moves.

Defined results: null texts have size 0; null sources form one source, last in order; the hash is of
id and text, so rows without an id, or of one id, are spread like others; rows alike in both share a
hash and are taken alike; an empty table gives an empty result. The row at the threshold is taken if
that brings the source nearer to its target. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.sources.tables import numbered

from .common import WORD, need, packed, stage

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
HASH_BITS = 60
LEVEL_BITS = 10
#: Up to so many sources their thresholds (some 60 bytes each) are broadcast; beyond, the join shuffles with salted keys.
BROADCAST_SOURCES = 50_000
SALTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 as a long, which other engines can compute too."""
    both = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources by code point, nulls last, get the weights in turn. Giving the excess of capped
    sources to the others by weight, until none is above its cap, has one outcome: a level such
    that each target is the smaller of the cap and level x weight. It rises from the level without
    caps to what the sources below their caps have left to share, until no more sources reach theirs.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = F.array(*[F.lit(int(w)) for w in weights])
    weight = F.element_at(table, (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    placed = numbered(per, F.col("source").asc_nulls_last())
    rows = stage(placed.select("source", "source_size", weight.alias("w"), (F.col("source_size") * int(cap)).alias("most")), "mix")
    total, shares = rows.agg(F.sum("source_size"), F.sum("w")).first()
    level, last = ((total or 0) * float(budget) / shares if shares else 0.0), None
    while level != last:
        full = F.col("most") <= F.lit(level) * F.col("w")
        taken, free = rows.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0))).first()
        last, level = level, max(level, (total * float(budget) - taken) / free) if free else level
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("w"))
    return rows.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def _by_source(rows: DataFrame, small: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows (source, h, ...) with what small (_s, ...) has for their source. A small table under the checked size is broadcast; else hot sources are salted."""
    same = F.col("source").eqNullSafe(F.col("_s"))
    if few:
        return rows.join(F.broadcast(small), same, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_own", F.pmod(F.col("h"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_own") == F.col("_salt")), how).drop("_own", "_salt")


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target, base (whole takes), limit (rows with h < limit are taken once more)."""
    state = stage(
        targets.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("low", F.lit(0).cast("long"))
        .withColumn("limit", F.lit(None).cast("long")),
        "mix",
    )
    few = state.count() <= BROADCAST_SOURCES
    shift = HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        step = 1 << shift
        open_ = state.where("limit IS NULL").select(F.col("source").alias("_s"), "rest", "low")
        inside = _by_source(sized, open_, few).where((F.col("h") >= F.col("low")) & (F.col("h") - F.col("low") < F.lit(step << LEVEL_BITS)))
        # partial sums by source and bucket before the shuffle: a hot source is at most 1024 rows a task
        histogram = inside.groupBy("source", F.shiftright(F.col("h"), shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last"), F.first("rest").alias("rest")
        )
        running = Window.partitionBy("source").orderBy("bucket")
        ends = (
            histogram.withColumn("cum", F.sum("words").over(running))
            .where((F.col("cum") > F.col("rest")) & (F.col("cum") - F.col("words") <= F.col("rest")))
            .groupBy(F.col("source").alias("_s"))
            .agg(F.min(F.struct("bucket", "words", "cum", "first", "last")).alias("at"))
        )
        single = F.col("at.first") == F.col("at.last")
        left = F.col("rest") - (F.col("at.cum") - F.col("at.words"))
        taken = F.col("at.first") + F.when(left * 2 >= F.col("at.words"), F.lit(1)).otherwise(F.lit(0))
        limit = F.when(F.col("limit").isNotNull(), F.col("limit")).when(F.col("at").isNull(), F.lit(1 << HASH_BITS)).when(single, taken)
        state = stage(
            state.join(F.broadcast(ends) if few else ends, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "base",
                F.when(F.col("limit").isNull() & F.col("at").isNotNull(), left).otherwise(F.col("rest")).alias("rest"),
                F.when(F.col("limit").isNull() & F.col("at").isNotNull(), F.shiftleft(F.col("at.bucket"), shift)).otherwise(F.col("low")).alias("low"),
                limit.alias("limit"),
            ),
            "mix",
        )
        if state.where("limit IS NULL").isEmpty():
            break
    return state.select("source", "source_size", "target", "base", "limit")


def with_takes(rows: DataFrame, limits: DataFrame, cap: int = CAP) -> DataFrame:
    """Add source_size, target and copies to rows that have source and h."""
    few = limits.count() <= BROADCAST_SOURCES
    joined = _by_source(rows, limits.withColumnRenamed("source", "_s"), few, "left")
    copies = F.least(F.col("base") + (F.col("h") < F.col("limit")).cast("long"), F.lit(int(cap)).cast("long"))
    return joined.withColumn("copies", copies).drop("_s", "base", "limit")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken."""
    need(docs, "doc_id", "text", "source")
    sized = stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h")), "mix")
    rows = with_takes(sized, thresholds(sized, source_targets(sized, weights, budget, cap)), cap)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the same columns."""
    need(docs, "doc_id", "text", "source")
    keyed = docs.select(packed(docs).alias("doc"), "source", hash_of(F.col("doc_id"), F.col("text")).alias("h"))
    sized = stage(keyed.select("source", size_of(F.col("doc.text")).alias("size"), "h"), "mix")
    rows = with_takes(keyed, thresholds(sized, source_targets(sized, weights, budget, cap)), cap)
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.when(F.col("copies") > 0, F.col("copies")))).alias("n")).select("doc.*")
