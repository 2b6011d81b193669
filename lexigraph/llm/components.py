"""Connected components of a link table, by alternating stars.

Each round rewrites the links so that every node points to smaller nodes; the rounds end when
the links no longer change. All state is in tables of the shared folder; nothing is collected. Each
node's smallest neighbour is a table, too: so the links join it straight from their shuffle, and Spark
may split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stage

ship(__name__)
MAX_ROUNDS = 60


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both(links)
    low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links: u > v. Every u, and its other smaller neighbours, point to the smallest of these."""
    low = stage(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    others = links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v: long); root is the smallest node that it is linked to. Nulls and self-links are ignored."""
    state = stage(
        links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links",
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == seen:
            break
        seen = now
        state = stage(_small_star(stage(_large_star(state), "links")), "links")
    else:
        raise RuntimeError("the components did not settle")
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
