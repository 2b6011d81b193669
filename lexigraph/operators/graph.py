"""Link graph and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.sources.tables import stage

DAMPING = 0.85
ITERATIONS = 30
HUB_LINKS = 1_000_000
PART_LINKS = 2_000_000
PER_JOB = 2


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree) of every node; links to itself count, and so do repeated ones."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def in_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dst, src) that pass rank: no links to itself, none that leave the nodes."""
    inside = edges.where("src <> dst").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return inside.select("dst", "src")


def resolve_links(links: DataFrame, url_map: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links (src, url) whose url is known; url_map has url, doc_id."""
    return links.join(url_map.select("url", F.col("doc_id").alias("dst")), "url").select("src", "dst").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, pr) of nodes (id) under edges (src, dst), by a fixed number of iterations.

    A node gives pr / out_degree along each of its links; what it gives to itself is lost. Nodes
    without links give to all, and all that an iteration needs of them is the sum of their ranks,
    which is what is left of the sum of all: so only ranks of nodes with links, and links between
    such nodes, take part in it. Links to the others are followed once, in the last iteration.

    Links stay cached in partitions by source, those of a hub in several (``HUB_LINKS`` each), so an
    iteration moves ranks and partial sums but no links; partitions are as few as their links allow
    (``PART_LINKS`` each), as every partition sends a partial sum for each node that it links to. A
    job is ``PER_JOB`` iterations; it writes its ranks to the shared folder, which cuts lineage.
    """
    spark = nodes.sparkSession
    held = []

    def kept(frame: DataFrame) -> DataFrame:
        held.append(frame.persist())
        return held[-1]

    try:
        n = nodes.count()
        if n == 0:
            return spark.createDataFrame([], "doc_id bigint, pr double")
        inside = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("inside")).distinct()
        passes = F.col("inside").isNotNull() & (F.col("src") != F.col("dst"))  # as in in_links
        linked = stage(edges.join(inside, "dst", "left").select(F.col("src").alias("id"), "dst", passes.alias("passes")), "links")
        passing = linked.where("passes").select("id", "dst")
        slices = F.ceil(F.col("out_degree") / HUB_LINKS).cast("int")
        core = kept(linked.groupBy("id").agg(F.count("*").alias("out_degree"), F.count_if("passes").alias("passed")).join(nodes.select("id"), "id"))
        within = passing.join(core.select(F.col("id").alias("dst")), "dst", "left_semi").join(core.select("id", "out_degree"), "id")
        total = core.agg(F.coalesce(F.sum("passed"), F.lit(0))).first()[0]
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-total // PART_LINKS))))
        links = kept(within.select(F.col("id").alias("src"), "dst", F.pmod(F.xxhash64("dst"), slices).cast("int").alias("slice")).repartition(parts, "src", "slice"))
        ranks = core.select("*", F.lit(1.0 / n).alias("pr"), F.lit(1.0).alias("all"))
        base = (1 - damping) / n
        for turn in range(1, iterations + 1):
            last = turn == iterations
            # what nodes without links have: the sum of all ranks less that of the others
            sums = ranks.agg(F.coalesce(F.max("all"), F.lit(1.0)).alias("all"), F.coalesce(F.sum("pr"), F.lit(0.0)).alias("some"), F.coalesce(F.sum(F.col("pr") * F.col("passed") / F.col("out_degree")), F.lit(0.0)).alias("sent"))
            loose = sums.select((F.col("all") - F.col("some")).alias("loose"), "sent")
            share = (F.col("pr") / F.col("out_degree")).alias("share")
            if last:
                given = passing.join(ranks.select("id", share), "id")
            else:
                gives = ranks.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), share)
                given = links.join(gives, ["src", "slice"])
            given = given.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
            pr = base + damping * (F.col("loose") / n + F.coalesce("got", F.lit(0.0)))
            every = nodes.select("id") if last else core
            after = every.join(given, "id", "left").crossJoin(F.broadcast(loose))  # a single row
            if last:
                return stage(after.select(F.col("id").alias("doc_id"), pr.alias("pr")), "ranks")
            all_ = 1 - damping + damping * (F.col("loose") + F.col("sent"))
            ranks = after.select("id", "out_degree", "passed", pr.alias("pr"), all_.alias("all"))
            if turn % PER_JOB == 0 or turn == iterations - 1:
                ranks = stage(ranks, "ranks")
        return stage(nodes.select(F.col("id").alias("doc_id"), F.lit(1.0 / n).alias("pr")), "ranks")
    finally:
        for frame in held:
            frame.unpersist()


def summary(pageranks: DataFrame) -> DataFrame:
    """One row: max_pr, avg_pr."""
    return pageranks.agg(F.max("pr").alias("max_pr"), F.avg("pr").alias("avg_pr"))
