"""Breadth-first crawl as a loop of joins, one round for each depth.

A frontier row's ``path`` is the list of link places that lead to it from its seed; paths compare
like a breadth-first queue's order within a depth, so no row needs a global number. Pages come
from a fetcher: a function from a frontier (url) to (url, ok, content_type, body).
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lexigraph.functions.web import host_of, is_allowed, normalize_url, parse_robots, read_page, robots_rules, url_host, url_path
from lexigraph.operators.graph import resolve_links
from lexigraph.sources.tables import numbered, stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])
FETCHED = "url string, ok boolean, content_type string, body string"
Fetcher = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CrawlConfig:
    max_pages: int = 50
    max_depth: int = 2
    delay_ms: int = 500
    same_domain_only: bool = True
    user_agent: str = "lexigraph-crawler"
    timeout_secs: int = 10
    ended_references: bool = False  # ``ended`` of ``read_page``


@dataclass
class CrawlResult:
    documents: DataFrame  # doc_id, path, title, body of new pages
    links: DataFrame  # src (doc_id), url
    edges: DataFrame  # src, dst between known documents
    metrics: dict[str, int]


def table_fetcher(pages: DataFrame) -> Fetcher:
    """Pages from a table (url, html), for tests and for crawls of an archive. A URL has one answer: of several the least."""

    def fetch(frontier: DataFrame) -> DataFrame:
        found = frontier.select("url").join(pages.select("url", "html"), "url", "left").groupBy("url").agg(F.min("html").alias("html"))
        return found.select(
            "url", F.col("html").isNotNull().alias("ok"), F.lit("text/html").alias("content_type"), F.col("html").alias("body")
        )

    return fetch


def http_fetcher(config: CrawlConfig = CrawlConfig()) -> Fetcher:
    """Pages from the network. A host's pages are fetched in one task, with a pause before every request, the first of a round too."""

    def fetch(frontier: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import http.client
            import urllib.request

            last: dict[str, float] = {}
            began = time.monotonic()
            for batch in batches:
                rows = []
                for url in batch["url"]:
                    host = host_of(url) or ""
                    time.sleep(max(0.0, last.get(host, began) + config.delay_ms / 1000 - time.monotonic()))
                    try:
                        request = urllib.request.Request(url, headers={"User-Agent": config.user_agent})
                        with urllib.request.urlopen(request, timeout=config.timeout_secs) as answer:
                            rows.append((url, True, answer.headers.get("Content-Type", ""), answer.read().decode(answer.headers.get_content_charset() or "utf-8")))
                    except (OSError, ValueError, LookupError, http.client.HTTPException):
                        rows.append((url, False, None, None))
                    last[host] = time.monotonic()
                yield pd.DataFrame(rows, columns=["url", "ok", "content_type", "body"])

        parts = max(1, frontier.sparkSession.sparkContext.defaultParallelism)
        return frontier.select("url").repartition(parts, url_host(F.col("url"))).mapInPandas(run, FETCHED)

    return fetch


def robots_table(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(host, disallowed) of robots files by host."""
    return spark.createDataFrame([(h, parse_robots(t)) for h, t in texts.items()], "host string, disallowed array<string>")


def fetch_robots(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(host, disallowed) for the hosts of urls (url); a file that cannot be had closes nothing."""
    site = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    sites = urls.where(site != "").groupBy(url_host(F.col("url")).alias("host")).agg(F.min(site).alias("site"))
    asked = stage(sites.select("host", F.concat("site", F.lit("/robots.txt")).alias("url")), "robots")
    found = fetcher(asked.select("url")).where("ok").select("url", robots_rules(F.col("body")).alias("disallowed"))
    return asked.join(found, "url", "left").select("host", F.coalesce("disallowed", F.array().cast("array<string>")).alias("disallowed"))


def parsed_pages(pages: DataFrame, ended: bool = False) -> DataFrame:
    """title, text, links of pages (url, body), beside their other columns. A row stays a row, also where several have one URL. ended: as in ``read_page``."""
    kept = [c for c in pages.columns if c != "body"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read_page(b, u, ended=ended) for u, b in zip(batch["url"], batch["body"])]
            yield batch[kept].assign(**{name: pd.Series([x[i] for x in found], dtype=object, index=batch.index) for i, name in enumerate(("title", "text", "links"))})

    schema = StructType([pages.schema[c] for c in kept]).add("title", "string").add("text", "string").add("links", ArrayType(StringType()))
    return pages.mapInPandas(run, schema)


def crawl(spark: SparkSession, seeds: Sequence[str], fetcher: Fetcher, config: CrawlConfig = CrawlConfig(), robots: DataFrame | None = None, known: DataFrame | None = None, first_id: int = 0) -> CrawlResult:
    """Pages reachable from the seeds. known (url, doc_id): pages that are read for their links but not indexed again.

    robots (host, disallowed): rules that are known; None: each host's file is fetched in the round in which the host is first met.
    """
    start = list(dict.fromkeys(u for u in map(normalize_url, seeds) if u))
    hosts = sorted({h for h in map(host_of, start) if h})
    known = spark.createDataFrame([], "url string, doc_id bigint") if known is None else known.select("url", "doc_id")
    rules = robots_table(spark, {}) if robots is None else robots
    frontier = spark.createDataFrame([(u, [i]) for i, u in enumerate(start)], "url string, path array<int>")
    visited = frontier.select("url")
    found, metrics = None, dict.fromkeys(("fetched", "indexed", "skipped", "bytes"), 0)
    for depth in range(config.max_depth + 1):
        rows = frontier.withColumn("host", url_host(F.col("url")))
        scope = F.col("host").isin(hosts) if config.same_domain_only else F.lit(True)
        if robots is None:
            rules = stage(rules.unionAll(fetch_robots(rows.where(scope).join(rules, "host", "left_anti"), fetcher)), "robots")
        rows = rows.join(rules, "host", "left")
        rows = stage(rows.withColumn("open", scope & is_allowed(url_path(F.col("url")), F.col("disallowed"))).select("url", "path", "open"), "frontier")
        got = stage(rows.join(fetcher(rows.where("open")), "url", "left"), "fetched")
        kind = F.lower(F.coalesce("content_type", F.lit("")))
        readable = F.coalesce("ok", F.lit(False)) & (kind.contains("text/html") | kind.contains("text/plain")) & F.col("body").isNotNull()
        pages = got.where(readable).select("url", "path", F.octet_length("body").alias("bytes"), "body")
        pages = stage(parsed_pages(pages, config.ended_references).join(known.select("url", F.lit(True).alias("old")), "url", "left"), "pages")
        fresh = F.col("old").isNull() & (F.trim("text") != "")
        left = config.max_pages - metrics["indexed"]
        last = pages.where(fresh).orderBy("path").select("path").limit(left).agg(F.count("*").alias("n"), F.max("path").alias("path")).first()
        if last["n"] == left:  # the queue ends with the page that fills the quota
            cut = F.lit(list(last["path"]))
            pages, got, rows = pages.where(F.col("path") <= cut), got.where(F.col("path") <= cut), rows.where(F.col("path") <= cut)
        counts = got.agg(F.count_if(F.col("ok")).alias("fetched"), F.count("*").alias("all")).first()
        read = pages.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(fresh).alias("indexed"), F.count_if(F.col("old").isNull() & ~fresh).alias("empty"), F.count("*").alias("all")).first()
        metrics["fetched"] += counts["fetched"]
        metrics["bytes"] += read["bytes"]
        metrics["indexed"] += read["indexed"]
        metrics["skipped"] += counts["all"] - read["all"] + read["empty"]
        level = pages.withColumn("depth", F.lit(depth)).withColumn("new", fresh).drop("old", "bytes")
        found = level if found is None else found.unionAll(level)
        if depth == config.max_depth or metrics["indexed"] >= config.max_pages:
            break
        links = pages.select("path", F.posexplode("links").alias("place", "url"))
        links = links.groupBy("url").agg(F.min(F.concat("path", F.array("place"))).alias("path"))
        frontier = stage(links.join(visited, "url", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        visited = stage(visited.unionAll(frontier.select("url")), "visited")
    new = stage(numbered(found.where("new"), "depth", "path").where(F.col("place") < config.max_pages), "new")
    ids = new.select("url", (F.col("place") + first_id).alias("doc_id"))
    doc_id = (F.col("place") + first_id).alias("doc_id")
    documents = new.select(doc_id, F.col("url").alias("path"), "title", F.col("text").alias("body"))
    links = new.select(doc_id.alias("src"), F.explode("links").alias("url"))
    edges = resolve_links(links, known.unionAll(ids))
    return CrawlResult(documents, links, edges, metrics)


def bfs_depth(edges: DataFrame, seeds: Sequence[int], max_depth: int) -> DataFrame:
    """(id, depth) of nodes within max_depth links of the seeds, each at its least depth."""
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(int(s),) for s in dict.fromkeys(seeds)], "id bigint")
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        after = edges.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = stage(after.join(seen.select("id"), "id", "left_anti"), "frontier")
        seen = seen.unionAll(frontier.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
    return seen
