"""BM25 retrieval, phrases, reranking and snippets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import kept_words_column, tokenize_text, with_stem
from lexigraph.operators.index import Index
from lexigraph.sources.tables import stage

RESULTS = "query_id int, doc_id bigint, score double, matched_terms array<string>"
#: A query list up to this many terms is broadcast; the bound is checked when the list is made.
MAX_QUERY_TERMS = 100_000


@dataclass(frozen=True)
class BM25Config:
    k1: float = 1.2
    b: float = 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def query_terms(spark: SparkSession, queries: Sequence[Sequence[str]]) -> DataFrame:
    """(query_id, term, weight, qpos) of tokenized queries: repeated terms weigh as often as they occur."""
    rows = []
    for q, terms in enumerate(queries):
        for t in dict.fromkeys(terms):
            rows.append((q, t, list(terms).count(t), list(terms).index(t)))
    if len(rows) > MAX_QUERY_TERMS:
        raise ValueError(f"over {MAX_QUERY_TERMS} query terms in one batch")
    return spark.createDataFrame(rows, "query_id int, term string, weight int, qpos int")


def bm25_terms(index: Index, queries: Sequence[Sequence[str]], config: BM25Config = BM25Config()) -> DataFrame:
    """Scores of all documents with a query term, for many queries in one plan: query_id, doc_id, score, matched_terms.

    The terms are literals in the filter on postings, so it reaches a Parquet scan; only the
    postings of query terms are read; document frequencies and totals come from the stored tables.
    """
    spark = index.postings.sparkSession
    wanted = sorted({t for q in queries for t in q})
    if not wanted:
        return spark.createDataFrame([], RESULTS)
    hits = index.postings.where(F.col("term").isin(wanted)).select("term", "doc_id", "tf", "dl")
    frequency = index.terms().where(F.col("term").isin(wanted))
    corpus = index.corpus_stats().select("n", "avgdl")
    weights = query_terms(spark, queries).join(frequency, "term").crossJoin(corpus)  # one row for each query term
    tf, dl = F.col("tf"), F.col("dl")
    part = idf(F.col("n"), F.col("df")) * (tf * (config.k1 + 1)) / (tf + config.k1 * (1 - config.b + config.b * dl / F.col("avgdl")))
    scored = hits.join(F.broadcast(weights), "term").select("query_id", "doc_id", (part * F.col("weight")).alias("part"), F.struct("qpos", "term").alias("t"))
    return scored.groupBy("query_id", "doc_id").agg(
        F.sum("part").alias("score"), F.transform(F.array_sort(F.collect_list("t")), lambda x: x["term"]).alias("matched_terms")
    )


def best_first() -> list[Column]:
    """By score, ties by doc_id. Sums that differ only in their order of addition tie."""
    return [F.round("score", 9).desc(), F.col("doc_id").asc()]


def top(rows: DataFrame, k: int | None) -> DataFrame:
    """The k best rows of every query, ties by doc_id."""
    if k is None:
        return rows
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, query: str, k: int | None = 10, config: BM25Config = BM25Config()) -> DataFrame:
    """doc_id, score, matched_terms of the k best documents, best first."""
    rows = bm25_terms(index, [tokenize_text(query)], config).select("doc_id", "score", "matched_terms")
    rows = rows.orderBy(*best_first())
    return rows if k is None else rows.limit(k)


def search_batch(index: Index, queries: Sequence[str], k: int = 10, config: BM25Config = BM25Config()) -> DataFrame:
    """query_id, rank, doc_id, score, matched_terms for many queries in one job."""
    rows = top(bm25_terms(index, [tokenize_text(q) for q in queries], config), k)
    return rows.select("query_id", "rank", "doc_id", "score", "matched_terms")


def all_terms(index: Index, terms: Sequence[str]) -> DataFrame:
    """doc_id of documents that have every term."""
    wanted = sorted(set(terms))
    found = index.postings.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.count("*").alias("_n"))
    return found.where(F.col("_n") == len(wanted)).select("doc_id")


def phrase_documents(index: Index, terms: Sequence[str]) -> DataFrame:
    """doc_id of documents that have the terms at consecutive positions.

    One pass over the postings of the phrase's terms: every position votes for the start that it
    implies, and a start that all places of the phrase vote for is a match.
    """
    places = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(i).alias("place")) for i, t in enumerate(terms)])
    hits = index.postings.where(F.col("term").isin(sorted(set(terms)))).select("doc_id", "term", "positions")
    both = hits.join(all_terms(index, terms), "doc_id", "left_semi")
    starts = both.select("doc_id", "positions", F.explode(F.filter(places, lambda p: p["term"] == F.col("term"))).alias("p"))
    starts = starts.select("doc_id", F.col("p.place").alias("place"), F.explode("positions").alias("pos"))
    found = starts.groupBy("doc_id", (F.col("pos") - F.col("place")).alias("start")).agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(terms)).select("doc_id").distinct()


def phrase_search(index: Index, query: str, k: int = 10, config: BM25Config = BM25Config(), candidate_factor: int | None = 5) -> DataFrame:
    """Documents with the phrase, by BM25. candidate_factor: only the best k x factor by BM25 are looked at; None: all."""
    terms = tokenize_text(query)
    if len(terms) < 2:
        return search(index, query, k, config)
    pool = search(index, query, None if candidate_factor is None else k * candidate_factor, config)
    return pool.join(phrase_documents(index, terms), "doc_id", "left_semi").orderBy(*best_first()).limit(k)


def title_boost(documents: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(doc_id, boost): 1.6 for a query term in the title, times 1.2 for one in the path."""
    out = documents.select("doc_id", F.lit(1.0).alias("boost"))
    for column, factor in (("title", 1.6), ("path", 1.2)):
        words = documents.select("doc_id", F.explode(kept_words_column(F.col(column))).alias("word"))
        hit = with_stem(words).where(F.col("term").isin(list(terms))).select("doc_id").distinct().withColumn("_hit", F.lit(factor))
        out = out.join(hit, "doc_id", "left").select("doc_id", (F.col("boost") * F.coalesce("_hit", F.lit(1.0))).alias("boost"))
    return out


def rerank(results: DataFrame, documents: DataFrame, query: str, pageranks: DataFrame | None = None, alpha: float = 0.35, k: int | None = None) -> DataFrame:
    """results (doc_id, score, ...) with boosted scores. Only the documents of the results are read from."""
    terms = tokenize_text(query)
    if not terms:
        return results if k is None else results.limit(k)
    results = stage(results, "results")  # the few best rows, which are used several times
    own = stage(documents.join(results.select("doc_id"), "doc_id", "left_semi").select("doc_id", "title", "path"), "results")
    rows = results.join(title_boost(own, terms), "doc_id", "left")
    score = F.col("score") * F.coalesce("boost", F.lit(1.0))
    if pageranks is not None:
        nodes = pageranks.agg(F.count("*").alias("_nodes"))
        rows = rows.join(pageranks, "doc_id", "left").crossJoin(F.broadcast(nodes))  # a single row
        score = score * F.when(F.col("_nodes") > 0, 1 + alpha * F.log1p(F.coalesce("pr", F.lit(0.0)) * F.col("_nodes"))).otherwise(1.0)
    rows = rows.withColumn("score", score).select(results.columns).orderBy(*best_first())
    return rows if k is None else rows.limit(k)


def snippet(body: Column, terms: Column, context: int = 8) -> Column:
    """Words around the first that has a term in it, or is in one; "..." where words were left out.

    A word is compared by its lower-cased letters and numbers, so one of punctuation alone, which
    leaves nothing, is in every term.
    """
    words = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?U)(\S+)"), 1)
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{IsAlphabetic}\p{N}]", ""))
    hit = F.transform(bare, lambda w: F.exists(terms, lambda t: F.contains(w, t) | F.contains(t, w)))
    centre = F.greatest(F.array_position(hit, F.lit(True)).cast("int"), F.lit(1))
    start = F.greatest(centre - context, F.lit(1))
    end = F.least(centre + context, F.size(words))
    cut = F.array_join(F.slice(words, start, F.greatest(end - start + 1, F.lit(0))), " ")
    whole = F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(end < F.size(words), "...").otherwise(""))
    return F.when(F.size(words) == 0, "").otherwise(whole)
