"""The search engine's session: ingest, save and load, and queries by mode."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexigraph.functions import codec, web
from lexigraph.operators import boolean, crawl, fuzzy, graph, ranking
from lexigraph.operators import index as indexes
from lexigraph.sources import files, tables

ALPHA = 0.35
POOL = 50
MODES = ("phrase:", "bool:", "fuzzy:", "spell:")


@dataclass
class Answer:
    """Rows of a query (rank, doc_id, score, title, path, snippet), and what was done to get them."""

    mode: str
    query: str
    rows: list[Row]
    notes: list[str] = field(default_factory=list)
    suggestion: str | None = None
    seconds: float = 0.0


class SearchEngine:
    """Tables of one corpus. Few rows ever come to the driver: results are cut to the best before they do."""

    def __init__(self, spark: SparkSession, documents: DataFrame, index: indexes.Index | None = None, pageranks: DataFrame | None = None, edges: DataFrame | None = None, config: ranking.BM25Config = ranking.BM25Config()):
        self.spark, self.documents, self.pageranks, self.edges, self.config = spark, documents, pageranks, edges, config
        self.index = index or indexes.build(documents)

    @classmethod
    def empty(cls, spark: SparkSession) -> SearchEngine:
        return cls(spark, spark.createDataFrame([], tables.SCHEMAS["documents"]))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SearchEngine:
        t = tables.load(spark, path)
        ranks = None if t["pageranks"].isEmpty() else t["pageranks"]
        return cls(spark, t["documents"], indexes.Index(t["postings"], t["doc_stats"], t["terms"], t["corpus_stats"], t["deletions"]), ranks, t["edges"])

    def save(self, path: str) -> int:
        """Write the corpus and go on from what was written. The path may be the one that it was loaded from."""
        size = tables.save(path, self.index, self.documents, self.edges, self.pageranks)
        saved = SearchEngine.load(self.spark, path)
        self.documents, self.index, self.pageranks, self.edges = saved.documents, saved.index, saved.pageranks, saved.edges
        return size

    def cached(self) -> SearchEngine:
        """Keep the index in executors' memory for a series of queries."""
        i = self.index
        self.index = indexes.Index(i.postings.persist(), i.doc_stats.persist(), i.terms().persist(), i.corpus_stats().persist(), i.stored_deletions)
        return self

    def next_id(self) -> int:
        return self.documents.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).first()[0] + 1

    def add_documents(self, documents: DataFrame) -> None:
        """Append documents; ids that are there already are left out."""
        fresh = documents.join(self.documents.select("doc_id"), "doc_id", "left_anti").select("doc_id", "path", "title", "body")
        self.index = indexes.merge(self.index, indexes.build(fresh))
        self.documents = self.documents.unionByName(fresh)

    def add_folder(self, folder: str) -> int:
        found = files.read_folder(self.spark, folder, self.next_id())
        self.add_documents(found)
        return found.count()

    def add_crawl(self, seeds: Sequence[str], fetcher: crawl.Fetcher | None = None, config: crawl.CrawlConfig = crawl.CrawlConfig(), robots: DataFrame | None = None) -> dict[str, int]:
        """Crawl, append new pages, and rank all pages anew over the whole link graph."""
        known = tables.url_map(self.documents)
        result = crawl.crawl(self.spark, seeds, fetcher or crawl.http_fetcher(config), config, robots, known, self.next_id())
        self.add_documents(result.documents)
        self.edges = result.edges if self.edges is None else self.edges.unionByName(result.edges).distinct()
        nodes = self.documents.where(F.col("path").rlike("^https?://")).select(F.col("doc_id").alias("id"))
        self.pageranks = graph.pagerank(nodes, self.edges)
        return result.metrics

    def statistics(self) -> dict[str, object]:
        s = indexes.stats(self.index).first()
        c = codec.compression_stats(self.index.postings).first()
        out = {**s.asDict(), **c.asDict()}
        if self.pageranks is not None:
            out |= graph.summary(self.pageranks).first().asDict()
        return out

    def _best(self, results: DataFrame, query: str, k: int, context: int) -> list[Row]:
        """Rerank the pool, and look up and cut texts of the k best only."""
        best = ranking.rerank(results, self.documents, query, self.pageranks, ALPHA, k)
        best = tables.stage(best, "best")
        rows = best.join(self.documents, "doc_id").select(
            "doc_id", "score", "title", "path", ranking.snippet(F.col("body"), F.col("matched_terms"), context).alias("snippet")
        )
        rows = rows.orderBy(*ranking.best_first()).collect()  # k rows
        return [Row(rank=i + 1, **r.asDict()) for i, r in enumerate(rows)]

    def _ranked(self, query: str, k: int, context: int) -> list[Row]:
        return self._best(ranking.search(self.index, query, POOL, self.config), query, k, context)

    def query(self, text: str, k: int = 10, context: int = 8) -> Answer:
        """One line of input: phrase:, bool:, fuzzy: or spell: and a query, or a plain query, which is corrected if nothing is found."""
        with tables.stages(self.spark):
            return self._answer(text, k, context)

    def _answer(self, text: str, k: int, context: int) -> Answer:
        start, text = time.perf_counter(), text.strip()
        mode = next((m for m in MODES if text.startswith(m)), "")
        query, notes, suggestion = text[len(mode) :].strip(), [], None
        if mode == "phrase:":
            name, rows = "phrase", self._best(ranking.phrase_search(self.index, query, POOL, self.config), query, k, context)
        elif mode == "bool:":
            result = boolean.boolean_search(self.index, query, POOL, self.config)
            if result.expression is not None:
                notes.append(f"Parsed: {result.expression}")
            notes.append(f"{result.matching_docs()} docs matched boolean filter")
            name, rows = "boolean", self._best(result.results, query, k, context)
        elif mode == "fuzzy:":
            found = fuzzy.fuzzy_search(self.index, query, POOL, fuzzy.MAX_DISTANCE, self.config)
            if found.corrections:
                notes.append("Fuzzy expansions: " + ", ".join(f"{a} -> {b} (dist {d})" for a, b, d in found.corrections))
            name, rows = "fuzzy", self._best(found.results, query, k, context)
        elif mode == "spell:":
            suggestion = fuzzy.correct_query(self.index, query)
            notes.append(fuzzy.correction_text(suggestion) if suggestion else "No corrections needed.")
            name, rows = ("spell-corrected" if suggestion else "bm25"), self._ranked(suggestion or query, k, context)
        else:
            name, rows = "bm25", self._ranked(query, k, context)
            if not rows and (suggestion := fuzzy.correct_query(self.index, query)):
                notes.append(fuzzy.correction_text(suggestion))
                name, rows = "spell-corrected", self._ranked(suggestion, k, context)
        return Answer(name, query, rows, notes, suggestion, time.perf_counter() - start)

    def web_query(self, text: str, k: int = 20, context: int = 14) -> Answer:
        """A query as the page asks it: any mode, and always with a suggestion where there is one."""
        answer = self.query(text, k, context)
        if answer.suggestion is None and not text.startswith(MODES):
            answer.suggestion = fuzzy.correct_query(self.index, text)
        if answer.suggestion == text:
            answer.suggestion = None
        return answer


def printed(answer: Answer) -> str:
    """An answer as lines of text."""
    lines = [f"  {n}" for n in answer.notes]
    if not answer.rows:
        return "\n".join([*lines, "  No results found."])
    lines.append(f"\n  {len(answer.rows)} results in {answer.seconds:.3f}s [{answer.mode}]:\n")
    for r in answer.rows:
        lines += [f"  {r.rank}. [score: {r.score:.3f}] {r.title}", f"     {r.path}", *([f"     {r.snippet}\n"] if r.snippet else [])]
    return "\n".join(lines)


def printed_statistics(s: dict[str, object]) -> str:
    out = [
        f"Documents: {s['documents']}", f"Unique terms: {s['unique_terms']}", f"Postings: {s['total_postings']}", f"Average length: {s['avg_doc_length']:.1f}",
        f"Compression: {web.format_bytes(s['original_bytes'])} -> {web.format_bytes(s['compressed_bytes'])} ({s['savings_percent']:.1f}% savings)",
    ]
    if "max_pr" in s:
        out.append(f"PageRank: max {s['max_pr']:.6f}, avg {s['avg_pr']:.6f}")
    return "\n".join(out)
