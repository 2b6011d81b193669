"""The positional inverted index as tables.

``postings(term, doc_id, tf, dl, positions)`` carries the document's length, so that scoring needs
no join with the documents. A document's postings are made where its text is read: its words come as
one array, are grouped in Arrow batches, and each distinct word of a batch is stemmed once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.functions import text
from lexigraph.functions.text import kept_words_column, stem_word, with_stem

for _module in (sys.modules[__name__], text):
    cloudpickle.register_pickle_by_value(_module)

POSTINGS = "term string, doc_id bigint, tf int, dl int, positions array<int>"
DOC_STATS = "doc_id bigint, dl int"
TERMS = "term string, df bigint"
CORPUS_STATS = "n bigint, total_len bigint, avgdl double"
#: Tokens that are grouped at a time, or one document if it has more; stems that a worker keeps.
GROUPED_TOKENS = 400_000
KEPT_STEMS = 250_000


@dataclass
class Index:
    """Postings and document lengths; a stored index also has its terms, totals and deletion neighbourhoods, which answer without a scan of either."""

    postings: DataFrame
    doc_stats: DataFrame
    stored_terms: DataFrame | None = None
    stored_totals: DataFrame | None = None
    stored_deletions: DataFrame | None = None

    def corpus_stats(self) -> DataFrame:
        """One row: n, total_len, avgdl."""
        if self.stored_totals is not None:
            return self.stored_totals
        return self.doc_stats.agg(
            F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total_len"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")
        )

    def terms(self) -> DataFrame:
        """(term, df)."""
        if self.stored_terms is not None:
            return self.stored_terms
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def get_postings(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term)

    def doc_frequency(self, term: str) -> int:
        found = self.terms().where(F.col("term") == term).first()
        return found["df"] if found else 0


def tokens(documents: DataFrame, body: str = "body") -> DataFrame:
    """(doc_id, dl, pos, term): every indexed token with its position."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), kept_words_column(F.col(body)).alias("_words"))
    rows = rows.select("doc_id", F.size("_words").alias("dl"), F.posexplode("_words").alias("pos", "word"))
    return with_stem(rows).select("doc_id", "dl", "pos", "term")


def doc_stats(documents: DataFrame, body: str = "body") -> DataFrame:
    """(doc_id, dl): documents without tokens have length 0 and count."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(kept_words_column(F.col(body))).alias("dl"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of documents (doc_id, words), document by document."""
    stems: dict[str, str] = {}
    for batch in batches:
        ids, words = batch.column("doc_id"), batch.column("words")
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(lengths), 0
        while start < len(lengths):
            begun = ends[start] - lengths[start]
            stop = max(start + 1, int(np.searchsorted(ends, begun + GROUPED_TOKENS, "right")))
            own = lengths[start:stop]
            if total := int(own.sum()):
                coded = words.slice(start, stop - start).flatten().dictionary_encode()
                if len(stems) > KEPT_STEMS:
                    stems.clear()
                codes: dict[str, int] = {}
                of_word = [codes.setdefault(stems.get(w) or stems.setdefault(w, stem_word(w)), len(codes)) for w in coded.dictionary.to_pylist()]
                term = np.array(of_word, np.int64)[coded.indices.to_numpy()]
                doc = np.repeat(np.arange(len(own)), own)
                pos = np.arange(total) - np.repeat(ends[start:stop] - own - begun, own)
                key = doc * len(codes) + term
                order = np.argsort(key, kind="stable")
                key = key[order]
                firsts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                bounds = np.append(firsts, total)
                at, term = doc[order[firsts]], term[order[firsts]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(codes), pa.string()).take(pa.array(term)), ids.take(pa.array(start + at)),
                        pa.array(np.diff(bounds).astype(np.int32)), pa.array(own[at].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(pos[order].astype(np.int32))),
                    ],
                    ["term", "doc_id", "tf", "dl", "positions"],
                )
            start = stop


def build(documents: DataFrame, body: str = "body") -> Index:
    """The index of documents. Ids are counted first: only where one occurs more than once, its rows' postings are put together, by a shuffle."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), kept_words_column(F.col(body)).alias("words"))
    postings = rows.mapInArrow(_grouped, POSTINGS)
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        postings = postings.groupBy("term", "doc_id").agg(
            F.sum("tf").cast("int").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
        )
    return Index(postings, doc_stats(documents, body))


def stats(index: Index) -> DataFrame:
    """One row: documents, unique_terms, total_postings, avg_doc_length."""
    terms = index.terms().agg(F.count("*").alias("unique_terms"), F.coalesce(F.sum("df"), F.lit(0)).cast("long").alias("total_postings"))
    corpus = index.corpus_stats().select(F.col("n").alias("documents"), F.col("avgdl").alias("avg_doc_length"))
    return corpus.crossJoin(F.broadcast(terms)).select("documents", "unique_terms", "total_postings", "avg_doc_length")  # two single rows


def merge(old: Index, new: Index) -> Index:
    """Append new documents; ids that the old index has are left out."""
    fresh = new.doc_stats.join(old.doc_stats.select("doc_id"), "doc_id", "left_anti")
    postings = new.postings.join(old.doc_stats.select("doc_id"), "doc_id", "left_anti")
    return Index(old.postings.unionByName(postings), old.doc_stats.unionByName(fresh))
