"""Fuzzy matching and spelling over the index's vocabulary.

Distances are optimal string alignment: insertions, deletions, substitutions and swaps of
neighbours, no part edited twice. Two words within two edits have in common what is left of either
when up to two characters are deleted. A stored index has these variants of all its terms as a
table sorted by hash, so a word's neighbours are found by equality; a vocabulary alone is scanned
with Spark's bounded ``levenshtein``, at twice the distance, as a swap is two edits for it. Only what
is left is measured exactly, in Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.functions.text import MOST_DELETED, deletions, stem_word, tokenize_text
from lexigraph.operators.index import Index
from lexigraph.operators.ranking import BM25Config, search

cloudpickle.register_pickle_by_value(sys.modules[__name__])
MAX_DISTANCE = 2
#: A list of words up to this long is broadcast; the bound is checked when the list is made.
MAX_WORDS = 100_000


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance, by characters."""
    older, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        older, last = last, row
    return last[-1]


def osa_column(a: str, b: str):
    """The distance of two string columns; Python gets them in batches."""

    @F.pandas_udf("int")
    def measured(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa(p, q) for p, q in zip(x, y)], dtype="int32")

    return measured(F.col(a), F.col(b))


def _few(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    """(word) of a list whose length is checked."""
    words = list(dict.fromkeys(words))
    if len(words) > MAX_WORDS:
        raise ValueError(f"over {MAX_WORDS} words in one lookup")
    return spark.createDataFrame([(w,) for w in words], "word string")


def levenshtein_terms(vocabulary: DataFrame, words: Sequence[str], most: int = MAX_DISTANCE) -> DataFrame:
    """(word, term, dist) within a plain Levenshtein distance, all in the engine; the words are few and broadcast."""
    asked = F.broadcast(_few(vocabulary.sparkSession, words))
    dist = F.levenshtein("word", "term", most)
    return vocabulary.select("term").join(asked, (F.abs(F.length("word") - F.length("term")) <= most) & (dist >= 0)).select("word", "term", dist.alias("dist"))


def near_terms(vocabulary: DataFrame | Index, words: Sequence[str], most: int = MAX_DISTANCE, byte_prune: bool = False) -> DataFrame:
    """(word, term, dist) for terms of a vocabulary (term) or index within most of a word; the words are few and broadcast.

    byte_prune: leave out pairs whose lengths in bytes differ by more than most.
    """
    stored = vocabulary.stored_deletions if isinstance(vocabulary, Index) else None
    terms = vocabulary.terms() if isinstance(vocabulary, Index) else vocabulary
    asked = _few(terms.sparkSession, words)
    near = F.abs(F.length("word") - F.length("term")) <= most
    if byte_prune:
        near = near & (F.abs(F.octet_length("word") - F.octet_length("term")) <= most)
    if stored is not None and most <= MOST_DELETED:
        pairs = stored.join(F.broadcast(deletions(asked, "word")), "variant").where(near).select("word", "term").distinct()
    else:
        pairs = terms.select("term").join(F.broadcast(asked), near & (F.levenshtein("word", "term", 2 * most) >= 0))
    return pairs.withColumn("dist", osa_column("word", "term")).where(F.col("dist") <= most).select("word", "term", "dist")


def fuzzy_terms(vocabulary: DataFrame | Index, words: Sequence[str], most: int = MAX_DISTANCE) -> DataFrame:
    """(word, term, dist): for each word, stemmed once more, the other terms within most."""
    stems = {}
    for w in words:
        stems.setdefault(stem_word(w), []).append(w)
    found = near_terms(vocabulary, list(stems), most, byte_prune=True).where("dist > 0")
    origin = F.create_map(*[F.lit(x) for s, ws in stems.items() for x in (s, "\x00".join(dict.fromkeys(ws)))]) if stems else F.lit(None)
    return found.withColumn("word", F.explode(F.split(F.element_at(origin, F.col("word")), "\x00")))


@dataclass
class FuzzyResult:
    results: DataFrame
    corrections: list[tuple[str, str, int]]
    expanded: list[str]


def fuzzy_search(index: Index, query: str, k: int = 50, most: int = MAX_DISTANCE, config: BM25Config = BM25Config()) -> FuzzyResult:
    """Search for the query's terms and all terms near them, equally weighted. Expansions of a few words are collected."""
    terms = tokenize_text(query)
    if not terms:
        return FuzzyResult(search(index, "", k, config), [], [])
    known = {r["term"] for r in index.terms().where(F.col("term").isin(terms)).select("term").collect()}
    near: dict[str, list[tuple[int, str]]] = {}
    for r in fuzzy_terms(index, terms, most).collect():
        near.setdefault(r["word"], []).append((r["dist"], r["term"]))
    expanded: list[str] = []
    corrections = []
    for term in terms:
        expanded.append(term)
        for dist, other in sorted(near.get(term, [])):
            if other not in expanded:
                expanded.append(other)
            if term not in known or dist == 1:
                corrections.append((term, other, dist))
    return FuzzyResult(search(index, " ".join(expanded), k, config), corrections, expanded)


def suggest(vocabulary: DataFrame | Index, words: Sequence[str], most: int = MAX_DISTANCE, n: int = 5) -> DataFrame:
    """(word, rank, term, dist): the n nearest other terms of each word, ties by term."""
    near = near_terms(vocabulary, words, most).where("dist > 0")
    rank = F.row_number().over(Window.partitionBy("word").orderBy("dist", "term"))
    return near.withColumn("rank", rank).where(F.col("rank") <= n).select("word", "rank", "term", "dist")


def suggest_term(vocabulary: DataFrame | Index, word: str, most: int = MAX_DISTANCE) -> DataFrame:
    return suggest(vocabulary, [stem_word(word.lower())], most)


def correct_query(vocabulary: DataFrame | Index, query: str) -> str | None:
    """The query with words that are not in the vocabulary replaced by the nearest term; None if no word was."""
    words = [w for w in query.split() if len(w.encode()) > 1]
    stems = [stem_word(w.lower()) for w in words]
    if not words:
        return None
    terms = vocabulary.terms() if isinstance(vocabulary, Index) else vocabulary
    known = {r["term"] for r in terms.where(F.col("term").isin(stems)).select("term").collect()}
    missing = [s for s in dict.fromkeys(stems) if s not in known]
    best = {r["word"]: r["term"] for r in suggest(vocabulary, missing, MAX_DISTANCE, 1).collect()} if missing else {}
    if not best:
        return None
    return " ".join(w if s in known else best.get(s, w) for w, s in zip(words, stems))


def suggestion_text(term: str, dist: int) -> str:
    return f"{term} (edit distance: {dist})"


def correction_text(corrected: str) -> str:
    return f'Did you mean: "{corrected}"?'
