"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. A lexicon is mined from labelled rows: all words and word beginnings that toxic rows have far more
   often than clean ones. Those in ``VOTER_SHARE`` of toxic rows or more, and patterns over all
   entries, are the voters; a voter says toxic, clean or nothing for a document.
2. The label model is a latent two-class mixture, fitted by expectation maximisation without
   labels as targets: how often each voter says what in either class (accuracy and coverage), and
   how votes go together within a class (correlation). A voter's evidence is divided by the
   number of voters it repeats. The given label is one more voter, so its noise is estimated too.
3. A logistic regression over all lexicon entries and a few counts is fitted to the posteriors.
   It alone scores documents, from the text only.

Fitting reads at most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled rows, those with the smallest hash of
the id; rows whose crc32(doc_id) mod 3 is 1 are never read for it. Scoring reads every whole text.

Defined results: null and empty texts get the score of a text without findings; an id's repeated
labels count by majority (a tie is toxic); labels that are null, or lack a document, are ignored;
without labels of both classes every score is 0.5; a null id is not held out; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, packed, ship, stage

ship(__name__)

MAX_TOXIC = 8_000
MAX_CLEAN = 16_000
VOTER_SHARE = 0.02
BEGINNINGS = (4, 5, 6)
MIN_TOXIC_ROWS = 3
MIN_LOG_ODDS = 2.0
PREDICT_AT = 0.7
CACHE_WORDS = 150_000
TOKEN = re.compile(r"\w+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
COUNTS = ("hits", "density", "shouting", "exclaims", "repeats")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def entries_of(word: str) -> tuple[int, ...]:
    """Ids of a word and of its beginnings."""
    found = [zlib.crc32(b"w" + word.encode("utf-8", "replace"))]
    found += [zlib.crc32(b"b" + word[:n].encode("utf-8", "replace")) for n in BEGINNINGS if len(word) > n]
    return tuple(found)


class Reader:
    """Words of texts as ids of lexicon entries; known words are kept, up to a bound."""

    def __init__(self, only: dict[int, int] | None = None):
        self.only = only
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = entries_of(word)
            if self.only is not None:
                found = tuple(self.only[x] for x in found if x in self.only)
            self.known[word] = found
        return found

    def read(self, text: str | None) -> tuple[set[int], np.ndarray]:
        """Entries in the text; number of its words with any, and the pattern counts, in the order of COUNTS."""
        text = text or ""
        words = TOKEN.findall(text.lower())
        kinds = set(words)
        word, entries, hits = self.word, set(), 0
        for w in kinds:
            if found := word(w):
                hits += 1
                entries.update(found)
        n = max(1, len(words))
        letters = len(UPPER.findall(text))
        return entries, np.array([hits, hits / n, letters / max(1, len(text)), text.count("!") / n, 1 - len(kinds) / n])


@dataclass
class Model:
    entries: dict[int, int] = field(default_factory=dict)  # id -> place
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(4))
    bias: float = 0.0

    def score(self, entries: set[int], counts: np.ndarray) -> float:
        z = self.bias + float(self.counts @ shape(counts))
        z += float(self.weights[list(entries)].sum()) if entries else 0.0
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def shape(counts: np.ndarray) -> np.ndarray:
    """Classifier inputs of the pattern counts: any finding, their number, their density, shouting."""
    hits, density, shouting, exclaims, _ = np.moveaxis(np.atleast_2d(counts), -1, 0)
    out = np.stack([(hits > 0) * 1.0, np.log1p(hits), np.minimum(1.0, 20 * density), np.minimum(1.0, shouting + exclaims)], -1)
    return out[0] if np.ndim(counts) == 1 else out


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of a bounded sample by hash, without held-out rows. Only ids and labels are sorted."""
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    )
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    key = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(key, "doc_id").limit(MAX_TOXIC).unionAll(known.where("toxic = 0").orderBy(key, "doc_id").limit(MAX_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(stage(picked, "labelled")), "doc_id")  # bounded: MAX_TOXIC + MAX_CLEAN rows of 12 bytes


def mine(sample: DataFrame) -> tuple[list[int], int, pd.DataFrame]:
    """The lexicon (ids, the most frequent in toxic rows first), how many of them vote, and, per row of the sample, its entries by place and its counts."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                yield pd.DataFrame({"toxic": part["toxic"], "text": part["text"], "entries": [sorted(reader.read(t)[0]) for t in part["text"]]})

    rows = stage(sample.select("toxic", "text").mapInPandas(words, "toxic int, text string, entries array<long>"), "words")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return [], 0, pd.DataFrame()
    seen = rows.select("toxic", F.explode("entries").alias("entry")).groupBy("entry").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.1) / size[1]) - F.log((F.col("good") + 0.5) / size[0])
    least = min(MIN_TOXIC_ROWS, max(1, size[1] // 10))
    best = seen.where(F.col("bad") >= least).withColumn("odds", odds).where(F.col("odds") >= MIN_LOG_ODDS)
    found = best.orderBy(F.col("bad").desc(), "entry").select("entry", "bad").collect()  # entries of the bounded sample
    lexicon = [r["entry"] for r in found]
    voters = sum(r["bad"] >= VOTER_SHARE * size[1] for r in found)
    place = {x: i for i, x in enumerate(lexicon)}

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(place)
        for batch in batches:
            read = [reader.read(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "entries": [sorted(e) for e, _ in read], "counts": [list(map(float, c)) for _, c in read]})

    found = rows.select("toxic", "text").mapInPandas(hits, "toxic int, entries array<int>, counts array<double>")
    return lexicon, voters, found.toPandas()  # bounded: the labelled sample


def votes_of(rows: pd.DataFrame, lexical: int) -> np.ndarray:
    """Votes of rows by voters, the first entries of the lexicon and the patterns: 1 toxic, -1 clean, 0 nothing."""
    n = len(rows)
    counts = np.array(rows["counts"].tolist()).reshape(n, len(COUNTS))
    votes = np.zeros((n, lexical + 8), np.int8)
    for i, entries in enumerate(rows["entries"]):
        own = np.asarray(entries, np.int64)
        votes[i, own[own < lexical]] = 1
    hits, density, shouting, exclaims, repeats = counts.T
    patterns = [
        np.where(hits >= 2, 1, 0),
        np.where(hits >= 3, 1, np.where(hits == 0, -1, 0)),
        np.where(density >= 0.02, 1, np.where(density < 0.001, -1, 0)),
        np.where(hits == 1, 1, 0),
        np.where(hits == 0, -1, 0),
        np.where(shouting > 0.5, 1, 0),
        np.where(exclaims > 0.3, 1, 0),
        np.where(repeats > 0.9, -1, 0),
    ]
    votes[:, lexical:] = np.stack(patterns, 1)
    return votes


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of class toxic for every row. labels: 0/1, used as one more voter."""
    votes = np.concatenate([votes, (2 * labels - 1).astype(np.int8)[:, None]], 1)
    sides = [(votes == side).astype(np.float32) for side in (-1, 0, 1)]
    # start: the balance of votes, the label among them
    balance = votes.astype(np.float32).sum(1) + 3 * (2 * labels - 1)
    post = 1 / (1 + np.exp(-np.clip(balance, -20, 20)))
    for _ in range(rounds):
        both = np.stack([1 - post, post])
        mass = both.sum(1)
        prior = np.clip(mass / mass.sum(), 1e-4, 1)
        says = np.stack([both @ s for s in sides], -1) + 0.2  # class, voter, side
        says /= says.sum(-1, keepdims=True)
        # correlation of votes within a class: residuals after the class mean
        agree = np.zeros((votes.shape[1],) * 2, np.float64)
        for c in range(2):
            mean = (both[c] @ votes) / max(1e-6, mass[c])
            left = (votes - mean) * np.sqrt(both[c])[:, None]
            cov = left.T @ left / max(1e-6, mass[c])
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            agree = np.maximum(agree, np.abs(cov / spread[:, None] / spread[None, :]))
        np.fill_diagonal(agree, 1)
        repeated = np.where(agree >= 0.3, agree, 0).sum(1)
        evidence = np.log(says[1]) - np.log(says[0])  # voter, side
        z = math.log(prior[1] / prior[0]) + sum(s @ (evidence[:, k] / repeated) for k, s in enumerate(sides))
        fresh = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(fresh - post).max() < 1e-4:
            return fresh
        post = fresh
    return post


def fit_linear(rows: pd.DataFrame, size: int, post: np.ndarray, rounds: int = 400) -> Model:
    """Logistic regression on the posteriors, both classes with equal weight in all; Adam on the whole sample."""
    n = len(rows)
    lengths = rows["entries"].map(len).to_numpy()
    at = np.repeat(np.arange(n), lengths)
    col = np.concatenate([np.asarray(e, np.int64) for e in rows["entries"]]) if lengths.sum() else np.zeros(0, np.int64)
    dense = shape(np.array(rows["counts"].tolist()).reshape(n, len(COUNTS)))
    weight = post / max(1e-6, post.sum()) + (1 - post) / max(1e-6, (1 - post).sum())
    weight /= weight.sum()
    theta = np.zeros(size + dense.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = theta[-1] + dense @ theta[size:-1] + np.bincount(at, theta[col], n)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - post)
        grad = np.concatenate([np.bincount(col, error[at], size)[:size], error @ dense, [error.sum()]])
        grad[:-1] += 1e-5 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(weights=theta[:size], counts=theta[size:-1], bias=float(theta[-1]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    lexicon, voters, rows = mine(labelled_sample(docs, labels))
    if not len(rows):
        return Model()
    post = label_model(votes_of(rows, voters), rows["toxic"].to_numpy())
    model = fit_linear(rows, len(lexicon), post)
    model.entries = {x: i for i, x in enumerate(lexicon)}
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, and any other columns) with score added."""
    plain = {"entries": model.entries, "weights": model.weights.tolist(), "counts": model.counts.tolist(), "bias": model.bias}

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(plain["entries"], np.array(plain["weights"]), np.array(plain["counts"]), plain["bias"])
        reader = Reader(own.entries)
        for part in texts:
            yield pd.Series([own.score(*reader.read(t)) for t in part], dtype="float64")

    return docs.withColumn("score", scored("text"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); labels has doc_id, toxic."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with the same columns."""
    need(docs, "doc_id", "text")
    rows = score(docs.select(packed(docs).alias("doc"), "text"), fit(docs, labels))
    return rows.where(F.col("score") < PREDICT_AT).select("doc.*")
