"""Substring dedup by sliding sentence spans.

Texts are cut into sentences: after . ! ? (and their full-width forms) before white space, and at
line ends. From every sentence a span of consecutive sentences runs forwards, and another one
backwards, until it has at least ``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words; one sentence
of ``LONE_WORDS`` words or more is a span of its own, and so is every whole text. Any longer run is
covered by spans inside it, so this removes what comparing every run of sentences would. Spans are
compared by 96 bits of hashes of their words (case and white space aside) over all documents; the
first of a hash, by doc_id and place, stays, and every sentence that any other span of the hash
covers is removed with the white space that follows it.

Spans are met in chunks of ``CHUNK`` first. Within a chunk only the first place of a hash may be the
first of all, and it alone moves; the others are removed whatever the other chunks hold. So a span moves
once at most, and a passage in a third of all documents is one row a chunk. The text moves once, to meet
its removed places.

Defined results: a null text stays null and an empty one empty; a text that is repeated whole
becomes empty in the later documents; rows that share both id and text are one document and get
the same result; null ids come last; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_last, need, ship, stage

ship(__name__)

MIN_SENTENCES = 2
MIN_WORDS = 20
LONE_WORDS = 40
#: Spans that a Python worker holds at once, some 100 bytes each with what orders them; those of one very long text may be more.
CHUNK = 500_000
BREAK = re.compile(r"(?<=[.!?。！？])\s+|\s*\n\s*")
FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence and the break after it; they cover the whole text."""
    cuts = [m.end() for m in BREAK.finditer(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    return list(zip([0, *cuts[:-1]], cuts)) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(text: str, min_sentences: int, min_words: int, lone_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, a second hash of 32 bits, first and last sentence of every span."""
    from xxhash import xxh3_128_digest

    words = [text[a:b].lower().split() for a, b in sentences(text)]
    n = len(words)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none
    own = np.frombuffer(b"".join(xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words), ">u8").astype(np.uint64).reshape(n, 2)
    total = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    # forwards the span of sentence i ends at the first j with enough words and sentences, backwards it starts at the last such j
    at = np.arange(n)
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words) - 1, at + min_sentences - 1)
    start = np.minimum(np.searchsorted(total, total[1:] - min_words, side="right") - 1, at - min_sentences + 1)
    alone = np.diff(total) >= lone_words
    end = np.where(alone, at, end)
    first, last = np.concatenate([at, start[~alone]]), np.concatenate([end, at[~alone]])
    fits = (first >= 0) & (last < n)
    first, last = first[fits], last[fits]
    if total[-1]:
        first, last = np.append(first, 0), np.append(last, n - 1)
    first, last = np.divmod(np.unique(first * n + last), n)
    # sums of sentence hashes times powers of an odd number, divided by the power of the span's start
    out = []
    for k, factor in enumerate(FACTORS):
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, factor, np.uint64)]))
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(factor, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(own[:, k]) * power[:-1])])
        value = (sums[last + 1] - sums[first]) * back[first]
        out.append(_mix(value ^ (last - first).astype(np.uint64)).view(np.int64))
    return out[0], out[1] >> 32, first, last


def _places(hashes: np.ndarray, more: np.ndarray, ids: np.ndarray, keys: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every span of a chunk: whether a place before it, by id, key and first sentence, has its hash, and whether the same place stands here again."""
    order = np.lexsort((firsts, keys, ids, more, hashes))

    def as_before(*columns: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), bool)
        out[1:] = np.logical_and.reduce([np.diff(c[order]) == 0 for c in columns])
        return out

    alike = as_before(hashes, more)
    again = alike & as_before(ids, keys, firsts)
    moves = np.cumsum(alike & ~again)  # grows where a hash goes on at another place
    starts = np.maximum.accumulate(np.where(alike, 0, np.arange(len(order))))
    later = np.zeros(len(order), bool)
    twice = np.zeros(len(order), bool)
    later[order] = moves > moves[starts]
    twice[order] = again
    return later, twice


def spans_of(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS, chunk: int = CHUNK) -> DataFrame:
    """(hash, more, doc_id, key, first, last, later) for every span; key is a hash that tells texts of one id apart, null ids are LAST_ID.

    later: the span's chunk has an earlier place of its hash, which is 0 then. A place stands once a chunk.
    """

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        found, size = [], 0
        for batch in batches:
            for t, doc_id, key in zip(batch["text"], batch["doc_id"].to_numpy(), batch["key"].to_numpy()):
                hashes, more, first, last = span_hashes(t or "", min_sentences, min_words, lone_words)
                if size and size + len(hashes) > chunk:
                    yield found
                    found, size = [], 0
                if len(hashes):
                    found.append((hashes, more.astype(np.int32), doc_id, key, first.astype(np.int32), last.astype(np.int32)))
                    size += len(hashes)
        if found:
            yield found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in held(batches):
            sizes = [len(x[0]) for x in found]
            hashes, more, ids, keys, first, last = (np.concatenate(x) if k not in (2, 3) else np.repeat(np.array(x, np.int64), sizes) for k, x in enumerate(zip(*found)))
            later, twice = _places(hashes, more, ids, keys, first)
            hashes[later], more[later] = 0, 0
            rows = np.flatnonzero(~twice)
            for at in range(0, len(rows), 50_000):
                r = rows[at : at + 50_000]
                yield pd.DataFrame({"hash": hashes[r], "more": more[r], "doc_id": ids[r], "key": keys[r], "first": first[r], "last": last[r], "later": later[r]})

    source = docs.select(id_or_last(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return source.mapInPandas(run, "hash long, more int, doc_id long, key long, first int, last int, later boolean")


def repeats_of(spans: DataFrame) -> DataFrame:
    """(doc_id, key, covered: ranges of sentences) of documents with a span that is not the first of its hash."""
    places = Window.partitionBy("hash", "more").orderBy("doc_id", "key", "first")  # a row for each chunk at most
    met = spans.where("NOT later").select("*", F.rank().over(places).alias("rank")).where("rank > 1")
    repeated = spans.where("later").unionByName(met.drop("rank"))
    return repeated.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("covered"))


def keep(text: str, covered: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without covered sentences, and how many these were."""
    parts = sentences(text)
    gone = np.zeros(len(parts) + 1, np.int64)
    for first, last in covered:
        gone[first] += 1
        gone[last + 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    return "".join(text[a:b] for (a, b), out in zip(parts, gone) if not out).rstrip(), int(gone.sum())


def without_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    """doc_id, text without repeated sentences, n_removed of every row of docs (doc_id, text)."""
    need(docs, "doc_id", "text")
    spans = stage(spans_of(docs, min_sentences, min_words, lone_words), "spans")
    marks = repeats_of(spans).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = source.join(marks, (id_or_last(F.col("doc_id")) == F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left").select("doc_id", "text", "covered")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [(t, 0) if c is None or t is None else keep(t, [(r["first"], r["last"]) for r in c]) for t, c in zip(batch["text"], batch["covered"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": pd.Series([t for t, _ in done], dtype=object), "n_removed": np.array([n for _, n in done], np.int64)})

    return met.mapInPandas(run, "doc_id long, text string, n_removed long")
