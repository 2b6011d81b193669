"""Line dedup by pairwise alignment.

1. Texts are reduced to arrays of line hashes; equal texts are one, held by the smallest id.
2. A line of ``MIN_BLOCK_WORDS`` words or more that several texts share pairs each later text with
   the first that has the line. So does a run of lines, the shortest that has enough words forwards
   or backwards from a line: thus a text meets the first holder of a whole block, also where each
   line of the block first stood elsewhere, and every line of a block is in such a run. A line or
   run in n texts gives n - 1 pairs, not n(n-1)/2. Rare lines need no other rule, and frequent ones
   no bound: a block counts however many texts have it, in a corpus of any size.
3. Each overlapping pair is aligned by patience diff over line hashes: lines that are unique on
   both sides, in the longest increasing order, anchor the alignment; the gaps are aligned alike.
   An alignment keeps one order, so blocks that moved, or that stand more than once, are aligned
   after it, each by itself.
4. Runs of aligned lines that have ``MIN_BLOCK_WORDS`` words or more are deleted from the later
   document, the one with the larger id. A copy of an earlier text loses all lines.

Only hashes and ids move until the deletions are known; then each text moves once to meet them.

Defined results: lines are compared without white space at either end; a null text stays null;
rows that share both id and text are one document; null ids come last; an empty table gives an
empty result; extra columns are kept by ``deduplicated`` and ignored by ``dedup_lines``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, id_or_last, need, packed, ship, stage, text_key

ship(__name__)

MIN_BLOCK_WORDS = 8
FACTOR = 0x9E3779B97F4A7C15


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, with increasing second (patience piles)."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[pile], ends[pile] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b) of equal lines, in order, by patience diff."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        here: dict[int, int] = {}
        for i in range(a0, a1):
            here[a[i]] = -1 if a[i] in here else i
        there: dict[int, int] = {}
        for j in range(b0, b1):
            there[b[j]] = -1 if b[j] in there else j
        unique = [(i, there[x]) for x, i in here.items() if i >= 0 and there.get(x, -1) >= 0]
        i0, j0 = a0, b0
        anchors = _increasing(sorted(unique))
        for i, j in anchors:
            todo.append((i0, i, j0, j))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        if anchors:
            todo.append((i0, a1, j0, b1))
    return sorted(out)


def common_blocks(pairs: list[tuple[int, int]], words: list[int], least: int) -> list[int]:
    """Places in b of aligned runs that have enough words."""
    out: list[int] = []
    run: list[int] = []
    for n, (i, j) in enumerate(pairs):
        run.append(j)
        if n + 1 == len(pairs) or pairs[n + 1] != (i + 1, j + 1):
            if sum(words[x] for x in run) >= least:
                out += run
            run = []
    return out


def moved_blocks(a: list[int], b: list[int], words: list[int], least: int, gone: set[int]) -> set[int]:
    """Places in b, besides those gone, of runs that stand anywhere in a and have enough words; runs are followed forwards, then backwards."""
    out: set[int] = set()
    for step in (1, -1):
        first: dict[int, int] = {}
        for i in range(len(a))[::-step]:
            first[a[i]] = i
        run, total, before = [], 0, None
        for j in [*range(len(b))[::step], None]:
            i = None
            if j is not None and j not in gone:
                i = before + step if before is not None and 0 <= before + step < len(a) and a[before + step] == b[j] else first.get(b[j])
            if run and (i is None or i != before + step):
                if total >= least:
                    out.update(run)
                run, total = [], 0
            if i is not None:
                run.append(j)
                total += words[j]
            before = i
    return out


def shared_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[int]:
    """Places in b of all blocks that it has in common with a."""
    gone = set(common_blocks(align(a, b), words, least))
    held = set(a)
    if any(x in held for j, x in enumerate(b) if j not in gone):
        gone |= moved_blocks(a, b, words, least, gone)
    return sorted(gone)


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, hashes, words): a row for each id and text; null ids are LAST_ID, null texts are left out."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return (
        docs.where("text IS NOT NULL")
        .select(id_or_last(F.col("doc_id")).alias("doc_id"), text_key(F.col("text")).alias("key"), lines.alias("_l"))
        .select(
            "doc_id", "key",
            F.transform("_l", lambda x: F.xxhash64(x)).alias("hashes"),
            F.transform("_l", lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"),
        )
    )


def line_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n: lines) of the rows of ``line_table``."""
    return docs.where("text IS NOT NULL").select(id_or_last(F.col("doc_id")).alias("doc_id"), text_key(F.col("text")).alias("key"), F.size(F.split("text", "\n", -1)).alias("n"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the shortest runs of lines, forwards and backwards from each line, that have enough words; runs of one line too."""
    n, at = len(hashes), np.arange(len(hashes))
    total = np.concatenate([[0], np.cumsum(words)])
    first = np.concatenate([at, np.searchsorted(total, total[1:] - least, side="right") - 1])
    last = np.concatenate([np.searchsorted(total, total[:-1] + least) - 1, at])
    fits = (first >= 0) & (last < n)
    first, last = np.divmod(np.unique(first[fits] * (n + 1) + last[fits]), n + 1)
    # sums of line hashes times powers of an odd number, divided by the power of the run's start
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, FACTOR, np.uint64)]))
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(FACTOR, -1, 1 << 64), np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes.view(np.uint64)) * power[:-1])])
    value = (sums[last + 1] - sums[first]) * back[first]
    return np.unique(_mix(value ^ (last - first).astype(np.uint64)).view(np.int64))


def runs(texts: DataFrame, least: int) -> DataFrame:
    """(doc_id, run): the hashes of each text's runs of lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [run_hashes(h, w, least) for h, w in zip(batch["hashes"], batch["words"])]
            yield pd.DataFrame({"doc_id": np.repeat(batch["doc_id"].to_numpy(), [len(h) for h in found]), "run": np.concatenate([np.zeros(0, np.int64), *found])})

    return texts.select("doc_id", "hashes", "words").mapInPandas(run, "doc_id long, run long")


def overlaps(texts: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(early, late) of overlapping texts (doc_id, hashes, words): each text with the first holder of each of its runs."""
    shared = stage(runs(texts, least), "runs")
    firsts = shared.groupBy("run").agg(F.count("*").alias("texts"), F.min("doc_id").alias("early")).where("texts > 1").select("run", "early")
    firsts = stage(firsts, "firsts")  # read from a table, so that Spark may split a hot run in the join
    return shared.join(firsts, "run").where("doc_id > early").select("early", F.col("doc_id").alias("late")).distinct()


def deletions(docs: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc_id, key, gone: array of booleans by line) of documents that lose lines."""
    texts = stage(
        line_table(docs).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("hashes").alias("hashes"), F.first("words").alias("words")), "texts"
    )
    pairs = overlaps(texts, least)
    early = texts.select(F.col("doc_id").alias("early"), F.col("hashes").alias("a"))
    late = texts.select(F.col("doc_id").alias("late"), F.col("key"), F.col("hashes").alias("b"), "words")
    met = pairs.join(early, "early").join(late, "late").select("late", "key", "a", "b", "words")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for a, b, words in zip(batch["a"], batch["b"], batch["words"]):
                gone = shared_blocks(a.tolist(), b.tolist(), words.tolist(), least)
                found.append(gone)
            yield pd.DataFrame({"key": batch["key"], "late": batch["late"], "size": [len(b) for b in batch["b"]], "gone": found})

    marks = met.mapInPandas(run, "key binary, late long, size int, gone array<int>").where("size(gone) > 0")
    marks = marks.groupBy("late", "key", "size").agg(F.collect_list("gone").alias("gone"))

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for size, gone in zip(batch["size"], batch["gone"]):
                flags = np.zeros(size, bool)
                for part in gone:
                    flags[np.asarray(part, np.int64)] = True
                out.append(flags)
            yield pd.DataFrame({"doc_id": batch["late"], "key": batch["key"], "gone": out})

    own = marks.mapInPandas(mask, "doc_id long, key binary, gone array<boolean>")
    copies = (
        line_counts(docs).distinct()
        .join(texts.select("key", F.col("doc_id").alias("home")), "key").where("doc_id > home")
        .select("doc_id", "key", F.array_repeat(F.lit(True), F.col("n")).alias("gone"))
    )
    return own.unionAll(copies)


def _met(docs: DataFrame, least: int) -> DataFrame:
    """(doc: the row, gone) of every row of docs. A row has its text once, in doc: what moves and is sorted here is most of the stage's memory."""
    marks = deletions(docs.select("doc_id", "text"), least).toDF("at", "mark", "gone")
    rows = docs.select(packed(docs).alias("doc"), id_or_last(F.col("doc_id")).alias("own_at"), text_key(F.col("text")).alias("own_key"))
    return rows.join(marks, (F.col("own_at") == F.col("at")) & (F.col("own_key") == F.col("mark")), "left").select("doc", "gone")


def _kept():
    lines = F.split("doc.text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.get(F.col("gone"), i)), "\n")
    return F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(kept)


def dedup_lines(docs: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """doc_id, text without deleted lines, n_lines (before), n_removed of every row of docs (doc_id, text)."""
    need(docs, "doc_id", "text")
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.filter(F.col("gone"), lambda x: x)))
    n_lines = F.when(F.col("doc.text").isNull(), F.lit(0)).otherwise(F.size(F.split("doc.text", "\n", -1)))
    return _met(docs.select("doc_id", "text"), least).select("doc.doc_id", _kept().alias("text"), n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))


def deduplicated(docs: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """docs with deleted lines gone from text and n_chars set anew; documents that lose all their words this way are dropped."""
    need(docs, "doc_id", "text")
    rows = _met(docs, least).withColumn("left", _kept())
    empty = F.col("gone").isNotNull() & (F.regexp_count("left", F.lit(WORD)) == 0) & (F.regexp_count("doc.text", F.lit(WORD)) > 0)
    rows = rows.where(~F.coalesce(empty, F.lit(False)))
    doc = F.col("doc").withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("gone").isNull(), F.col("doc.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
        doc = doc.withField("n_chars", n_chars)
    return rows.select(doc.alias("doc")).select("doc.*")
