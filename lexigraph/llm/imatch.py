"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon is the band of terms whose inverse document frequency lies between two bounds: terms
in ``RARE`` to ``COMMON`` of all documents, counted over the whole table. A document cannot have
more terms than it has, so the band has at most (distinct terms per document) / RARE terms at any
size of the table: a million where documents have 300 terms. The tasks get these terms as a sorted
array of 64-bit hashes, 8 bytes a term.

Each of ``SUBSETS`` random lexicons orders the terms by a pseudo-random number; its subset at level
l keeps terms whose number is in the lowest 2^-l. A text with n terms of the band is hashed at the
levels around log2(n), where a subset keeps about one of its terms or two: its distinct terms are
sorted (by their hashes) and those in the subset hashed. So a fingerprint says how many terms, to a factor of two,
then has one hash for each level and subset, or dashes if the text has no term there. The
likeness of two fingerprints is the share of equal hashes among those that either has, at levels
that both have; texts without terms of the band are fingerprinted by all their terms instead and
are like only others of that kind.

Defined results: null texts are empty, empty texts have the fingerprint "none"; texts without any
term, such as white space, too, and their likeness is 1 if both are; equal texts have equal
fingerprints; rows are taken in descending order of doc_id, null ids last, then by a hash of the
text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, ship, stage

ship(__name__)

RARE = 3e-4
COMMON = 0.02
SUBSETS = 16
LEVELS = 3
TERM = re.compile(r"\w+")
FLUSH_TERMS = 400_000
#: Text in a part of the ordered table, and parts at most; a part streams through its task, so neither bounds what a part may hold.
PART_BYTES = 64 << 20
MOST_PARTS = 100_000
SEED = 42
NULL_ID = -(1 << 63)
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def terms_of(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").lower()))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all documents; each task sums its own documents first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()

        def out():
            frame = pd.DataFrame({"term": pd.Series(list(seen.keys()), dtype=object), "n": np.fromiter(seen.values(), np.int64, len(seen))})
            seen.clear()
            return frame

        for batch in batches:
            for text in batch["text"]:
                seen.update(terms_of(text))
                if len(seen) > FLUSH_TERMS:
                    yield out()
        yield out()

    return docs.select("text").mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, total: int, rare: float = RARE, common: float = COMMON) -> np.ndarray:
    """Hashes of the band's terms, sorted."""
    band = document_frequencies(docs).where((F.col("df") >= rare * total) & (F.col("df") <= max(1.0, common * total)))
    return np.unique(band.select(F.xxhash64("term").alias("h")).toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def numbers_of(terms: set[str]) -> np.ndarray:
    """The terms' 64-bit hashes, sorted: XXH64 with the seed that Spark takes."""
    from xxhash import xxh64_intdigest

    found = np.fromiter((xxh64_intdigest(t.encode("utf-8", "surrogatepass"), SEED) for t in terms), np.uint64, len(terms))
    return np.unique(found)


def _draws(numbers: np.ndarray) -> np.ndarray:
    """Each term's number in every random lexicon: terms x SUBSETS of 32 bits."""
    seeds = np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = numbers[:, None] ^ seeds[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


class Printer:
    """Fingerprints of texts by one lexicon, a sorted array of hashes."""

    def __init__(self, band: np.ndarray):
        self.band = band

    def fingerprint(self, text: str) -> str:
        numbers = numbers_of(terms_of(text))
        if not len(numbers):
            return "none"
        kind = "a"
        if len(self.band):
            at = np.minimum(np.searchsorted(self.band, numbers), len(self.band) - 1)
            own = numbers[self.band[at] == numbers]
            if len(own):
                kind, numbers = "i", own
        return f"{kind}{len(numbers).bit_length() - 1:02d}:" + hashes_of(numbers, _draws(numbers))


def hashes_of(numbers: np.ndarray, draws: np.ndarray) -> str:
    """Hashes of the sorted terms in each subset, level by level, eight digits each."""
    from xxhash import xxh32_intdigest

    base = len(numbers).bit_length() - 1
    out = []
    for level in range(base, base + LEVELS):
        inside = draws < np.uint32(0xFFFFFFFF >> level)
        # column by column, the rows (in term order) that are inside
        column, row = np.nonzero(inside.T)
        ends = np.searchsorted(column, np.arange(SUBSETS + 1))
        kept = numbers[row]
        for j in range(SUBSETS):
            a, b = ends[j], ends[j + 1]
            out.append(f"{xxh32_intdigest(kept[a:b].tobytes()):08x}" if b > a else "--------")
    return "".join(out)


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among those that either fingerprint has, at common levels; 0 to 1."""
    if a == b:
        return 1.0
    if "none" in (a, b) or a[0] != b[0]:
        return 0.0
    start = max(int(a[1:3]), int(b[1:3]))
    width = 8 * SUBSETS
    x, y = a[4 + width * (start - int(a[1:3])) :], b[4 + width * (start - int(b[1:3])) :]
    same = any_ = 0
    for i in range(0, min(len(x), len(y)), 8):
        p, q = x[i : i + 8], y[i : i + 8]
        if p[0] != "-" or q[0] != "-":
            any_ += 1
            same += p == q
    return same / any_ if any_ else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class Parts:
    """Ranges of rows in ascending order of id, then descending order of tie (a hash). An id with several parts' rows is split by its ties."""

    def __init__(self, cuts: list[int]):
        heavy = {c: n for c, n in Counter(cuts).items() if n > 1}  # a cut that comes n times: one id has the rows of n - 1 parts or more
        self.edges = np.array(sorted({*cuts, *(c + 1 for c in heavy if c < (1 << 63) - 1)}), np.int64)
        size = np.ones(len(self.edges) + 1, np.int64)
        for c, n in heavy.items():
            size[np.searchsorted(self.edges, c, side="right")] = n
        self.size, self.start = size, np.concatenate([[0], np.cumsum(size)[:-1]])
        self.count = int(size.sum())

    def of(self, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        bucket = np.searchsorted(self.edges, ids, side="right")
        n = self.size[bucket]
        below = ((ties.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)).astype(np.int64) * n >> 32
        return (self.start[bucket] + n - 1 - below).astype(np.int32)


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("tie"), *more)


def _parts(keys: DataFrame, wanted: int) -> tuple[Parts, dict[int, tuple[int, int]]]:
    """Parts of about equal numbers of rows, and the first row (id, tie) of each part that has rows, in descending order of id."""
    shares = [i / wanted for i in range(1, wanted)]
    cuts = (keys.agg(F.percentile_approx("id", shares, max(10_000, 4 * wanted))).first()[0] or []) if shares else []
    parts = Parts(cuts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["part"] = parts.of(batch["id"].to_numpy(np.int64), batch["tie"].to_numpy(np.int64))
            yield batch.sort_values(["id", "tie"], ascending=[False, True]).drop_duplicates("part")

    firsts = keys.mapInPandas(run, "id long, tie long, part int").groupBy("part").agg(F.max_by(F.struct("id", "tie"), F.struct("id", -F.col("tie").cast("decimal(20,0)"))).alias("first"))
    return parts, {r["part"]: tuple(r["first"]) for r in firsts.collect()}  # a row for each part


def in_order(docs: DataFrame, wanted: int) -> DataFrame:
    """(part, edge, id, tie, packed text) with each part's rows in descending order of id, then by tie.

    A part ends with an edge row: the first row of the next part, which its last row needs.
    Texts are compressed before they move, each part to a task of its own.
    """
    parts, firsts = _parts(stage(_keyed(docs), "order"), wanted)
    filled = sorted(firsts)
    # a part's first row is also wanted by the next part above; the first of all by the lowest part
    wanting = {firsts[p]: (filled[n + 1] if n + 1 < len(filled) else filled[0]) for n, p in enumerate(filled)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids, ties = batch["id"].to_numpy(np.int64), batch["tie"].to_numpy(np.int64)
            packed = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]]
            frame = pd.DataFrame({"part": parts.of(ids, ties), "edge": np.zeros(len(ids), np.int32), "id": ids, "tie": ties, "packed": packed})
            at = [(n, wanting[k]) for n, k in enumerate(zip(ids.tolist(), ties.tolist())) if k in wanting]
            again = frame.iloc[[n for n, _ in at]].copy()
            again["edge"], again["part"] = np.int32(1), np.array([p for _, p in at], np.int32)
            yield pd.concat([frame, again])

    rows = _keyed(docs, "text").mapInPandas(run, "part int, edge int, id long, tie long, packed binary")
    return rows.repartitionById(max(1, parts.count), F.col("part")).sortWithinPartitions("part", "edge", F.col("id").desc(), "tie")


def fingerprints(docs: DataFrame, band: np.ndarray | None = None, parts: int | None = None) -> DataFrame:
    """Every row of docs (doc_id, text) with its own and its edited text's fingerprint; see OUT. band: sorted hashes, see ``numbers_of``."""
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    terms = lexicon(docs, total) if band is None else band
    parts = parts or min(MOST_PARTS, max(4 * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES)))
    shared = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        printer = Printer(shared.value)
        held = None  # the row that waits for its following one: part, id, text, fingerprint
        ended = None  # a part whose last row has been given its edge row

        def finish(row, text: str, own: str) -> tuple:
            _, doc_id, before, first = row
            new = edited(before, text)
            second = first if new == before else printer.fingerprint(new)
            digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            return (None if doc_id == NULL_ID else doc_id, len(before), digest, first, second, likeness(first, second), likeness(first, own))

        for batch in batches:
            rows = []
            for part, edge, doc_id, packed in zip(batch["part"], batch["edge"], batch["id"], batch["packed"]):
                if edge and ended == part:
                    continue  # another row with the edge's id
                text = unpack(packed).decode("utf-8", "surrogatepass") if len(packed) else ""
                own = printer.fingerprint(text)
                if held is not None and held[0] == part:
                    rows.append(finish(held, text, own))
                held = None if edge else (part, doc_id, text, own)
                ended = part if edge else None
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")], dtype=object)
            out = out.astype({"n_chars": "int64", "near_edited": "float64", "near_next": "float64"})
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return in_order(docs, parts).select("part", "edge", "id", "packed").mapInPandas(run, OUT)
