"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are read as two blocks of 31 bits and two single bits. The anchors are
the product of two perfect Hamming (31,26) codes and the four words of two bits: 2^54 points
whose covering radius is 2 (one bit in either block). Every fingerprint is replicated to anchors
within covering radius plus threshold, but only to those that a pair can meet at: two
fingerprints at 2 or fewer bits have a point within one bit of both, and that point's anchor gets
both. This is 33 anchors or fewer for each fingerprint, and no anchor can hold more than the
33,792 fingerprints within its reach, whatever the data. Fingerprints are compared per anchor;
equal fingerprints are one. Of the links at an anchor a spanning forest is kept, which has the
same components.

Defined results: null texts and texts without words have fingerprint zero, which links like any
other; fewer words than a shingle has are one shingle; rows of one text have one fingerprint;
component_id is the smallest non-null doc_id (null if a component has none); an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, ship, stage
from .components import components

ship(__name__)

BITS = 64
BLOCK = 31
THRESHOLD = 2
SEED = 42
BLOCK_ROWS = 4096


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of ASCII-lowered words, repeats included."""
    from itertools import repeat

    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    count = max(len(words) - width + 1, min(len(words), 1))
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, from bit 0."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK_ROWS):
        part = hashes[at : at + BLOCK_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, width: int) -> int:
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp: the 64 bits as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": found})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def _syndromes() -> np.ndarray:
    """For every 16-bit half of a block the exclusive or of the numbers 1.. of its set bits: low half, high half."""
    tables = np.zeros((2, 1 << 16), np.uint64)
    for half in range(2):
        for bit in range(16):
            number = half * 16 + bit + 1
            if number <= BLOCK:
                tables[half] ^= np.where((np.arange(1 << 16) >> bit) & 1, number, 0).astype(np.uint64)
    return tables


def anchors_of(points: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The nearest anchor of every 64-bit point: either block decoded to its Hamming codeword."""
    out = points.copy()
    for start in (0, BLOCK):
        block = (points >> np.uint64(start)) & np.uint64((1 << BLOCK) - 1)
        syndrome = tables[0][block & np.uint64(0xFFFF)] ^ tables[1][block >> np.uint64(16)]
        wrong = np.where(syndrome > 0, np.uint64(1) << (syndrome - np.uint64(1) + np.uint64(start)) % np.uint64(64), np.uint64(0))
        out ^= wrong
    return out


def replicate(fps: DataFrame, flips: int = 1) -> DataFrame:
    """(anchor, fp): each fingerprint at the anchors of all points within ``flips`` (0 or 1) bits of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = _syndromes()
        steps = np.array([0, *(1 << i for i in range(BITS))][: 1 + flips * BITS], np.uint64)
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                fp = batch["fp"].to_numpy(np.int64)[at : at + BLOCK_ROWS].view(np.uint64)
                near = np.sort(anchors_of(fp[:, None] ^ steps[None, :], tables), axis=1)
                fresh = np.ones(near.shape, bool)
                fresh[:, 1:] = near[:, 1:] != near[:, :-1]
                yield pd.DataFrame({"anchor": near[fresh].view(np.int64), "fp": np.repeat(fp, fresh.sum(axis=1)).view(np.int64)})

    return fps.select("fp").mapInPandas(run, "anchor long, fp long")


def forest(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (row, row) of a spanning forest of the rows within threshold bits; memory grows with the rows, not the pairs."""
    left, links = np.arange(len(fps)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            close = np.bitwise_count(fps[left] ^ fps[one]) <= threshold
            links += [(int(one), int(x)) for x in left[close]]
            queue += list(left[close])
            left = left[~close]
    return links


def links_at_anchors(replicas: DataFrame, threshold: int) -> DataFrame:
    """(u, v): linked fingerprints, a spanning forest for every anchor."""
    groups = replicas.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            u, v = [], []
            for group in batch["fps"]:
                fps = np.asarray(group, np.int64)
                for a, b in forest(fps.view(np.uint64), threshold):
                    u.append(fps[a])
                    v.append(fps[b])
            yield pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return groups.mapInPandas(run, "u long, v long").distinct()


def link(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """prints (doc_id, fp) with component_id added. threshold: 0 to 2 bits."""
    if threshold not in (0, 1, 2):
        raise ValueError("the anchors serve thresholds of 0, 1 and 2 bits")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    if threshold:
        nodes = stage(nodes, "fps")
        found = stage(components(links_at_anchors(replicate(nodes), threshold)), "roots")
        member = nodes.join(found.withColumnRenamed("node", "fp"), "fp")
        low = member.groupBy("root").agg(F.min("first_id").alias("low_id"))
        linked = member.join(low, "root").select("fp", "low_id")
        nodes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("low_id", "first_id").alias("first_id"))
        nodes = stage(nodes, "linked")  # read from a table, so that Spark may split a hot fingerprint in the join
    return prints.join(nodes.withColumnRenamed("first_id", "component_id"), "fp", "left")


def near_duplicates(docs: DataFrame, width: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text)."""
    need(docs, "doc_id", "text")
    prints = stage(fingerprints(docs, width), "prints")
    return link(prints, threshold).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
