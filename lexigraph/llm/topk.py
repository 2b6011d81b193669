"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers, floor(scale * x), and dealt to blocks. A block's index holds,
for each component, bitmaps over the block's rows: one for every bit of the component's coarse
value (the integer less its minimum, without its lowest bits). For a query the coarse inner
product of all rows is summed with bitmap arithmetic: a component counts |q| times, or its
complement if q is negative, so every partial product is a bitmap of a known weight; bitmaps of
one weight are added three to two by full adders until each weight has one. The slices of the sum
are then read from the most significant downward to find the k-th largest coarse score. What
quantisation can hide has a bound, so all rows whose coarse score is within it of the k-th are
candidates; their exact integer scores settle the rows. The k best of each block meet in a final
top k by query.

Every query block meets every data block, in blocks of a fixed size. A data block comes to its task
once, followed by the query blocks one after another; a pair of blocks is all that the task holds.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor
do rows without an id; rows that share an id are rows of their own, each a candidate for the others
and, if its id is asked for, a query; vectors of different lengths are not compared; an empty vector
scores 0; vectors with components of over 2^200 are in blocks of their own and are scored one by one;
scores beyond a long saturate; fewer than k other rows give fewer results; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, ship, stage

ship(__name__)

K = 5
SCALE = 256
BLOCK_ROWS = 16_384
QUERY_ROWS = 512
COARSE_BITS = 6
PARTIAL = "query_id long, own long, vec_id long, score long"
#: Components above this have no bit slices.
WILD = 2.0**192


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(np.float64(SCALE) * vectors.astype(np.float64))


def whole(x: float) -> int:
    """floor(SCALE * x), without overflow."""
    return int(x) * SCALE if abs(x) >= 2**53 else math.floor(SCALE * x)


def products(rows: list[list[int]], query: list[int]) -> np.ndarray:
    """Integer inner products, saturated to a long."""
    found = [sum(map(mul, row, query)) for row in rows]
    return np.array([max(1 - 2**63, min(2**63 - 1, s)) for s in found], np.int64)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products of floats that hold integers; saturated to a long."""
    if rows.size == 0:
        return np.zeros(len(rows), np.int64)
    most = np.abs(rows).max(initial=0) * np.abs(query).max(initial=0) * max(1, rows.shape[1])
    if most < 2**53:
        return (rows @ query).astype(np.int64)
    return products([[int(x) for x in row] for row in rows], [int(x) for x in query])


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class BlockIndex:
    """Bit slices of a block of quantised vectors (rows x components)."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, dims = rows.shape
        self.n, self.words = n, -(-n // 64)
        low = rows.min(axis=0)
        span = float((rows - low).max(initial=0))
        self.step = 2.0 ** max(0, int(np.ceil(np.log2(span + 1))) - COARSE_BITS)
        coarse = np.floor((rows - low) / self.step).astype(np.uint64)
        self.low = low
        self.bits = max(1, int(coarse.max(initial=0)).bit_length())
        self.slices = np.zeros((2, dims, self.bits, self.words), np.uint64)  # plain and complement
        padded = np.zeros((self.words * 64, dims), np.uint64)
        padded[:n] = coarse
        for bit in range(self.bits):
            on = ((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
            self.slices[0, :, bit] = np.packbits(np.ascontiguousarray(on.T), axis=1, bitorder="little").copy(order="C").view("<u8")
        self.valid = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view("<u8").astype(np.uint64)
        self.slices[1] = ~self.slices[0]
        self.rest = (rows - low - coarse * self.step).max(axis=0, initial=0)  # at most, per component

    def coarse_sum(self, weights: np.ndarray, flip: np.ndarray) -> np.ndarray:
        """Slices of the sum over components of weight x coarse value, complemented where flip is set."""
        own = self.slices[flip.astype(np.int64), np.arange(len(weights))]  # component, bit, word
        levels: dict[int, list[np.ndarray]] = {}
        for bit in range(int(weights.max(initial=0)).bit_length()):
            used = own[(weights >> bit) & 1 == 1]
            if len(used):
                for j in range(self.bits):
                    levels.setdefault(bit + j, []).append(used[:, j])
        out, at = [], 0
        while levels:
            planes = levels.pop(at, None)
            if planes is None:
                out.append(np.zeros(self.words, np.uint64))
                at += 1
                continue
            stack = np.concatenate(planes) if len(planes) > 1 else planes[0]
            carries = []
            while len(stack) > 1:
                if len(stack) == 2:
                    carries.append((stack[:1] & stack[1:]))
                    stack = stack[:1] ^ stack[1:]
                    break
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                x = a ^ b
                carries.append((a & b) | (c & x))
                stack = np.concatenate([x ^ c, stack[3 * third :]])
            out.append(stack[0])
            if carries:
                levels.setdefault(at + 1, []).extend(carries)
            at += 1
        return np.stack(out) if out else np.zeros((1, self.words), np.uint64)

    def kth(self, total: np.ndarray, rows: np.ndarray, k: int) -> int:
        """The k-th largest sum among the rows of a bitmap (0 if they are fewer), from the most significant slice down."""
        value, tied, above = 0, rows, 0
        for bit in range(len(total) - 1, -1, -1):
            on = tied & total[bit]
            count = int(np.bitwise_count(on).sum())
            if above + count >= k:
                tied, value = on, value | 1 << bit
            else:
                above += count
                tied = tied & ~total[bit]
        return value if above + int(np.bitwise_count(tied).sum()) >= k else 0

    def at_least(self, total: np.ndarray, rows: np.ndarray, value: int) -> np.ndarray:
        """The rows of a bitmap whose sum is value or more."""
        if value <= 0:
            return rows
        if value >> len(total):
            return np.zeros_like(rows)
        more, same = np.zeros_like(rows), rows
        for bit in range(len(total) - 1, -1, -1):
            if value >> bit & 1:
                same = same & total[bit]
            else:
                more = more | (same & total[bit])
                same = same & ~total[bit]
        return more | same

    def top(self, query: np.ndarray, own: list[int], k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the k best rows but those at the query's own places, ties to the smaller id."""
        rows = self.valid.copy()
        for place in own:
            rows[place >> 6] &= ~(np.uint64(1) << np.uint64(place & 63))
        size = np.abs(query)
        # weights of 7 bits; what they leave of larger components is in the bound
        unit = 2.0 ** max(0, int(np.ceil(np.log2(size.max(initial=0) + 1))) - 7)
        weights = np.floor(size / unit).astype(np.int64)
        total = self.coarse_sum(weights, query < 0)
        # exact = known + unit x step x sum + error, 0 <= q x rest where q > 0 and the reverse where q < 0
        top_value = (2.0**self.bits - 1) * self.step
        hidden = float((weights * unit * self.rest).sum() + ((size - weights * unit) * (top_value + self.rest)).sum())
        gap = int(np.ceil(hidden / (unit * self.step))) + 1 if hidden else 0
        near = self.at_least(total, rows, self.kth(total, rows, k) - gap)
        places = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: self.n])
        scores = exact_scores(self.rows[places], query)
        order = best(ids[places], scores, k)
        return places[order], scores[order]


class WildBlock:
    """Rows with components too large for bit slices."""

    def __init__(self, rows: np.ndarray):
        self.rows = [[whole(x) for x in row] for row in rows.tolist()]

    def top(self, query: list[int], own: list[int], k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.setdiff1d(np.arange(len(self.rows)), own)
        scores = products([self.rows[i] for i in places], query)
        order = best(ids[places], scores, k)
        return places[order], scores[order]


def _cells(data: bytes, rows: int, dims: int) -> np.ndarray:
    """A block's vectors; blocks of small integers are kept in four bytes each."""
    return np.frombuffer(data, "<f4" if len(data) == 4 * rows * dims else "<f8").reshape(rows, dims).astype(np.float64)


def _clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, own) of rows that take part; own numbers the rows, once they are staged."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
        .withColumn("own", F.monotonically_increasing_id())
    )


BLOCKS = "dims int, wild boolean, block long, ids binary, own binary, cells binary"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """BLOCKS: rows packed by task into blocks of size rows or fewer, as bytes. Wild blocks keep their components as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, bool], tuple[list, list, list]] = {}
        names = [c.split()[0] for c in BLOCKS.split(", ")]

        def full(kind):
            nonlocal made
            ids, own, cells = held.pop(kind)
            made += 1
            values = np.array(cells, "<f8").reshape(len(ids), kind[0])
            exact = not kind[1] and np.abs(values).max(initial=0) < 2**24
            return [*kind, (task << 32) + made, np.array(ids, "<i8").tobytes(), np.array(own, "<i8").tobytes(), values.astype("<f4" if exact else "<f8").tobytes()]

        for batch in batches:
            out = []
            for vec_id, vector, own in zip(batch["vec_id"], batch["embedding"], batch["own"]):
                vector = np.asarray(vector, np.float64)
                wild = bool(np.abs(vector).max(initial=0) > WILD)
                kind = (len(vector), wild)
                block = held.setdefault(kind, ([], [], []))
                for part, x in zip(block, (vec_id, own, vector if wild else quantised(vector))):
                    part.append(x)
                if len(block[0]) == size:
                    out.append(full(kind))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([full(kind) for kind in list(held)], columns=names)

    return rows.select("vec_id", "embedding", "own").mapInPandas(run, BLOCKS)


def _repack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of nearly the full size: rows go to as many tasks as there are full blocks."""
    wanted = max(1, -(-rows.count() // size))
    return stage(_blocks(rows.repartition(wanted, F.xxhash64("vec_id", "own")), size), "blocks")


def _best(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for tables (vec_id, embedding, own); a candidate with the query's own is left out."""
    data, right = _repack(rows, BLOCK_ROWS), _repack(asked, QUERY_ROWS)
    # block numbers are paired first; then a data block moves once, query blocks once for each data block
    pairs = data.select("dims", F.col("block").alias("home")).join(right.select("dims", "block"), "dims")
    first = data.select(F.col("block").alias("home"), F.lit(0).alias("turn"), "dims", "wild", "ids", "own", "cells")
    after = pairs.select("home", "block").join(right, "block").select("home", F.lit(1).alias("turn"), "dims", "wild", "ids", "own", "cells")
    met = first.unionAll(after).repartition("home").sortWithinPartitions("home", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, ids, place = None, None, {}
        for batch in batches:
            for row in batch.itertuples():
                row_ids, row_own = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.own, "<i8")
                cells = _cells(row.cells, len(row_ids), row.dims)
                if not row.turn:
                    ids, place = row_ids, {}
                    for i, x in enumerate(row_own.tolist()):
                        place.setdefault(x, []).append(i)
                    index = WildBlock(cells) if row.wild else BlockIndex(cells)
                    continue
                block = index
                if row.wild and not isinstance(block, WildBlock):  # a wild query meets plain rows
                    block = WildBlock(block.rows / SCALE)
                found = []
                for q, own, query in zip(row_ids.tolist(), row_own.tolist(), cells):
                    if isinstance(block, WildBlock):
                        query = [whole(x) if row.wild else int(x) for x in query.tolist()]
                    at, scores = block.top(query, place.get(own, []), k, ids)
                    found.append(pd.DataFrame({"query_id": np.full(len(at), q, np.int64), "own": np.full(len(at), own, np.int64), "vec_id": ids[at], "score": scores}))
                if found:
                    yield pd.concat(found)

    partial = met.mapInPandas(run, PARTIAL)
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.col("score").desc(), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables have vec_id, embedding; rows of a query's own id are no candidates."""
    need(vectors, "vec_id", "embedding")
    need(queries, "vec_id", "embedding")
    return _best(*[stage(_clean(x).withColumn("own", F.col("vec_id")), "vectors") for x in (vectors, queries)], k)


def neighbours(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by ``every``, against all rows but themselves."""
    need(vectors, "vec_id", "embedding")
    rows = stage(_clean(vectors), "vectors")
    return _best(rows, rows.where(F.col("vec_id") % every == 0), k)
