"""Near-duplicate texts by similarity, with SimHash counters and soft anchors.

The 64-bit fingerprints of ``simhash`` serve a few bits. Texts whose word shingles have a Jaccard
similarity of 0.8 differ in some ten bits of 64, too far for exact covering. So here the counters
behind 256 fingerprint bits are kept (as signed bytes) and anchors are chosen for them: the
codewords of first-order Reed-Muller codes of length 64, which a Hadamard transform finds. The
counters are permuted and their signs flipped at random, once for each of ``TABLES`` tables, and
cut into four blocks; a text is replicated to the ``PROBES`` products of four codewords that it
correlates with best. With 8 tables and 12 probes, 99.8 % of pairs at a similarity of 0.8 share an
anchor, and all of 1,500 pairs at 0.85 did (simulated; the tests measure it).

Texts at an anchor are compared by the angle between their counters, which with the numbers of
shingles gives the Jaccard similarity with a standard error of 0.02 to 0.03. This is a filter, ``MARGIN``
below the similarity asked for. Texts that it joins are compared again by the hashes of all their
shingles, with each other member of their group, and only what these show to be similar is linked.
Only anchors with two texts or more carry counters on. Anchors with more than ``CHUNK``
texts, as a large family of copies has, are dealt in chunks; then the chunks' groups are compared
by their smallest members. Anchors that are still more than one group after that have each chunk
compared with each other chunk: the time, and the rows moved, of such anchors grow with the square of
their texts, in tasks of two chunks each. Each comparison gives a spanning forest of its links, never
all pairs. In the second comparison a text counts once more for every ``LONG`` shingles, so that chunks
of long texts are small.
Equal texts are one from the start. Groups are connected components of the links; the smallest
doc_id of each stays.

Defined results: null texts and texts without words are near nothing, equal ones are copies; fewer
words than a shingle has are one shingle; rows that share both id and text are one document, kept
or dropped together; null ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_or_last, need, packed, ship, stage, text_key
from .components import components
from .simhash import shingle_hashes

ship(__name__)

WIDTH = 5
SIMILARITY = 0.8
MARGIN = 0.08
COUNTERS = 256
BLOCK = 64
TABLES = 8
PROBES = 12
NEXT_BEST = 4
CHUNK = 2_000
LONG = 500
SCALE = 450.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def counters(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """Number of distinct shingles; for 256 bits how many have it less how many do not, as a vector of length one."""
    hashes = np.unique(shingle_hashes(text, width))
    total = np.zeros(COUNTERS, np.int64)
    if not len(hashes):
        return 0, total.astype(np.float32)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        wide = np.stack([_mix(part + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(1, COUNTERS // 64 + 1)], 1)
        total += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    centred = (2 * total - len(hashes)).astype(np.float32)
    return len(hashes), centred / max(1e-9, float(np.linalg.norm(centred)))


def vectors(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n, vec) of every row: a hash of the text, its shingles, its counters as signed bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counters(t, width) for t in batch["text"]]
            packed = [np.clip(np.rint(v * SCALE), -127, 127).astype(np.int8).tobytes() for _, v in found]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "n": np.array([n for n, _ in found], np.int32), "vec": packed})

    source = docs.select(id_or_last(F.col("doc_id")).alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    return source.mapInPandas(run, "doc_id long, key binary, n int, vec binary")


def _hadamard() -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < BLOCK:
        h = np.block([[h, h], [h, -h]])
    return h


def anchors(vecs: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Anchor keys of each vector: rows x (tables x probes)."""
    rng, h, blocks = np.random.default_rng(20), _hadamard(), COUNTERS // BLOCK
    choices = np.array(list(itertools.product(range(NEXT_BEST), repeat=blocks)))
    choices = choices[np.argsort(choices.sum(axis=1), kind="stable")]
    # a choice is worse than all that take a better codeword in every block: only so many can be among the best
    choices = choices[np.prod(choices + 1, axis=1) <= probes]
    out = []
    for table in range(tables):
        order, sign = rng.permutation(COUNTERS), rng.choice(np.array([-1, 1], np.float32), COUNTERS)
        match = (vecs[:, order] * sign).reshape(len(vecs), blocks, BLOCK) @ h
        size = np.abs(match)
        best = np.argsort(-size, axis=2, kind="stable")[:, :, :NEXT_BEST]
        word = best * 2 + (np.take_along_axis(match, best, 2) > 0)
        value = np.take_along_axis(size, best, 2)
        loss = sum((value[:, b, :1] - value[:, b])[:, choices[:, b]] for b in range(blocks))
        pick = choices[np.argsort(loss, axis=1, kind="stable")[:, :probes]]
        key = np.full(pick.shape[:2], table, np.int64)
        for b in range(blocks):
            key = key * (2 * BLOCK) + np.take_along_axis(word[:, b], pick[:, :, b], 1)
        out.append(key)
    return np.concatenate(out, axis=1)


def similarities(vecs: np.ndarray, sizes: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Jaccard similarity of one text with others, from the angle and the numbers of shingles."""
    cos = vecs[others] @ vecs[one]
    root = np.sqrt(sizes[others] * sizes[one])
    return cos * root / np.maximum(1e-9, sizes[others] + sizes[one] - cos * root)


def forest(ids: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], part: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the parts as all near pairs would; near tells which of others are near one, part the linked part of each text."""
    left, links = np.arange(len(ids)), []
    while len(left):
        mine = part[left] == part[left[0]]
        queue, left = list(left[mine]), left[~mine]
        while queue and len(left):
            one = queue.pop()
            close = left[near(one, left)]
            if len(close):
                links += [(int(ids[one]), int(ids[x])) for x in close]
                joined = np.isin(part[left], part[close])
                queue += list(left[joined])
                left = left[~joined]
    return links


def estimate(found: list[bytes], sizes: np.ndarray, least: float) -> Callable[[int, np.ndarray], np.ndarray]:
    vecs = np.stack([np.frombuffer(v, np.int8) for v in found]).astype(np.float32)
    vecs /= np.maximum(1e-9, np.linalg.norm(vecs, axis=1, keepdims=True))
    return lambda one, others: similarities(vecs, sizes, one, others) >= least


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, n, vec) of texts (id, text): the number of distinct shingles, and their hashes as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.iloc[at : at + 100]
                found = [np.unique(shingle_hashes(t, width)) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"], "n": np.array([len(x) for x in found], np.int32), "vec": [x.astype(np.uint64).tobytes() for x in found]})

    return texts.select("id", "text").mapInPandas(run, "id long, n int, vec binary")


def exact(found: list[bytes], sizes: np.ndarray, least: float) -> Callable[[int, np.ndarray], np.ndarray]:
    sets = [np.frombuffer(v, np.uint64) for v in found]
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum([len(x) for x in sets])
    own = [shingle[b - len(x) : b] for x, b in zip(sets, ends)]
    marked = np.zeros(shingle.max(initial=0) + 1, bool)
    last: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def near(one: int, others: np.ndarray) -> np.ndarray:
        if last[0] is not others:  # the shingles of what is left, one after another
            last[:] = others, np.concatenate([own[x] for x in others]), np.repeat(np.arange(len(others)), [len(own[x]) for x in others])
        marked[own[one]] = True
        shared = np.bincount(last[2][marked[last[1]]], minlength=len(others))
        marked[own[one]] = False
        return shared >= least * (sizes[others] + sizes[one] - shared) - 1e-9

    return near


def _chunks():
    return F.greatest(F.lit(1), F.ceil(F.col("texts") / CHUNK)).cast("long")


def _chunk():
    return F.pmod(F.xxhash64("id", "anchor"), _chunks())


def _links(members: DataFrame, nodes: DataFrame, tell: Callable, least: float) -> DataFrame:
    """members (anchor, salt, id, part): links between the parts of each anchor and salt."""
    groups = (
        members.join(nodes.select("id", "n", "vec"), "id")
        .groupBy("anchor", "salt").agg(F.collect_list(F.struct("id", "n", "vec", "part")).alias("texts"))
        .where("size(texts) > 1").select("texts")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = []
            for group in batch["texts"]:
                ids = np.array([r["id"] for r in group], np.int64)
                sizes = np.array([r["n"] for r in group], np.float64)
                part = np.array([r["part"] for r in group], np.int64)
                links += forest(ids, tell([r["vec"] for r in group], sizes, least), part)
            yield pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)

    return groups.mapInPandas(run, "u long, v long").distinct()


def _busy(replicas: DataFrame) -> DataFrame:
    """Replicas at anchors with several texts, with their number. The counts are read from a table, so that Spark may split a hot anchor in the join."""
    counts = stage(replicas.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1"), "anchors")
    return replicas.join(counts, "anchor")


def _joined(members: DataFrame, nodes: DataFrame, tell: Callable, least: float) -> DataFrame:
    """(node, root) of the components that all near pairs at the anchors of members (anchor, texts, id) make."""
    apart = lambda m: m.select("anchor", _chunk().alias("salt"), "id", F.col("id").alias("part"))
    links = stage(_links(apart(members), nodes, tell, least), "links")
    roots = stage(components(links), "roots")
    large = members.where(F.col("texts") > CHUNK)
    if large.isEmpty():
        return roots
    # what chunks kept apart: first the smallest members of their groups
    rooted = lambda: large.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("root", "id"))
    heads = rooted().select("anchor", F.col("part").alias("id")).distinct()
    links = links.unionAll(stage(_links(apart(_busy(stage(heads, "heads"))), nodes, tell, least), "links"))
    roots = stage(components(links), "roots")
    # then, at anchors that are not one group yet, every chunk with every other, a group of rows for each two chunks
    parts = stage(rooted().select("anchor", "texts", "id", "part"), "parts")
    open_ = stage(parts.groupBy("anchor").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("anchor"), "open")
    both = parts.join(open_, "anchor").withColumn("c", _chunk()).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), _chunks() - 1))).where("c <> d")
    pairs = both.select("anchor", F.least("c", "d") * _chunks() + F.greatest("c", "d"), "id", "part").toDF("anchor", "salt", "id", "part")
    links = links.unionAll(stage(_links(pairs, nodes, tell, least), "links"))
    return stage(components(links), "roots")


def groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, keep_id) of every row; keep_id is the smallest id of its group of near duplicates."""
    rows = stage(vectors(docs, width), "vectors")
    nodes = stage(rows.groupBy("key").agg(F.min(F.struct("doc_id", "n", "vec")).alias("x")).select("key", F.col("x.doc_id").alias("id"), "x.n", "x.vec"), "nodes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                keys = anchors(np.stack([np.frombuffer(v, np.int8) for v in part["vec"]]).astype(np.float32))
                yield pd.DataFrame({"anchor": keys.ravel(), "id": np.repeat(part["id"].to_numpy(), keys.shape[1])})

    replicas = stage(nodes.where("n > 0").select("id", "vec").mapInPandas(run, "anchor long, id long"), "replicas")
    members = stage(_busy(replicas), "members")
    roots = _joined(members, nodes, estimate, similarity - MARGIN)
    # what the estimate joined is compared again by its shingles
    ids = roots.select(F.col("root").alias("anchor"), F.col("node").alias("id"))
    load = F.greatest(F.count("*"), F.ceil(F.sum("n") / LONG))
    sizes = stage(ids.join(nodes.select("id", "n"), "id").groupBy("anchor").agg(load.alias("texts")), "sizes")
    homes = ids.join(nodes.select("key", "id"), "id")
    source = docs.select(id_or_last(F.col("doc_id")).alias("id"), text_key(F.col("text")).alias("key"), "text")
    sets = stage(shingle_sets(source.join(homes.select("id", "key").distinct(), ["id", "key"]).dropDuplicates(["id", "key"]), width), "sets")
    roots = _joined(stage(ids.join(sizes, "anchor"), "members"), sets, exact, similarity)
    home = nodes.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    home = stage(home.select("key", F.coalesce("root", "id").alias("keep_id")), "homes")
    return rows.select("doc_id", "key").join(home, "key")


def without_near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near duplicates, with the columns of docs."""
    need(docs, "doc_id", "text")
    gone = groups(docs.select("doc_id", "text"), width, similarity).where("doc_id > keep_id").select(F.col("doc_id").alias("at"), F.col("key").alias("mark"))
    rows = docs.select(packed(docs).alias("doc"), id_or_last(F.col("doc_id")).alias("own_at"), text_key(F.col("text")).alias("own_key"))
    return rows.join(gone, (F.col("own_at") == F.col("at")) & (F.col("own_key") == F.col("mark")), "left_anti").select("doc.*")
