import random

import numpy as np
import xxhash

from data import no_documents, odd_documents
from lexigraph.llm import simhash
from lexigraph.llm.common import table


def plain_fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, threshold=2):
    fps = sorted({fp for _, fp in rows})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= threshold:
                parent[root(a)] = root(b)
    low = {}
    for i, fp in rows:
        if i is not None:
            low[root(fp)] = min(low.get(root(fp), i), i)
    return sorted(((i, fp, low.get(root(fp))) for i, fp in rows), key=repr)


def found(frame):
    return sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in frame.collect()), key=repr)


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == plain_components(rows)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == plain_components(rows)
    assert simhash.near_duplicates(no_documents(spark)).collect() == []


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(6):  # chains of steps of one to three bits
            rows.append((n, fp - (1 << 64) if fp >> 63 else fp))
            n += 1
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                fp ^= 1 << bit
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    for threshold in (0, 1, 2):
        got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.link(prints, threshold).collect())
        assert got == sorted(plain_components([(i, f % (1 << 64)) for i, f in rows], threshold))


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(3)
    tables = simhash._syndromes()
    steps = np.array([0, *(1 << i for i in range(64))], np.uint64)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, dtype=np.uint64) << np.uint64(1)
        b = a
        for bit in rng.choice(64, 2, replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        near = [set(simhash.anchors_of(x ^ steps, tables).tolist()) for x in (a, b)]
        assert near[0] & near[1]
        assert max(map(len, near)) <= 64
    code = simhash.anchors_of(rng.integers(0, 1 << 63, 1000, dtype=np.uint64), tables)
    assert (simhash.anchors_of(code, tables) == code).all()
