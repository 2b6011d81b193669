import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lexigraph.llm import topk
from lexigraph.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def whole(x):
    """floor(256 * x) of a finite double, exactly."""
    return math.floor(256 * Fraction(x))


def plain(rows, queries, k=5):
    fine = [(i, [whole(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, own) in enumerate(fine):
        if q in queries:
            scored = []
            for place, (i, v) in enumerate(fine):
                if place != at and len(v) == len(own):
                    s = sum(x * y for x, y in zip(own, v))
                    scored.append((-max(1 - 2**63, min(2**63 - 1, s)), i))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def got(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def test_whole_table(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, list(r.embedding)) for r in vectors.collect()]
    assert got(topk.neighbours(vectors)) == plain(rows, [i for i, _ in rows if i % 50 == 0])


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(7)]) for i in range(300)]
    rows += [(i, [0.5] * 7) for i in range(300, 320)]  # ties
    rows += [(400, None), (401, [1.0, None] + [0.0] * 5), (402, [math.nan] * 7), (403, [math.inf] * 7), (None, [1.0] * 7)]
    rows += [(450, [1.0, 2.0]), (451, [2.0, -1.0]), (500, []), (550, []), (600, [1e9, -3.0, 4.0]), (601, [7e8, 2.0, -1e-3]), (602, [1e17] * 3), (603, [-1e17] * 3)]
    rows += [(50, [rng.gauss(0, 1) for _ in range(7)]), rows[0], rows[0]]  # ids that repeat
    rows += [(700, [1e306, -1e306, 3.0]), (701, [1e306, 1e306, -7.5]), (702, [-1.7e308, 5e-324, 0.25]), (750, [2.0, 1e150, -1e150])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    asked = [i for i, _ in rows if i is not None and i % 50 == 0]
    assert got(topk.neighbours(frame)) == plain(rows, asked)
    assert got(topk.neighbours(spark.createDataFrame([], SCHEMA))) == []
    alone = spark.createDataFrame([(0, [1.0], "", "")], SCHEMA)
    assert got(topk.neighbours(alone)) == []


def test_small_blocks(spark, sf_dir, monkeypatch):
    vectors = table(spark, sf_dir, "embeddings")
    want = got(topk.neighbours(vectors))
    monkeypatch.setattr(topk, "BLOCK_ROWS", 70)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    assert got(topk.neighbours(vectors)) == want


@pytest.mark.parametrize("scale", [1, 40, 3000])
def test_slices_against_sums(scale):
    rng = np.random.default_rng(scale)
    rows = np.floor(rng.normal(0, scale, (333, 9)))
    index = topk.BlockIndex(rows)
    ids = rng.permutation(333).astype(np.int64)
    for n in range(20):
        query = np.floor(rng.normal(0, scale * 3, 9))
        exact = (rows @ query).astype(np.int64)
        exact[n] = -(2**62)
        best = np.lexsort((ids, -exact))[:5]
        at, scores = index.top(query, [n], 5, ids)
        assert at.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()
