import ast
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import test_lines
import test_mixing
import test_toxicity
from data import no_documents, odd_documents
from lexigraph.llm import lines, mixing, packing, simhash_similar, toxicity
from lexigraph.llm.common import stage, table

pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


@pytest.mark.parametrize("before", [0, 2])
def test_near_duplicates_against_all_pairs(spark, before):
    """On the raw documents, and on what the stages before leave of those of ten times as many."""
    sf_dir = f"/root/testdata/{'sf0.1' if before else 'sf0.01'}"
    docs = table(spark, sf_dir, "documents")
    for _, function in pipeline.STAGES[:before]:
        docs = stage(function(spark, docs, sf_dir))
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingles(t) for i, t in rows.items()}
    keep = {r.doc_id: r.keep_id for r in simhash_similar.groups(docs).collect()}
    ids, index = sorted(rows), {}
    for i in ids:
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    pairs = {(a, b) for held in index.values() if len(held) < 200 for n, a in enumerate(held) for b in held[n + 1 :]}
    alike = {p: jaccard(sets[p[0]], sets[p[1]]) for p in pairs}
    near = [p for p, j in alike.items() if j >= 0.8]
    assert len(near) > (5 if before else 50)
    assert sum(keep[a] == keep[b] for a, b in near) >= 0.99 * len(near)
    # every text that goes has a partner of that similarity
    linked = {x for p in near for x in p}
    assert all(i in linked for i, k in keep.items() if k != i)
    left = {r.doc_id for r in simhash_similar.without_near_duplicates(docs).select("doc_id").collect()}
    assert left == {i for i, k in keep.items() if i == k}


def test_chunks_of_a_large_family(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, base + f" t{i} u{i}") for i in range(120)] + [(500 + i, " ".join(f"x{i}y{k}" for k in range(50))) for i in range(30)], "doc_id long, text string")
    monkeypatch.setattr(simhash_similar, "CHUNK", 16)
    kept = sorted(r.doc_id for r in simhash_similar.without_near_duplicates(docs).collect())
    assert kept == [0, *range(500, 530)]


def test_star_across_chunks(spark, monkeypatch):
    """Copies that are near the original only, which is in the middle of the ids."""
    words = [f"w{i}" for i in range(400)]
    texts = {100: " ".join(words)}
    for i in range(60):
        own = list(words)
        for k in range(8):  # eight words of 400: a Jaccard similarity of 0.82 with the original, 0.68 or so with each other
            own[(i * 6 + k * 50 + 3) % 400] = f"own{i}x{k}"
        texts[i if i < 30 else 100 + i] = " ".join(own)
    alike = [jaccard(shingles(texts[100]), shingles(t)) for i, t in texts.items() if i != 100]
    assert 0.8 <= min(alike) and max(alike) < 0.84
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    # one anchor for all, and estimates that are exact
    monkeypatch.setattr(simhash_similar, "CHUNK", 8)
    nodes = docs.selectExpr("doc_id AS id", "1 AS n", "cast(text AS binary) AS vec")
    members = docs.selectExpr("1L AS anchor", f"{len(texts)}L AS texts", "doc_id AS id")

    def exact(found, sizes, least):
        texts = [t.decode().split() for t in found]
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
        return lambda one, others: np.array([len(sets[one] & sets[x]) >= least * len(sets[one] | sets[x]) for x in others], bool)

    roots = {r.node: r.root for r in simhash_similar._joined(members, nodes, exact, 0.8).collect()}
    assert roots == dict.fromkeys(texts, 0)


def test_links_are_exact(spark):
    def pair(i, edits):
        a = [f"p{i}w{k}" for k in range(304)]
        b = list(a)
        for k in range(edits):
            b[10 + 20 * k] = f"p{i}own{k}"
        return a, b

    rows, alike = [], []
    for i in range(240):
        a, b = pair(i, 6 + i % 3)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        alike.append(jaccard(shingles(rows[-2][1]), shingles(rows[-1][1])))
    assert {round(x, 2) for x in alike} == {0.82, 0.79, 0.76}
    kept = {r.doc_id for r in simhash_similar.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i + 1 in kept for i, j in enumerate(alike) if j < 0.8)
    assert sum(2 * i + 1 in kept for i, j in enumerate(alike) if j >= 0.8) <= 5


def test_anchor_recall():
    rng = np.random.default_rng(8)
    both = np.sign(rng.normal(size=(300, 1, 256))) * 0
    shared = 2.0 * rng.binomial(267, 0.5, (300, 1, 256)) - 267
    own = 2.0 * rng.binomial(33, 0.5, (300, 2, 256)) - 33
    pair = (both + shared + own).astype(np.float32)  # a Jaccard similarity of 0.8
    a, b = simhash_similar.anchors(pair[:, 0]), simhash_similar.anchors(pair[:, 1])
    assert np.mean([bool(set(x) & set(y)) for x, y in zip(a.tolist(), b.tolist())]) >= 0.99


def test_clashing_columns_keep_their_values(spark):
    names = ["doc_id", "text", "_id", "_key", "key", "at", "mark", "doc", "own_at", "root"]
    docs = spark.createDataFrame([(i, "one text that is the same in each row of this table", *[f"{n}{i}" for n in names[2:]]) for i in range(4)], names)
    rows = simhash_similar.without_near_duplicates(docs).collect()
    assert [tuple(r)[2:] for r in rows] == [tuple(f"{n}0" for n in names[2:])]


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = docs
    for step in (lambda d: toxicity.without_toxic(d, table(spark, sf_dir, "labels")), lines.deduplicated, simhash_similar.without_near_duplicates, mixing.mixed_documents):
        want = spark.createDataFrame(step(want).collect(), docs.schema)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = want.select("doc_id", "text").collect()
    got = pipeline.run(spark, sf_dir)
    assert set(columns) <= set(got.columns)
    encoder = packing.WordEncoder(packing.default_vocabulary())
    tokens = sum(len(encoder.whole(r.text or "")) // 4 + 1 for r in whole)
    assert got.agg(F.sum("length")).first()[0] == tokens


def test_stages_take_odd_rows(spark, sf_dir):
    for _, function in pipeline.STAGES[:-1]:
        docs = odd_documents(spark)
        out = function(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.collect()
        assert function(spark, no_documents(spark), sf_dir).collect() == []
    kept = simhash_similar.without_near_duplicates(odd_documents(spark)).collect()
    assert sorted(repr(r.doc_id) for r in kept) == sorted(map(repr, [0, 2, 3, 4, None, 5, 7, 8]))


def plain_pipeline(spark, sf_dir):
    """{doc_id: (text, copies)} of the documents that reach packing, stage by stage from plain versions."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))  # its plain reading is compared in test_toxicity
    rows = [r for r in docs.collect() if test_toxicity.plain(model, r.text) < toxicity.PREDICT_AT]
    source = {r.doc_id: r.source for r in rows}
    before = {r.doc_id: r.text for r in rows}
    texts = {}
    for doc_id, text, _, _ in map(ast.literal_eval, test_lines.plain(rows)):
        if text.split() or not before[doc_id].split():
            texts[doc_id] = text
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if texts[a] == texts[b] or sets[a] and jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    kept = [i for i in ids if find(i) == i]
    left = [Row(doc_id=i, text=texts[i], source=source[i]) for i in kept]
    size, h, total, target = test_mixing.plain(left)
    out = {}
    for s in total:
        own = sorted((h[n], size[n], r) for n, r in enumerate(left) if r.source == s)
        base = math.floor(target[s] / total[s]) if total[s] else 0
        rest, cum = target[s] - base * total[s], 0
        for _, n, r in own:
            extra = cum + n <= rest or cum <= rest and 2 * (rest - cum) >= n
            cum += n
            if copies := min(2, base + extra):
                out[r.doc_id] = (r.text, copies)
    return out


def test_pipeline_against_plain_stages(spark, sf_dir):
    want = plain_pipeline(spark, sf_dir)
    encoder = packing.WordEncoder(packing.default_vocabulary())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pipeline.run(spark, sf_dir).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for doc_id, (text, copies) in want.items():
        ids = np.frombuffer(encoder.whole(text), "<u4").tolist() + [packing.END_ID]
        times = [0] * len(ids)
        for r in pieces[doc_id]:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(part.tobytes()))
            for i in range(r.start, r.start + r.length):
                times[i] += 1
        assert times == [copies] * len(ids)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
