import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from data import no_documents, odd_documents
from lexigraph.llm import mixing
from lexigraph.llm.common import table


def plain(rows, weights=(3, 1, 2), budget=1.5, cap=2):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    h = [int(md5(("" if r.doc_id is None else str(r.doc_id)) + "|" + ("" if r.text is None else md5(r.text)))[:15], 16) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size):
        total[r.source] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    # hand out shares, cap, hand out the excess again
    target = dict.fromkeys(order, 0.0)
    left, open_ = budget * sum(total.values()), set(order)
    while open_ and left > 1e-9:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        left = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] >= cap * total[s]:
                left += target[s] - cap * total[s]
                target[s] = float(cap * total[s])
                open_.discard(s)
    return size, h, total, target


def check(docs):
    rows = docs.collect()
    size, h, total, target = plain(rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    taken, largest, sizes = defaultdict(int), defaultdict(int), sorted((repr(r.doc_id), n) for r, n in zip(rows, size))
    assert sorted((repr(r.doc_id), r["size"]) for r in out) == sizes
    by_size = defaultdict(list)
    for r, n, k in zip(rows, size, h):
        by_size[(r.source, k)].append(n)
    for (s, _), n in by_size.items():
        largest[s] = max(largest[s], sum(n))
    source = {repr(r.doc_id): r.source for r in rows}
    for r in out:
        s = source[repr(r.doc_id)]
        assert r.source_size == total[s] and abs(r.target - target[s]) <= 1e-6 * max(1, target[s])
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(repr, mixing.mix(docs.repartition(3)).collect())) == sorted(map(repr, out))


def test_documents(spark, sf_dir):
    check(table(spark, sf_dir, "documents"))


def test_skewed_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check(docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit("hot")).when(F.col("doc_id") % 50 == 1, F.lit(None)).otherwise(F.col("source"))))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = docs.collect()
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert all(r.taken <= 2 * r["size"] for r in out)
    assert mixing.mix(no_documents(spark)).collect() == []
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_many_sources_take_the_salted_join(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    want = sorted(map(repr, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(docs).collect())) == want


def test_documents_come_as_often_as_taken(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix(docs).collect() if r.taken}
    got = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs).groupBy("doc_id").count().collect()}
    assert got == want


def test_rows_without_ids_are_spread(spark):
    """Sources whose rows have no id, or all the same one, come near their targets; empty texts are in the mix at most twice."""
    rows = [(None, f"row {i} of the first " + "w " * (i % 190), "a") for i in range(200)] + [(7, f"row {i} of the second " + "w " * (i % 90), "b") for i in range(200)]
    docs = spark.createDataFrame(rows + [(i, "", "b") for i in range(50)], "doc_id long, text string, source string")
    check(docs)
    taken = {}
    for r in mixing.mix(docs).collect():
        t = taken.setdefault(r.source_size, [0, r.target])
        t[0] += r.taken
    assert all(abs(n - target) <= 200 for n, target in taken.values())
    copies = [r["count"] for r in mixing.mixed_documents(docs).where("text = ''").groupBy("doc_id").count().collect()]
    assert max(copies, default=0) <= 2


def test_clashing_columns_keep_their_values(spark):
    names = ["doc_id", "text", "source", "h", "target", "limit", "base", "source_size", "copies", "size", "n", "doc", "_s", "_own"]
    docs = spark.createDataFrame([(i, f"some words of text {i}", "ab"[i % 2], *[f"{n}{i}" for n in names[3:]]) for i in range(20)], names)
    rows = mixing.mixed_documents(docs).collect()
    assert rows and all(tuple(r)[3:] == tuple(f"{n}{r.doc_id}" for n in names[3:]) for r in rows)


def test_many_sources_get_the_weights_in_turn(spark):
    """Every source is a host of its own; ranks are counted over many tasks."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "concat('host', lpad(id * 7919 % 3000, 5, '0')) AS source").repartition(16)
    check(docs)
