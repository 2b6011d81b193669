import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from data import no_documents, odd_documents
from lexigraph.llm import toxicity
from lexigraph.llm.common import table

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = toxicity.toxicity(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.7)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    met = out.merge(labels.toPandas(), on="doc_id")
    met = met[met.held_out]
    bad, good = met[met.toxic == 1], met[met.toxic == 0]
    assert (bad.predicted == 1).mean() >= 0.8
    assert (good.predicted == 1).mean() <= 0.01
    rank = met.score.rank()
    auc = (rank[met.toxic == 1].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good))
    assert auc >= 0.95


def test_held_out_labels_are_never_used(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    a = toxicity.toxicity(docs, labels).orderBy("doc_id").toPandas()
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = toxicity.toxicity(docs, flipped).orderBy("doc_id").toPandas()
    assert np.allclose(a.score, b.score)


def test_label_model_recovers_classes():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.2
    votes = np.zeros((3000, 12), np.int8)
    for j in range(12):
        speaks = rng.random(3000) < 0.5
        right = rng.random(3000) < 0.8
        votes[:, j] = np.where(speaks, np.where(right == y, 1, -1), 0)
    votes[:, 11] = votes[:, 10] = votes[:, 9]  # repeated voters count once
    noisy = np.where(rng.random(3000) < 0.1, ~y, y).astype(int)
    post = toxicity.label_model(votes, noisy)
    assert ((post > 0.5) == y).mean() > 0.95


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (2, 0, 0), (3, None, None), (None, 1, 1), (99, 1, 1), (5, 1, 0), (6, 0, 0)], LABELS)
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    none = toxicity.toxicity(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity(no_documents(spark), labels).collect() == []
    assert toxicity.without_toxic(docs, labels).columns == docs.columns


def plain(model, text):
    """A text's score under a fitted model, by a plain reading."""
    words = re.findall(r"\w+", text.lower())
    ids = {w: [zlib.crc32(f"w{w}".encode())] + [zlib.crc32(f"b{w[:n]}".encode()) for n in (4, 5, 6) if len(w) > n] for w in set(words)}
    known = {x for found in ids.values() for x in found if x in model.entries}
    hits, n = sum(any(x in model.entries for x in found) for found in ids.values()), max(1, len(words))
    upper = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "À" <= c <= "Þ" and c != "×" for c in text)
    inputs = [float(hits > 0), math.log(1 + hits), min(1.0, 20 * hits / n), min(1.0, upper / max(1, len(text)) + text.count("!") / n)]
    z = model.bias + sum(model.weights[model.entries[x]] for x in known) + sum(a * b for a, b in zip(model.counts, inputs))
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def test_scores_are_the_fitted_model_on_whole_texts(spark, sf_dir):
    """Every score, and every decision of the pipeline's stage, by a plain reading of the text under the fitted weights."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels)

    want = {r.doc_id: plain(model, r.text) for r in docs.collect()}
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {i for i, x in want.items() if x < 0.7}


def test_clashing_columns_keep_their_values(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("a").alias("score"), F.lit("b").alias("_score"), F.lit("c").alias("doc"))
    rows = toxicity.without_toxic(docs, table(spark, sf_dir, "labels")).collect()
    assert rows and all((r.score, r._score, r.doc) == ("a", "b", "c") for r in rows)
