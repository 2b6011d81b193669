import hashlib
import math
import re
import struct
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from data import no_documents, odd_documents
from lexigraph.llm import imatch
from lexigraph.llm.common import table


MASK = (1 << 64) - 1
SUBSETS, LEVELS = 16, 3


def draw(number, subset):
    """A term's number in a random lexicon: 32 bits, by the finaliser of SplitMix64."""
    x = number ^ (subset * 0x9E3779B97F4A7C15 & MASK)
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return (x ^ (x >> 31)) >> 32


def plain_print(text, band):
    """(kind, level, {(level, subset): hash}) of a text, from plain integers."""
    words = set(re.findall(r"\w+", text.lower()))
    number = {w: xxhash.xxh64_intdigest(w.encode(), 42) for w in words}
    kind, own = ("i", words & band) if words & band else ("a", words)
    numbers = sorted(number[w] for w in own)
    if not numbers:
        return None
    base = int(math.log2(len(numbers)))
    hashes = {}
    for level in range(base, base + LEVELS):
        for subset in range(1, SUBSETS + 1):
            inside = [x for x in numbers if draw(x, subset) < 0xFFFFFFFF >> level]
            if inside:
                hashes[level, subset] = xxhash.xxh32_hexdigest(struct.pack(f"<{len(inside)}Q", *inside))
    return kind, base, hashes


def written(p):
    if p is None:
        return "none"
    kind, base, hashes = p
    return f"{kind}{base:02d}:" + "".join(hashes.get((level, j), "-" * 8) for level in range(base, base + LEVELS) for j in range(1, SUBSETS + 1))


def plain_likeness(p, q):
    if p == q:
        return 1.0
    if p is None or q is None or p[0] != q[0]:
        return 0.0
    levels = set(range(p[1], p[1] + LEVELS)) & set(range(q[1], q[1] + LEVELS))
    places = [k for k in {*p[2], *q[2]} if k[0] in levels]
    return sum(p[2].get(k) == q[2].get(k) for k in places) / len(places) if places else 0.0


def check(docs, parts):
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
    df = Counter()
    for r in rows:
        df.update(set(re.findall(r"\w+", (r.text or "").lower())))
    band = {t for t, n in df.items() if 3e-4 * len(rows) <= n <= max(1.0, 0.02 * len(rows))}
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    want = []
    for n, r in enumerate(order):
        text, after = r.text or "", order[(n + 1) % len(order)].text or ""
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        a, b, c = (plain_print(x, band) for x in (text, new, after))
        want.append((r.doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), written(a), written(b), plain_likeness(a, b), plain_likeness(a, c)))
    got = [tuple(r) for r in imatch.fingerprints(docs, parts=parts).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def test_documents(spark, sf_dir):
    got = check(table(spark, sf_dir, "documents"), 7)
    assert sum(r[5] > r[6] for r in got) >= 0.9 * len(got)
    assert sum(r[5] for r in got) / len(got) >= 0.35
    assert sorted(r[6] for r in got)[len(got) // 2] <= 0.1


def test_odd_rows(spark):
    for parts in (1, 3):
        check(odd_documents(spark), parts)
    assert imatch.fingerprints(no_documents(spark)).collect() == []
    one = spark.createDataFrame([(7, "alone but for itself here")], "doc_id long, text string")
    check(one, 2)


def test_equal_texts_and_order_of_terms():
    printer = imatch.Printer(imatch.numbers_of({"alpha", "beta", "gamma"}))
    assert printer.fingerprint("alpha beta") == printer.fingerprint("BETA, beta; alpha the")
    assert printer.fingerprint("") == printer.fingerprint(" .,! ") == "none"
    assert imatch.likeness("none", "none") == 1.0
    assert imatch.likeness(printer.fingerprint("alpha"), printer.fingerprint("other words")) == 0.0


def test_rows_of_one_id_are_split(spark):
    """Most rows have no id, or one; their parts are of about equal size and the order goes on across them."""
    rows = [(None if i % 2 else 7 if i % 3 else i, f"text number {i} with some words of its own w{i} v{i * 7 % 31}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, 12)
    parts = [r["count"] for r in imatch.in_order(docs, 12).where("edge = 0").groupBy("part").count().collect()]
    assert len(parts) >= 10 and max(parts) <= 120


def test_parts_follow_ids_and_ties():
    rng = np.random.default_rng(3)
    ids, ties = rng.choice([-5, 0, 1, 1, 1, 1, 9, (1 << 63) - 1], 2000), rng.integers(-(1 << 63), 1 << 63, 2000, np.int64)
    parts = imatch.Parts([-5, 1, 1, 1, 1, 9, (1 << 63) - 1, (1 << 63) - 1])
    order = np.lexsort((ties, -ids.astype(object)))
    assert (np.diff(parts.of(ids, ties)[order]) <= 0).all() and parts.of(ids, ties).max() < parts.count
