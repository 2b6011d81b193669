import re
import sys
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from data import no_documents, odd_documents
from lexigraph.llm import packing, rollups
from lexigraph.llm.common import scratch_path, table

CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long, docs long"


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}


def test_batches_count_once(spark):
    store = rollups.RollupStore(spark, scratch_path(spark))
    assert totals(store) == {}
    first = spark.createDataFrame([("insert", "a", "en", "t1", 10, None, 9), ("insert", "a", "en", "t1", 5, None, 9), ("insert", None, None, "t1", None, None, 9)], CHANGES)
    second = spark.createDataFrame([("delete", "a", "en", "t1", 5, None, 9), ("revise", "a", "en", "t1", 12, 10, 9), ("revise", None, None, "t1", 4, None, 9)], CHANGES)
    assert store.commit("one", first) and not store.commit("one", first)
    assert totals(store) == {("a", "en", "t1"): (2, 15), (None, None, "t1"): (1, 0)}
    assert store.commit("b/2", second)
    want = {("a", "en", "t1"): (1, 12), (None, None, "t1"): (1, 4)}
    assert totals(store) == want
    assert store.compact() and not store.compact()
    assert totals(store) == want and store.known("one") and store.known("b/2") and not store.known("two")
    assert not store.commit("b/2", second) and totals(store) == want
    assert store.commit("three", first) and store.compact()
    assert totals(store)[("a", "en", "t1")] == (3, 27)
    assert store.commit("empty", first.limit(0))
    with pytest.raises(Exception, match="unknown change"):
        store.commit("bad", spark.createDataFrame([("drop", "a", "en", "t1", 1, None, 1)], CHANGES))
    assert not store.known("bad")


def test_readers_finish_what_they_started(spark):
    store = rollups.RollupStore(spark, scratch_path(spark))
    row = spark.createDataFrame([("insert", "a", "en", "t1", 10, None, 1)], CHANGES)
    for n in range(4):
        assert store.commit(f"batch {n}", row)
        before = store.totals()
        assert store.compact()
        assert [(r.docs, r.tokens) for r in before.collect()] == [(n + 1, 10 * (n + 1))]
        assert all(store.known(f"batch {i}") and not store.commit(f"batch {i}", row) for i in range(n + 1))
    assert totals(store) == {("a", "en", "t1"): (4, 40)}


def test_difference_turns_one_state_into_the_other(spark):
    state = "doc_id long, source string, lang string, tokenizer string, tokens long"
    old = spark.createDataFrame([(1, "a", "en", "t", 5), (2, "a", None, "t", 7), (3, "b", "en", "t", 1), (4, None, "en", "t", 2)], state)
    new = spark.createDataFrame([(1, "a", "en", "t", 6), (2, "a", None, "t", 7), (3, "c", "en", "t", 1), (5, None, "en", "t", 3)], state)
    store = rollups.RollupStore(spark, scratch_path(spark))
    store.commit("old", old.withColumn("op", F.lit("insert")))
    changes = rollups.difference(old, new)
    assert changes.count() == 5
    store.commit("change", changes)
    want = defaultdict(lambda: (0, 0))
    for r in new.collect():
        docs, tokens = want[(r.source, r.lang, r.tokenizer)]
        want[(r.source, r.lang, r.tokenizer)] = (docs + 1, tokens + r.tokens)
    assert totals(store) == dict(want)


def test_odd_rows(spark):
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollups.document_rollups(odd_documents(spark)).collect()}
    assert got[("a", "en", "words-v1")] == (2, 15 + 24000)  # the copies of document 0 are gone, the long text is kept
    assert got[(None, "en", "words-v1")] == (1, 24001)
    assert got[(None, None, "words-v1")] == (1, 0)
    assert rollups.document_rollups(no_documents(spark)).collect() == []


def test_counting_keeps_few_words(monkeypatch):
    """Words that never come again don't fill a worker's memory; those that were dropped are counted again."""
    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda run: lambda text: run)
    monkeypatch.delitem(sys.modules, "_lexigraph_encoders", raising=False)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(5)) for i in range(700_000)]
    texts = [" ".join(words[at : at + 700]) for at in range(0, len(words), 700)]
    parts = [pd.Series([None, "", *texts]), pd.Series(texts[:2])]
    got = [n for part in rollups.vocabulary_count(None)(iter(parts)) for n in part]
    found = Tokenizer.from_file(packing.default_vocabulary()).encode_batch_fast(texts, add_special_tokens=False)
    counts = [len(x.ids) for x in found]
    assert got == [0, 0, *counts, *counts[:2]]
    kept = [len(x.words) + len(x.letters) for x in vars(sys.modules["_lexigraph_encoders"]).values() if hasattr(x, "words")]
    assert len(kept) == 1 and kept[0] < 850_000


def test_documents(spark, sf_dir):
    """Against counts of the tokenizers library, text by text."""
    docs = table(spark, sf_dir, "documents")
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want, seen = defaultdict(lambda: (0, 0)), set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if r.text not in seen:
            seen.add(r.text)
            counts = {"words-v1": len(re.findall(r"[^\x20\x09-\x0D]+", r.text)), "word_bpe_49k": len(tokenizer.encode(r.text, add_special_tokens=False).ids)}
            for name, n in counts.items():
                before = want[(r.source, r.lang, name)]
                want[(r.source, r.lang, name)] = (before[0] + 1, before[1] + n)
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollups.document_rollups(docs).collect()}
    assert got == dict(want) and len(got) > 2
