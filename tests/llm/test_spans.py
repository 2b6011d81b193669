import random
import re

from pyspark.sql import functions as F

from data import no_documents, odd_documents
from lexigraph.llm import spans
from lexigraph.llm.common import table


def parts_of(text):
    ends = [m.end() for m in re.finditer(r"(?<=[.!?。！？])\s+|\s*\n\s*", text)]
    ends = ends if ends and ends[-1] == len(text) else [*ends, len(text)]
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def plain(rows, min_sentences=2, min_words=20, lone_words=40):
    """Text without repeated sentences by id and text: every run of sentences that is long enough, and whole texts, in the order of their first places.

    keys: ids in order, then a hash of the text, as the operator orders texts of one id.
    """
    keyed = {(float("inf") if r.doc_id is None else r.doc_id, r.key, r.text): parts_of(r.text) for r in rows if r.text}
    seen, whole, gone = {}, set(), {}
    for key in sorted(keyed):
        p = [tuple(x.lower().split()) for x in keyed[key]]
        size = [len(x) for x in p]
        out = gone[key] = set()
        if sum(size):
            if tuple(p) in whole:
                out.update(range(len(p)))
            whole.add(tuple(p))
        # a run is repeated only if all its shorter ones are, so runs grow while they are known
        for i in range(len(p)):
            words = 0
            for j in range(i, len(p)):
                words += size[j]
                if words < min_words or j == i:
                    if not (i == j and words >= lone_words):
                        continue
                elif j - i + 1 < min_sentences:
                    continue
                run = tuple(p[i : j + 1])
                if run in seen and seen[run] < (key, i):
                    out.update(range(i, j + 1))
                elif run not in seen:
                    seen[run] = (key, i)
                if j - i > 60:
                    break  # longer runs hold these
    return {(k[0], k[2]): ("".join(x for i, x in enumerate(keyed[k]) if i not in g).rstrip() if g else k[2], len(g)) for k, g in gone.items()}


def check(docs):
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).collect()
    want = plain(rows)
    expect = sorted(repr((r.doc_id, *(want[(float("inf") if r.doc_id is None else r.doc_id, r.text)] if r.text else (r.text, 0)))) for r in rows)
    got = sorted(repr((r.doc_id, r.text, r.n_removed)) for r in spans.without_repeats(docs).collect())
    assert got == expect


def test_documents(spark, sf_dir):
    check(table(spark, sf_dir, "documents"))


def test_odd_rows(spark):
    check(odd_documents(spark))
    assert spans.without_repeats(no_documents(spark)).collect() == []


def test_planted_passage_stays_once(spark):
    passage = " ".join(f"Word{i} of the passage number {i} goes on here." for i in range(9))
    own = ["Only the first has this. ", "Second start is another one! ", "Third? "]
    docs = spark.createDataFrame([(i, own[i] + passage + f" Ending of {i} differs from all.") for i in range(3)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in spans.without_repeats(docs).collect()}
    assert out[0] == own[0] + passage + " Ending of 0 differs from all."
    assert out[1] == own[1] + "Ending of 1 differs from all."
    assert out[2] == own[2] + "Ending of 2 differs from all."


def every_run(texts, min_sentences=2, min_words=20, lone_words=40):
    """Removed sentences by text, comparing every run of sentences that is long enough, and whole texts."""
    seen, gone = set(), []
    for text in texts:
        p = [tuple(text[a:b].lower().split()) for a, b in spans.sentences(text)]
        out = set()
        for i in range(len(p)):
            for j in range(i, len(p)):
                words = sum(map(len, p[i : j + 1]))
                if words >= min_words and j - i + 1 >= min_sentences or i == j and words >= lone_words or words and j - i + 1 == len(p):
                    run = (tuple(p[i : j + 1]), j - i + 1 == len(p) and (words < min_words or len(p) < min_sentences) and words < lone_words)
                    if run in seen:
                        out.update(range(i, j + 1))
                    seen.add(run)
        gone.append(out)
    return gone


def test_every_run_of_sentences_counts(spark):
    rng = random.Random(3)
    pool = [" ".join(f"s{k}w{x}" for x in range(rng.choice([1, 4, 9, 12, 15, 26, 39, 40, 55]))) + ". " for k in range(30)]
    texts = []
    for _ in range(150):
        at, n = rng.randrange(30), rng.randint(1, 6)
        texts.append("".join([f"own {rng.random()} start. "] * rng.randint(0, 1) + pool[at : at + n] + [f"own {rng.random()} end. "] * rng.randint(0, 1)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in spans.without_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [len(x) for x in every_run(texts)]


def test_later_exact_copies_become_empty(spark, sf_dir):
    lone = [" ".join(f"t{k}w{i}" for i in range(n)) + ". " for k, n in enumerate([12, 12, 40, 26])]
    made = spark.createDataFrame([(1_000_000 + i, t) for i, t in enumerate(["".join(lone), "".join(lone), "Short one.", "Short one."])], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionAll(made)
    first, copies = {}, []
    for r in sorted(docs.where("length(trim(text)) > 0").collect(), key=lambda r: r.doc_id):
        if first.setdefault(r.text, r.doc_id) != r.doc_id:
            copies.append(r.doc_id)
    out = {r.doc_id: r.text for r in spans.without_repeats(docs).collect()}
    assert len(copies) > 10 and all(out[i] == "" for i in copies)


def shuffled(spark):
    """Bytes that completed stages wrote to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_span_moves_once_at_most(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    read = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled(spark)
    spans.without_repeats(docs).write.format("noop").mode("overwrite").save()
    moved = shuffled(spark) - before
    assert 0 < moved < 0.8 * read  # 1.3 when spans moved to be counted and again to be joined


def test_chunks_make_no_difference(spark):
    passage = " ".join(f"Word{i} of the passage number {i} goes on here." for i in range(9))
    texts = [f"Start {i} is its own. {passage} {passage if i % 3 == 0 else ''} End {i % 5} is shared by some others of these texts." for i in range(40)]
    rows = [(None if i % 10 == 9 else i % 30, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:7], "doc_id long, text string").repartition(2)
    check(docs)

    def covered(found):
        return sorted((r.doc_id, r.key, sorted(map(tuple, r.covered))) for r in spans.repeats_of(found).collect())

    want = covered(spans.spans_of(docs))
    for chunk in (1, 30, 100):
        assert covered(spans.spans_of(docs, chunk=chunk)) == want


def test_a_frequent_passage_is_one_row_a_chunk(spark):
    passage = " ".join(f"Word{i} of the passage number {i} goes on here." for i in range(9))
    docs = spark.createDataFrame([(i, f"Start {i} is its own. {passage}") for i in range(1000)], "doc_id long, text string").coalesce(1)
    found = spans.spans_of(docs).where("NOT later").groupBy("hash", "more").count()
    assert found.agg(F.max("count")).first()[0] == 1
    assert spans.without_repeats(docs).agg(F.sum("n_removed")).first()[0] == 999 * 9
