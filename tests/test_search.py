import math
import random
from collections import Counter

import pytest

from lexigraph.functions.text import deletions, tokenize_text
from lexigraph.operators import boolean, fuzzy, graph, ranking
from lexigraph.operators import index as indexes
from lexigraph.plans import catalog

DOCS = "doc_id bigint, path string, title string, body string"


def documents(spark, *bodies, **more):
    return spark.createDataFrame([(i, more.get("path"), more.get("title"), b) for i, b in enumerate(bodies)], DOCS)


@pytest.fixture(scope="module")
def hashes(spark):
    return indexes.build(documents(spark, "hash table hash", "hash map", "binary tree"))


def scores(frame):
    return {r.doc_id: r.score for r in frame.collect()}


def test_bm25_goldens(hashes):
    got = scores(ranking.search(hashes, "hash"))
    assert got == {0: pytest.approx(0.5981864372), 1: pytest.approx(0.4991762683)}
    twice = scores(ranking.search(hashes, "hash hash"))
    assert twice == {k: pytest.approx(2 * v) for k, v in got.items()}
    assert scores(ranking.search(hashes, "the")) == {}


def test_phrases(hashes):
    ids = lambda q: sorted(r.doc_id for r in ranking.phrase_search(hashes, q).collect())
    assert ids("table hash") == ids("hash table") == [0]
    assert ids("hash hash") == []
    assert ids("hash") == [0, 1]


def test_bm25_against_a_plain_model(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame([(i, None, None, t) for i, t in rows] + [(10**6, None, None, ""), (10**6 + 1, None, None, None)], DOCS)
    tokens = {i: tokenize_text(t) for i, t in rows} | {10**6: [], 10**6 + 1: []}
    n, avg = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    query = "attion thanedble ention ention"
    want = Counter()
    for t in tokenize_text(query):
        df = sum(t in x for x in tokens.values())
        for i, x in tokens.items():
            if tf := x.count(t):
                want[i] += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / avg))
    got = scores(ranking.search(indexes.build(docs), query, None))
    assert got == {i: pytest.approx(s) for i, s in want.items()}
    s = indexes.stats(indexes.build(docs)).first()
    assert (s.documents, s.unique_terms) == (n, len({t for x in tokens.values() for t in x}))


def test_rerank(spark, hashes):
    found = ranking.search(hashes, "hash")
    docs = spark.createDataFrame([(0, "/a/tree", "A hash", "x"), (1, "/hash/x", "hash", "y"), (2, None, None, "z")], DOCS)
    plain, boosted = scores(found), scores(ranking.rerank(found, docs, "hash"))
    assert boosted == {0: pytest.approx(plain[0] * 1.6), 1: pytest.approx(plain[1] * 1.6 * 1.2)}
    ranks = spark.createDataFrame([(0, 0.5), (7, 0.5)], "doc_id bigint, pr double")
    ranked = scores(ranking.rerank(found, docs, "hash", ranks))
    assert ranked == {0: pytest.approx(boosted[0] * 1.242601513), 1: pytest.approx(boosted[1])}
    assert scores(ranking.rerank(found, docs, "the")) == plain


def test_snippets(spark):
    from pyspark.sql import functions as F

    def cut(body, terms, n):
        frame = spark.createDataFrame([(body, terms)], "b string, t array<string>")
        return frame.select(ranking.snippet(F.col("b"), F.col("t"), n)).first()[0]

    assert cut("The quick brown — fox jumps over the lazy dog again", ["fox"], 2) == "...quick brown — fox jumps..."
    assert cut("see a data table", ["data"], 1) == "see a data..."
    assert cut("none here at all", ["zzz"], 1) == "none here..."
    assert cut(None, ["x"], 3) == cut("", ["x"], 3) == ""


PARSED = {
    "tcp AND socket": "(tcp AND socket)", "tcp socket": "(tcp AND socket)", "tcp and socket": "(tcp AND socket)", "tcp NOT udp": "(tcp AND NOT udp)",
    "a OR b c": "(a OR (b AND c))", "(tcp OR udp) AND socket": "((tcp OR udp) AND socket)", "leader election": "(leader AND elect)",
    "-udp tcp": "(NOT udp AND tcp)", "-(tcp udp)": "(tcp AND udp)", "foo-bar": "foo-bar", "(tcp": "tcp", "tcp) udp": "tcp",
    '"tcp" a.b': "(tcp AND (a AND b))".replace("(tcp AND (a AND b))", "((tcp AND a) AND b)"),
}


@pytest.mark.parametrize(("query", "text"), PARSED.items())
def test_boolean_parser(query, text):
    assert str(boolean.parse(query)) == text


@pytest.mark.parametrize("query", ["", "()", "tcp OR", "OR tcp", "NOT NOT tcp", "tcp AND OR udp"])
def test_boolean_failures(query):
    assert boolean.parse(query) is None


def test_boolean_search(spark):
    i = indexes.build(documents(spark, "tcp socket", "udp socket", "tcp udp", "", "license tcp"))
    ids = lambda q: sorted(r.doc_id for r in boolean.matching(i, boolean.parse(q)).collect())
    for q, want in (("tcp AND socket", [0]), ("tcp OR udp", [0, 1, 2, 4]), ("NOT tcp", [1, 3]), ("(tcp OR udp) NOT socket", [2, 4]), ("foo-bar", [])):
        assert ids(q) == want == sorted(r.doc_id for r in boolean.matching_by_sets(i, boolean.parse(q)).collect())
    only_not = boolean.boolean_search(i, "NOT tcp")
    assert only_not.matching_docs() == 2 and only_not.results.collect() == []
    stemmed_twice = boolean.boolean_search(i, "license")
    assert stemmed_twice.matching_docs() == 1 and stemmed_twice.results.collect() == []
    assert sorted(scores(boolean.boolean_search(i, "tcp -udp").results)) == [0, 4]


def test_distances(spark):
    for a, b, d in (("ca", "abc", 3), ("memroi", "memori", 1), ("", "abc", 3), ("allocaton", "alloc", 4), ("helo", "hello", 1)):
        assert fuzzy.osa(a, b) == fuzzy.osa(b, a) == d
    terms = spark.createDataFrame([(t,) for t in ("hello", "help", "hell", "world", "word")], "term string")
    near = {(r.word, r.term): r.dist for r in fuzzy.near_terms(terms, ["helo", "hello"], 1).collect()}
    assert near == {("helo", "hello"): 1, ("helo", "help"): 1, ("helo", "hell"): 1, ("hello", "hello"): 0, ("hello", "hell"): 1}
    other = spark.createDataFrame([(t,) for t in ("consensus", "concurrent", "connection", "constant")], "term string")
    assert fuzzy.suggest(other, ["concensus"], 2, 3).first().term == "consensus"


def test_corrections(spark):
    words = "consensu protocol memori alloc encryption algorithm databas index".split()
    terms = spark.createDataFrame([(t,) for t in words], "term string")
    for query, want in (
        ("concensus protocl", "consensu protocol"), ("memroy allocaton", "memori allocaton"), ("encyption algorthm", "encryption algorithm"),
        ("databse indx", "databas index"), ("memory index", None), ("x memroy", "memori"), ("", None),
    ):
        assert fuzzy.correct_query(terms, query) == want


def test_fuzzy_search(spark):
    i = indexes.build(documents(spark, "hash table", "hatch door", "binary tree"))
    found = fuzzy.fuzzy_search(i, "hach")
    assert found.expanded == ["hach", "hash", "hatch"] and sorted(scores(found.results)) == [0, 1]
    assert found.corrections == [("hach", "hash", 1), ("hach", "hatch", 1)]


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([(0, 1), (0, 2), (1, 2), (2, 0)], [0.369324, 0.204582, 0.378476, 0.047619]),
        ([(0, 1), (0, 2), (1, 2), (2, 0), (0, 0)], [0.220950, 0.110223, 0.203914, 0.047619]),
    ],
)
def test_pagerank_goldens(spark, edges, want):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id bigint")
    got = {r.doc_id: r.pr for r in graph.pagerank(nodes, spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert [got[i] for i in range(4)] == pytest.approx(want, abs=1e-5)


def test_pagerank_of_nothing(spark):
    assert graph.pagerank(spark.createDataFrame([], "id bigint"), spark.createDataFrame([], "src bigint, dst bigint")).collect() == []


def test_neighbours_by_equality_are_those_of_a_scan(spark):
    rng = random.Random(6)
    terms = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(400)} | {"x", "ca", "abc"}
    vocabulary = spark.createDataFrame([(t,) for t in terms], "term string")
    stored = indexes.Index(None, None, vocabulary, None, deletions(vocabulary, "term"))
    words = rng.sample(sorted(terms), 40) + ["", "ac", "zzz", "bca"]
    for most, prune in ((2, False), (1, True)):
        found = [sorted(map(tuple, fuzzy.near_terms(v, words, most, prune).collect())) for v in (vocabulary, stored)]
        assert found[0] == found[1] and len(found[0]) > 40
        if not prune:
            assert found[0] == sorted((w, t, fuzzy.osa(w, t)) for w in set(words) for t in terms if fuzzy.osa(w, t) <= most)


def test_pagerank_with_split_hubs(spark, monkeypatch):
    rng = random.Random(1)
    edges = {(0, i) for i in range(1, 40)} | {(rng.randrange(40), rng.randrange(50)) for _ in range(120)}
    nodes = spark.createDataFrame([(i,) for i in range(50)], "id bigint")
    frame = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    out = Counter(a for a, _ in edges)
    pr = dict.fromkeys(range(50), 1 / 50)
    for _ in range(7):
        loose = sum(p for i, p in pr.items() if not out[i])
        pr = {i: 0.15 / 50 + 0.85 * (loose / 50 + sum(pr[a] / out[a] for a, b in edges if b == i and a != b)) for i in pr}
    monkeypatch.setattr(graph, "HUB_LINKS", 5)
    got = {r.doc_id: r.pr for r in graph.pagerank(nodes, frame, iterations=7).collect()}
    assert got == {i: pytest.approx(p) for i, p in pr.items()}


def test_postings_are_made_without_a_shuffle(spark, monkeypatch):
    """Also of documents over a batch's tokens, and of none; rows of one id are put together."""
    bodies = ["hash tables hash", "", "hashes of trees", None, "tree"]
    want = {("hash", 0): (2, 3, [0, 2]), ("tabl", 0): (1, 3, [1]), ("hash", 2): (1, 2, [0]), ("tree", 2): (1, 2, [1]), ("tree", 4): (1, 1, [0])}
    made = lambda frame: {(r.term, r.doc_id): (r.tf, r.dl, r.positions) for r in indexes.build(frame).postings.collect()}
    for most in (1, 400_000):
        monkeypatch.setattr(indexes, "GROUPED_TOKENS", most)
        assert made(documents(spark, *bodies)) == want
    plan = indexes.build(documents(spark, *bodies)).postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    twice = made(spark.createDataFrame([(7, None, None, "hash tree"), (7, None, None, "tree")], DOCS))
    assert twice["tree", 7][0] == 2 and twice["tree", 7][2] == [0, 1] and twice["hash", 7][2] == [0]


def test_stored_tables_are_written_when_asked_for(spark):
    index = catalog.Stored(indexes.build(documents(spark, "hash table", "table hash table")))
    assert [r.doc_id for r in ranking.phrase_documents(index, tokenize_text("hash table")).orderBy("doc_id").collect()] == [0, 1]
    assert "stored_terms" not in vars(index) and "stored_totals" not in vars(index)
    assert indexes.stats(index).first().total_postings == 4 and index.doc_frequency("hash") == 2


def test_ranks_of_nodes_without_links_are_made_once(spark, monkeypatch):
    """Iterations stage nodes with links only; links to itself, out of the nodes and from outside included."""
    links = {(0, 1), (1, 0), (1, 2), (2, 2), (2, 3), (3, 99), (98, 3), (0, 5), (1, 6)}
    ids, staged = range(9), []
    own = graph.stage
    monkeypatch.setattr(graph, "stage", lambda frame, kind: staged.append((kind, out := own(frame, kind))) or out)
    got = graph.pagerank(spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(sorted(links), "src bigint, dst bigint"), iterations=5)
    degree = Counter(s for s, _ in links)
    want = dict.fromkeys(ids, 1 / 9)
    for _ in range(5):
        loose = sum(x for i, x in want.items() if not degree[i])
        want = {i: 0.15 / 9 + 0.85 * (loose / 9 + sum(want[s] / degree[s] for s, d in links if d == i != s and s in want)) for i in ids}
    assert {r.doc_id: r.pr for r in got.collect()} == {i: pytest.approx(x, abs=1e-12) for i, x in want.items()}
    assert [frame.count() for kind, frame in staged if kind == "ranks"] == [4, 4, 9]
