import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from data import no_documents, odd_documents
from lexigraph.llm import lines
from lexigraph.llm.common import table


def patience(a, b, a0, a1, b0, b1):
    """Plain recursive patience diff."""
    if a0 < a1 and b0 < b1 and a[a0] == b[b0]:
        return [(a0, b0), *patience(a, b, a0 + 1, a1, b0 + 1, b1)]
    if a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
        return [*patience(a, b, a0, a1 - 1, b0, b1 - 1), (a1 - 1, b1 - 1)]
    A, B = a[a0:a1], b[b0:b1]
    unique = [(a0 + i, b0 + B.index(x)) for i, x in enumerate(A) if A.count(x) == 1 and B.count(x) == 1]
    if not unique:
        return []
    unique.sort()
    best = []
    for i, (_, j) in enumerate(unique):
        best.append(1 + max((best[k] for k in range(i) if unique[k][1] < j), default=0))
    # of equally long runs the one with the smallest places in b, from its end backwards
    back = [min((k for k in range(i) if best[k] == best[i] - 1 and unique[k][1] < unique[i][1]), key=lambda k: unique[k][1], default=-1) for i in range(len(unique))]
    i = min((x for x in range(len(unique)) if best[x] == max(best)), key=lambda x: unique[x][1])
    chain = []
    while i >= 0:
        chain.append(unique[i])
        i = back[i]
    out, i0, j0 = [], a0, b0
    for i, j in chain[::-1]:
        out += [*patience(a, b, i0, i, j0, j), (i, j)]
        i0, j0 = i + 1, j + 1
    return out + patience(a, b, i0, a1, j0, b1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=14), st.lists(st.integers(0, 12), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    got = lines.align(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert got == patience(a, b, 0, len(a), 0, len(b))


def plain(rows):
    """Texts by (id, text): a line goes if it is in a run of lines, of enough words, that any earlier text has too; copies of earlier texts lose all lines."""
    at = lambda r: 1 << 63 if r.doc_id is None else r.doc_id
    home = {}
    for r in rows:
        if r.text is not None:
            home[r.text] = min(home.get(r.text, 1 << 64), at(r))
    strip = lambda x: re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", x)
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    cut = {t: [strip(x) for x in t.split("\n")] for t in home}
    kinds = {t: set(c) for t, c in cut.items()}
    gone = {t: set() for t in home}
    for late, b in cut.items():
        for early, a in cut.items():
            if home[early] < home[late] and kinds[early] & kinds[late]:
                for i, j in ((i, j) for j in range(len(b)) if b[j] in kinds[early] for i in range(len(a)) if a[i] == b[j]):
                    if i and j and a[i - 1] == b[j - 1]:
                        continue  # not where a run starts
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if sum(map(words, b[j : j + n])) >= lines.MIN_BLOCK_WORDS:
                        gone[late].update(range(j, j + n))
    out = []
    for r in rows:
        if r.text is None:
            out.append((r.doc_id, None, 0, 0))
            continue
        parts = r.text.split("\n")
        g = set(range(len(parts))) if at(r) > home[r.text] else gone[r.text]
        out.append((r.doc_id, "\n".join(x for i, x in enumerate(parts) if i not in g), len(parts), len(g)))
    return sorted(map(repr, out))


def got(docs):
    return sorted(repr((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in lines.dedup_lines(docs).collect())


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(docs) == plain(docs.collect())


def test_families_and_boilerplate(spark):
    rng = random.Random(2)
    common = "this very common line stands in many of the documents"
    texts = []
    for family in range(4):
        base = [f"family {family} line {i} with words {rng.random()}" for i in range(12)]
        for _ in range(20):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(12)] = f"edited line number {rng.random()} has words too"
            texts.append("\n".join(own))
    texts += [common + f"\nand a line of its own with number {i} in it" for i in range(80)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(docs) == plain(docs.collect())
    kept = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert sum(common in t for t in kept.values()) == 1  # a line of enough words is a block, however many texts have it


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert got(docs) == plain(docs.collect())
    assert lines.dedup_lines(no_documents(spark)).collect() == []
    assert lines.deduplicated(docs).columns == docs.columns


def test_long_lines_of_any_frequency(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [f"opening of text {i} alone\n{passage}\nending of text {i} alone" for i in range(200)]
    pair = ["the first of two lines that many share", "the second of two lines that many share"]
    texts += [f"title {i} of a family of short texts\n{pair[0]}\n{pair[1]}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert kept[0] == texts[0] and kept[200] == texts[200]
    assert all(kept[i] == f"opening of text {i} alone\nending of text {i} alone" for i in range(1, 200))
    assert all(kept[200 + i] == f"title {i} of a family of short texts" for i in range(1, 60))


def all_pairs(texts):
    """Lines that are left of each text when it is aligned with every earlier one."""
    cut = [t.split("\n") for t in texts]
    left = []
    for j, b in enumerate(cut):
        gone = set()
        for a in cut[:j]:
            gone.update(lines.common_blocks(patience(a, b, 0, len(a), 0, len(b)), [len(x.split()) for x in b], lines.MIN_BLOCK_WORDS))
        left.append([x for i, x in enumerate(b) if i not in gone])
    return left


def test_blocks_of_lines_that_first_stood_elsewhere(spark):
    one, two = "first line of five words", "second line that has six words"
    texts = [f"only in a\n{one}\nend of a", f"only in b\n{two}\nend of b", f"c own\n{one}\n{two}\nend of c", f"d own\n{one}\n{two}\nend of d"]
    short = "\n".join(f"short line {i}" for i in range(4))
    texts += [f"e own\n{short}\nend of e", f"f own\n{short}\nend of f"]
    rng = random.Random(5)
    # each line of the pool stands in a text of its own first, then in blocks
    pool = [" ".join(f"p{k}w{x}" for x in range(rng.randint(1, 7))) for k in range(24)]
    texts += [f"holder {k}\n{x}\nheld {k}" for k, x in enumerate(pool)]
    for k in range(60):
        at = rng.randrange(20)
        texts.append("\n".join([f"start {k}", *pool[at : at + rng.randint(2, 5)], f"end {k}"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert kept[3] == "d own\nend of d" and kept[5] == "f own\nend of f"
    assert [kept[i] for i in range(len(texts))] == ["\n".join(x) for x in all_pairs(texts)]


def test_families_against_all_pairs(spark):
    rng = random.Random(2)
    common = "this very common line stands in many of the documents"
    texts = []
    for family in range(4):
        base = [f"family {family} line {i} with words {rng.random()}" for i in range(12)]
        for _ in range(20):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(12)] = f"edited line number {rng.random()} has words too"
            texts.append("\n".join(own))
    rng.shuffle(texts)
    more = [common + f"\nand a line of its own with number {i} in it" for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert [kept[i] for i in range(160)] == ["\n".join(x) for x in all_pairs(texts + more)]


def test_the_same_overlap_in_a_corpus_of_any_size(spark):
    pair = "a shared line of just eight words, really\n"
    removed = []
    for n in (2, 40, 400):
        docs = spark.createDataFrame([(i, f"own words of text {i}\n{pair}end of text {i}") for i in range(n)], "doc_id long, text string")
        removed.append([r.n_removed for r in lines.dedup_lines(docs).orderBy("doc_id").collect()])
    assert [x == [0] + [1] * (len(x) - 1) for x in removed] == [True] * 3


def test_clashing_columns_keep_their_values(spark):
    names = ["doc_id", "text", "n_chars", "_id", "_key", "_gone", "_new", "gone", "key", "left", "at", "mark", "doc", "a`b"]
    same = "these eight words stand in every one document\n"
    docs = spark.createDataFrame([(i, f"{same}own text {i}", 60, *[f"{n}{i}" for n in names[3:]]) for i in range(3)], names)
    rows = sorted(lines.deduplicated(docs).collect(), key=lambda r: r[0])
    assert [r.text for r in rows] == [f"{same}own text 0", "own text 1", "own text 2"] and [r.n_chars for r in rows] == [60, 10, 10]
    assert [tuple(r)[3:] for r in rows] == [tuple(f"{n}{i}" for n in names[3:]) for i in range(3)]


def test_a_row_moves_with_its_text_once(spark, sf_dir):
    """Each row is joined to its deletions with its own strings only: text, lang and source; it had the text twice."""
    docs = table(spark, sf_dir, "documents")
    assert [k for _, k in docs.dtypes].count("string") == 3
    node = lines.deduplicated(docs)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    moved = node.children().apply(0).output()
    kinds = [moved.apply(i).dataType().simpleString() for i in range(moved.size())]
    assert ",".join(kinds).count("string") == 3
