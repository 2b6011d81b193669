"""DuckDB SQL for the registered queries: each statement stands alone on the raw tables."""

from __future__ import annotations

from lexigraph.functions.text import STEP2, STEP3, STEP4, STOP_WORDS, stem_word, tokenize_text
from lexigraph.functions.web import UNSEEN
from lexigraph.sources.files import EXTENSIONS

SINGLE = "license"
MULTI = "attion thanedble license"
DUPLICATE = "ention ention license"
BATCH = (SINGLE, MULTI, DUPLICATE, "ention thatin", "erth", "attion", "thanedble anea", "here attion erth", "no such words", "erheit", "ciónbo", "license license attion")
PHRASE2 = "attion thanedble"
PHRASE3 = "attion thanedble anea"
BOOLEAN = {
    "bool_and": "attion AND thanedble",
    "bool_or": "ention OR thatin",
    "bool_not": "ention NOT erth",
    "bool_only_not": "NOT ention",
    "bool_nested": "(ention OR thatin) AND erth -here",
}
FUZZY = tuple(tokenize_text("ention thatin license"))
SUGGEST = ("licens", "attio", "thanedbl")
SPELL = ("licence attoin", "memroy thanedble", "ention erth", "thatni x lisense")
CLOSED = ("/en/1", "/de/", "/es/77")


def _m(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[aeiou][^aeiou]'))"


def _cvc(x: str) -> str:
    return f"regexp_matches({x}, '[^aeiou][aeiou][^aeiouwxy]$')"


def _rules(rules: dict[str, str]) -> str:
    lines = [f"WHEN w LIKE '%{s}' THEN CASE WHEN {_m(f'left(w, -{len(s)})')} > 0 THEN left(w, -{len(s)}) || '{r}' ELSE w END" for s, r in rules.items()]
    return "CASE " + " ".join(lines) + " ELSE w END"


def _removals() -> str:
    lines = []
    for s in STEP4:
        head = f"left(w, -{len(s)})"
        more = f" AND regexp_matches({head}, '[st]$')" if s == "ion" else ""
        lines.append(f"WHEN w LIKE '%{s}' THEN CASE WHEN {_m(head)} > 1{more} THEN {head} ELSE w END")
    return "CASE " + " ".join(lines) + " ELSE w END"


def words(source: str = "SELECT doc_id, text AS body FROM documents") -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
docs AS ({source}),
raw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(body, '')), '[^\\pL\\pN]+'), lambda w: strlen(w) > 1) AS ws FROM docs),
kept AS (SELECT doc_id, list_filter(ws, lambda w: w NOT IN ({stop})) AS ws FROM raw),
spots AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM kept),
s0 AS (SELECT DISTINCT word, word AS w FROM spots),
s1 AS (SELECT word, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END AS w FROM s0),
s2 AS (SELECT word, w, CASE WHEN w LIKE '%eed' THEN NULL
         WHEN w LIKE '%ed' AND regexp_matches(left(w, -2), '[aeiou]') THEN left(w, -2)
         WHEN w LIKE '%ing' AND regexp_matches(left(w, -3), '[aeiou]') THEN left(w, -3) END AS cut FROM s1),
s3 AS (SELECT word, CASE
         WHEN cut IS NOT NULL AND regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e'
         WHEN cut IS NOT NULL AND len(cut) > 1 AND right(cut, 1) = left(right(cut, 2), 1) AND regexp_matches(cut, '[^aeioulsz]$') THEN left(cut, -1)
         WHEN cut IS NOT NULL AND {_m('cut')} = 1 AND {_cvc('cut')} THEN cut || 'e'
         WHEN cut IS NOT NULL THEN cut
         WHEN w LIKE '%eed' AND {_m('left(w, -3)')} > 0 THEN left(w, -1)
         ELSE w END AS w FROM s2),
s4 AS (SELECT word, CASE WHEN w LIKE '%y' AND regexp_matches(left(w, -1), '[aeiou]') THEN left(w, -1) || 'i' ELSE w END AS w FROM s3),
s5 AS (SELECT word, {_rules(STEP2)} AS w FROM s4),
s6 AS (SELECT word, {_rules(STEP3)} AS w FROM s5),
s7 AS (SELECT word, {_removals()} AS w FROM s6),
s8 AS (SELECT word, CASE WHEN w LIKE '%e' AND ({_m('left(w, -1)')} > 1 OR {_m('left(w, -1)')} = 1 AND NOT {_cvc('left(w, -1)')}) THEN left(w, -1) ELSE w END AS w FROM s7),
s9 AS (SELECT word, CASE WHEN w LIKE '%ll' AND {_m('left(w, -1)')} > 1 THEN left(w, -1) ELSE w END AS w FROM s8),
dictionary AS (SELECT word, CASE WHEN strlen(word) <= 2 THEN word ELSE w END AS term FROM s9),
tokens AS (SELECT doc_id, dl, pos, term FROM spots JOIN dictionary USING (word)),
postings AS (SELECT term, doc_id, count(*)::INT AS tf, any_value(dl) AS dl, list(pos ORDER BY pos) AS positions FROM tokens GROUP BY term, doc_id),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
corpus AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM kept)"""


WORDS = words()
PAGES = r"""SELECT page_id AS doc_id, regexp_replace(url, '#.*$', '') AS path, __TITLE__ AS title, __TEXT__ AS body FROM pages"""


def _decoded(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _title() -> str:
    found = f"trim({_decoded(chr(39).join(['regexp_extract(html, ', '(?is)<title[^>]*>(.*?)</title>', ', 1)']))})"
    return f"CASE WHEN {found} = '' THEN url ELSE {found} END"


def _text() -> str:
    seen = "regexp_replace(html, '(?is)<!--.*?-->', '', 'g')"
    for tag in UNSEEN:
        seen = f"regexp_replace({seen}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '<>', 'g')"
    nodes = f"list_transform(string_split_regex({seen}, '<[^>]*>'), lambda x: regexp_replace({_decoded('x')}, '^\\s+|\\s+$', '', 'g'))"
    return f"array_to_string(list_transform(list_filter({nodes}, lambda x: x <> ''), lambda x: x || ' '), '')"


PAGE_DOCS = PAGES.replace("__TITLE__", _title()).replace("__TEXT__", _text())


def scores(queries: list[list[str]]) -> str:
    """CTEs asked and found (query_id, doc_id, score, matched_terms)."""
    rows = [(q, t, terms.count(t), terms.index(t)) for q, terms in enumerate(queries) for t in dict.fromkeys(terms)]
    values = ", ".join(f"({q}, '{t}', {n}, {p})" for q, t, n, p in rows)
    return f"""
asked(query_id, term, weight, qpos) AS (VALUES {values}),
found AS (
  SELECT query_id, doc_id,
         sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score,
         string_agg(term, ' ' ORDER BY qpos) AS matched_terms
  FROM asked JOIN postings USING (term) JOIN terms USING (term), corpus GROUP BY query_id, doc_id)"""


def _top(queries: list[list[str]], k: int, columns: str = "", source: str = WORDS, where: str = "") -> str:
    return f"""WITH {source}, {scores(queries)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM found {where})
SELECT {columns} doc_id, round(score, 6) AS score, matched_terms FROM ranked WHERE rank <= {k}"""


def _phrase(text: str) -> str:
    """doc_id with the terms in a row, by self-joins."""
    terms = tokenize_text(text)
    joins = " ".join(f"JOIN tokens t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{t}'" for i, t in enumerate(terms) if i)
    return f"SELECT DISTINCT t0.doc_id FROM tokens t0 {joins} WHERE t0.term = '{terms[0]}'"


def _has(word: str) -> str:
    return f"SELECT doc_id FROM postings WHERE term = '{stem_word(word)}'"


NESTED = f"(({_has('ention')}) UNION ({_has('thatin')})) INTERSECT ({_has('erth')}) EXCEPT ({_has('here')})"
SETS = {
    "bool_and": f"({_has('attion')}) INTERSECT ({_has('thanedble')})",
    "bool_or": f"({_has('ention')}) UNION ({_has('thatin')})",
    "bool_not": f"({_has('ention')}) EXCEPT ({_has('erth')})",
    "bool_only_not": f"(SELECT doc_id FROM kept) EXCEPT ({_has('ention')})",
    "bool_nested": NESTED,
}


def _near(asked: tuple[str, ...], prune: bool) -> str:
    """asked x terms with distance; letters beyond ASCII stand for no letter of the ASCII words asked for, so one mark serves for all."""
    values = ", ".join(f"('{w}')" for w in asked)
    bytes_ = "AND abs(strlen(word) - strlen(term)) <= 2" if prune else ""
    return f"""
words(word) AS (VALUES {values}),
near AS (SELECT word, term, damerau_levenshtein(word, regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g'))::INT AS dist
         FROM words, terms WHERE abs(len(word) - len(term)) <= 2 {bytes_})"""


GRAPH = f"""
next_ AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS dst FROM lineitem),
edges AS (SELECT src, dst FROM next_ WHERE dst IS NOT NULL UNION SELECT l_suppkey, l_partkey + 1000000000 FROM lineitem),
nodes AS (SELECT s_suppkey AS id FROM supplier UNION ALL SELECT p_partkey + 1000000000 FROM part),
degrees AS (SELECT id, coalesce(c, 0) AS out_degree FROM nodes LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) ON src = id)"""

RANKS = f"""{GRAPH},
size AS (SELECT count(*) AS n FROM nodes),
ways AS (SELECT src, dst, 1.0::DOUBLE / out_degree AS w FROM edges JOIN degrees ON src = id WHERE src <> dst AND dst IN (SELECT id FROM nodes)
         UNION ALL SELECT id, id, 0 FROM nodes),
pr(i, id, pr) AS (
  SELECT 0, id, 1.0::DOUBLE / n FROM nodes, size
  UNION ALL
  SELECT i + 1, dst, 0.15::DOUBLE / n + 0.85::DOUBLE * loose / n + 0.85::DOUBLE * sum(pr * w)
  FROM (SELECT i, p.id, pr, sum(CASE WHEN out_degree = 0 THEN pr ELSE 0 END) OVER () AS loose FROM pr p JOIN degrees d ON p.id = d.id WHERE i < 30) x
  JOIN ways ON src = x.id, size
  GROUP BY i, dst, n, loose),
ranks AS (SELECT id AS doc_id, pr FROM pr WHERE i = 30)"""


def _rerank(source: str, ranks: bool) -> str:
    terms = ", ".join(f"'{t}'" for t in tokenize_text(MULTI))
    # the boosts' words are few distinct ones: they are stemmed by the same dictionary steps over titles and paths
    both = words("SELECT doc_id, title || ' ' || path AS body FROM pool").replace("docs AS", "b_docs AS")
    names = ("raw", "kept", "spots", *(f"s{i}" for i in range(10)), "dictionary")
    own = both[: both.index("tokens AS")].rstrip().rstrip(",")
    for name in ("docs", *names):
        own = own.replace(f"FROM {name})", f"FROM b_{name})").replace(f"FROM {name}),", f"FROM b_{name}),").replace(f"\n{name} AS", f"\nb_{name} AS")
    boost = "(1 + 0.35::DOUBLE * ln(1 + coalesce(pr, 0) * (SELECT count(*) FROM ranks)))" if ranks else "1"
    join = "LEFT JOIN ranks USING (doc_id)" if ranks else ""
    return f"""WITH RECURSIVE {WORDS if source == 'documents' else words(PAGE_DOCS)}, {scores([tokenize_text(MULTI)])}{',' + RANKS if ranks else ''},
best AS (SELECT * FROM found ORDER BY round(score, 9) DESC, doc_id LIMIT 50),
pool AS (SELECT doc_id, {'lang AS title, source AS path FROM documents' if source == 'documents' else 'title, path FROM docs'} WHERE doc_id IN (SELECT doc_id FROM best)),
sides AS (SELECT doc_id, 't' AS side, title AS body FROM pool UNION ALL SELECT doc_id, 'p', path FROM pool),
pieces AS (SELECT doc_id, side, unnest(list_filter(string_split_regex(lower(coalesce(body, '')), '[^\\pL\\pN]+'), lambda w: strlen(w) > 1)) AS word FROM sides),
hits AS (SELECT doc_id, bool_or(side = 't') AS in_title, bool_or(side = 'p') AS in_path FROM pieces WHERE word IN (SELECT word FROM dictionary WHERE term IN ({terms})) GROUP BY doc_id),
boosted AS (SELECT doc_id, matched_terms,
              score * CASE WHEN in_title THEN 1.6::DOUBLE ELSE 1 END * CASE WHEN in_path THEN 1.2::DOUBLE ELSE 1 END * {boost} AS score
            FROM best LEFT JOIN hits USING (doc_id) {join})
SELECT doc_id, round(score, 6) AS score, matched_terms FROM boosted ORDER BY round(score, 9) DESC, doc_id LIMIT 20"""


LINKS = f"""
hrefs AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1) AS hs FROM pages),
links AS (SELECT page_id, url, unnest(hs) AS href, (generate_subscripts(hs, 1) - 1)::INT AS place FROM hrefs),
decoded AS (SELECT *, {_decoded('href')} AS h FROM links),
targets AS (SELECT page_id, place, href, CASE WHEN regexp_matches(h, '^https?://') THEN regexp_replace(h, '#.*$', '')
              WHEN regexp_matches(h, '^/([^/]|$)') THEN regexp_replace(regexp_extract(url, '^(https?://[^/?#]+)', 1) || h, '#.*$', '') END AS target FROM decoded)"""

VBYTE = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"
CODE = """CASE WHEN {x} < 128 THEN format('{{:02X}}', {x}) WHEN {x} < 16384 THEN format('{{:02X}}{{:02X}}', ({x}) % 128 + 128, ({x}) // 128)
  ELSE format('{{:02X}}{{:02X}}{{:02X}}', ({x}) % 128 + 128, ({x}) // 128 % 128 + 128, ({x}) // 16384) END"""
GAPS = "gaps AS (SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM postings)"
PLACES = f"""places AS (SELECT term, doc_id, unnest(positions) AS pos FROM postings),
steps AS (SELECT term, doc_id, pos - coalesce(lag(pos) OVER (PARTITION BY term, doc_id ORDER BY pos), 0) AS gap FROM places),
coded AS (SELECT term, doc_id, ({VBYTE.format('count(*)')} + sum({VBYTE.format('gap')}))::BIGINT AS bytes, count(*) AS n FROM steps GROUP BY term, doc_id)"""
SIZE = "CASE WHEN {0} < 1024 THEN {0} || ' B' WHEN {0} < 1048576 THEN format('{{:.1f}} KB', {0} / 1024.0::DOUBLE) WHEN {0} < 1073741824 THEN format('{{:.1f}} MB', {0} / 1048576.0::DOUBLE) ELSE format('{{:.1f}} GB', {0} / 1073741824.0::DOUBLE) END"
PATH = r"regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
HOST = r"lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


def _kept(x: str, chars: str) -> str:
    """x, which is percent-encoded, with these characters as they are."""
    for c in chars:
        x = f"replace({x}, '%{ord(c):02X}', {chr(39) * 4 if c == chr(39) else repr(c)})"
    return x


def _spell() -> str:
    rows = []
    for q, query in enumerate(SPELL):
        kept = [w for w in query.split() if len(w) > 1]
        rows += [(q, query, i, w, stem_word(w.lower())) for i, w in enumerate(kept)]
    values = ", ".join(f"({q}, '{query}', {i}, '{w}', '{s}')" for q, query, i, w, s in rows)
    return f"""WITH {WORDS},
asked(q, query, place, original, word) AS (VALUES {values}),
near AS (SELECT q, place, term, damerau_levenshtein(word, regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g')) AS dist
         FROM asked, terms WHERE abs(len(word) - len(term)) <= 2 AND word NOT IN (SELECT term FROM terms)),
best AS (SELECT q, place, term FROM near WHERE dist BETWEEN 1 AND 2 QUALIFY row_number() OVER (PARTITION BY q, place ORDER BY dist, term) = 1)
SELECT query, CASE WHEN count(b.term) > 0 THEN string_agg(coalesce(b.term, original), ' ' ORDER BY place) END AS corrected
FROM asked a LEFT JOIN best b USING (q, place) GROUP BY query"""


def _snippets() -> str:
    return f"""WITH {WORDS}, {scores([tokenize_text(MULTI)])},
best AS (SELECT doc_id, string_split(matched_terms, ' ') AS ts FROM found ORDER BY round(score, 9) DESC, doc_id LIMIT 10),
texts AS (SELECT doc_id, ts, regexp_extract_all(body, '[^\\s\\x0B]+') AS ws FROM best JOIN docs USING (doc_id)),
marked AS (SELECT doc_id, ws, list_transform(ws, lambda w: len(list_filter(ts, lambda t:
             contains(regexp_replace(lower(w), '[^\\pL\\pN]', '', 'g'), t) OR contains(t, regexp_replace(lower(w), '[^\\pL\\pN]', '', 'g')))) > 0) AS hit FROM texts),
centred AS (SELECT doc_id, ws, greatest(coalesce(list_position(hit, true), 1), 1) AS c FROM marked)
SELECT doc_id, CASE WHEN c > 9 THEN '...' ELSE '' END || array_to_string(ws[greatest(c - 8, 1) : least(c + 8, len(ws))], ' ') || CASE WHEN c + 8 < len(ws) THEN '...' ELSE '' END AS snippet
FROM centred"""


def _fuzzy_search() -> str:
    """Terms of the expansion, each as often as it is asked for. Stemming an expanded term again is a row of the second dictionary."""
    own = ", ".join(f"('{t}', '{stem_word(t)}', {i})" for i, t in enumerate(FUZZY))
    again = words("SELECT 0 AS doc_id, string_agg(term, ' ' ORDER BY nr) AS body FROM listed")
    again = again[: again.index("postings AS")].rstrip().rstrip(",")
    names = ["docs", "raw", "kept", "spots", *(f"s{i}" for i in range(10)), "dictionary", "tokens"]
    import re

    again = re.sub(r"\b(" + "|".join(names) + r")\b(?= AS \(|\)| JOIN| USING|,)", r"x_\1", again)
    again = re.sub(r"(FROM|JOIN) (" + "|".join(names) + r")\b", r"\1 x_\2", again)
    return f"""WITH {WORDS}, {_near(tuple(dict.fromkeys(stem_word(t) for t in FUZZY)), True)},
own(original, word, place) AS (VALUES {own}),
mentions AS (SELECT original AS term, place, 0 AS dist FROM own
  UNION ALL SELECT n.term, place, dist FROM near n JOIN own USING (word) WHERE dist BETWEEN 1 AND 2),
firsts AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY place, dist, term) AS nth FROM mentions),
listed AS (SELECT term, place * 1000000 + row_number() OVER (PARTITION BY place ORDER BY dist, term) AS nr FROM firsts WHERE nth = 1 OR dist = 0),
{again},
asked AS (SELECT 0 AS query_id, term, count(*) AS weight, min(pos) AS qpos FROM x_tokens GROUP BY term),
found AS (
  SELECT query_id, doc_id,
         sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score,
         string_agg(term, ' ' ORDER BY qpos) AS matched_terms
  FROM asked JOIN postings USING (term) JOIN terms USING (term), corpus GROUP BY query_id, doc_id)
SELECT doc_id, round(score, 6) AS score, matched_terms FROM found ORDER BY round(score, 9) DESC, doc_id LIMIT 20"""


def oracle_sql() -> dict[str, str]:
    multi = [tokenize_text(MULTI)]
    wanted = ", ".join(f"'{t}'" for t in sorted(set(multi[0])))
    one_site = r"regexp_extract(url, '^(https?://[^/]+)', 1)"
    merged = words(
        "SELECT doc_id, text AS body FROM documents UNION ALL SELECT id, text FROM "
        "(SELECT conv_id * 100 + turn + (SELECT coalesce(max(doc_id), -1) + 1 FROM documents) AS id, text FROM conversations) WHERE id NOT IN (SELECT doc_id FROM documents)"
    )
    out = {
        "tokenize_raw": f"WITH {WORDS} SELECT doc_id, unnest(ws) AS word, (generate_subscripts(ws, 1) - 1)::INT AS pos FROM raw",
        "stopword_filtered": f"WITH {WORDS} SELECT word, count(*) AS n FROM spots GROUP BY word",
        "token_positions": f"WITH {WORDS} SELECT doc_id, pos::INT AS pos, term FROM tokens",
        "stem_terms": f"WITH {WORDS} SELECT word, term FROM dictionary",
        "postings": f"WITH {WORDS} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM postings",
        "term_df": f"WITH {WORDS} SELECT term, df FROM terms",
        "doc_lengths": f"WITH {WORDS} SELECT doc_id, len(ws)::INT AS dl FROM kept",
        "index_stats": f"WITH {WORDS} SELECT n AS documents, (SELECT count(*) FROM terms) AS unique_terms, (SELECT count(*) FROM postings) AS total_postings, round(avgdl, 6) AS avg_doc_length FROM corpus",
        "bm25_single": _top([tokenize_text(SINGLE)], 10),
        "bm25_multi": _top(multi, 20),
        "bm25_dup_term": _top([tokenize_text(DUPLICATE)], 10),
        "bm25_batch": _top([tokenize_text(q) for q in BATCH], 10, "query_id, rank,"),
        "bm25_by_lang": f"""WITH {WORDS}, {scores(multi)},
ranked AS (SELECT f.*, lang, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM found f JOIN documents USING (doc_id))
SELECT lang, rank, doc_id, round(score, 6) AS score, matched_terms FROM ranked WHERE rank <= 5""",
        "all_terms": f"WITH {WORDS} SELECT doc_id FROM postings WHERE term IN ({wanted}) GROUP BY doc_id HAVING count(*) = {len(set(multi[0]))}",
        "phrase2": f"WITH {WORDS} {_phrase(PHRASE2)}",
        "phrase3": f"WITH {WORDS} {_phrase(PHRASE3)}",
        "phrase_ranked": f"""WITH {WORDS}, {scores([tokenize_text(PHRASE2)])},
pool AS (SELECT * FROM found ORDER BY round(score, 9) DESC, doc_id LIMIT 50)
SELECT doc_id, round(score, 6) AS score, matched_terms FROM pool WHERE doc_id IN ({_phrase(PHRASE2)}) ORDER BY round(score, 9) DESC, doc_id LIMIT 10""",
        "bool_sets": f"WITH {WORDS} {NESTED}",
        "bool_ranked": f"""WITH {WORDS}, {scores([tokenize_text(' '.join(stem_word(w) for w in ('ention', 'thatin', 'erth')))])},
pool AS (SELECT * FROM found ORDER BY round(score, 9) DESC, doc_id LIMIT 200)
SELECT doc_id, round(score, 6) AS score, matched_terms FROM pool WHERE doc_id IN ({NESTED}) ORDER BY round(score, 9) DESC, doc_id LIMIT 20""",
        "levenshtein_terms": f"""WITH {WORDS}, words(word) AS (VALUES {', '.join(f"('{w}')" for w in FUZZY)})
SELECT word, term, levenshtein(word, regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g'))::INT AS dist FROM words, terms
WHERE abs(len(word) - len(term)) <= 2 AND levenshtein(word, regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g')) <= 2""",
        "fuzzy_expand": f"""WITH {WORDS}, {_near(tuple(dict.fromkeys(stem_word(t) for t in FUZZY)), True)},
own(stem, original) AS (VALUES {', '.join(f"('{stem_word(t)}', '{t}')" for t in FUZZY)})
SELECT original AS word, term, dist FROM near JOIN own ON stem = word WHERE dist BETWEEN 1 AND 2""",
        "spell_suggest": f"""WITH {WORDS}, {_near(SUGGEST, False)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, term)::INT AS rank FROM near WHERE dist BETWEEN 1 AND 2)
SELECT word, rank, term, dist FROM ranked WHERE rank <= 5""",
        "spell_correct": _spell(),
        "pagerank": f"WITH RECURSIVE {RANKS} SELECT doc_id, round(pr, 9) AS pr FROM ranks",
        "pagerank_summary": f"WITH RECURSIVE {RANKS} SELECT round(max(pr), 9) AS max_pr, round(avg(pr), 9) AS avg_pr FROM ranks",
        "out_degree": f"WITH {GRAPH} SELECT id, out_degree FROM degrees",
        "in_links": f"WITH {GRAPH} SELECT dst, count(*) AS in_degree FROM edges WHERE src <> dst AND dst IN (SELECT id FROM nodes) GROUP BY dst",
        "dangling": f"WITH {GRAPH} SELECT id FROM degrees WHERE out_degree = 0",
        "rerank_title_path": _rerank("pages", False),
        "rerank_pagerank": _rerank("documents", True),
        "html_title": f"SELECT doc_id AS page_id, title FROM ({PAGE_DOCS})",
        "html_text": f"SELECT doc_id AS page_id, body AS text FROM ({PAGE_DOCS})",
        "html_links": f"WITH {LINKS} SELECT page_id, place, href, target FROM targets",
        "link_resolve": f"""WITH {LINKS},
sites AS (SELECT {one_site} AS url, min(page_id) AS doc_id FROM pages GROUP BY 1),
known AS (SELECT regexp_replace(url, '#.*$', '') AS url, page_id AS doc_id FROM pages UNION ALL SELECT * FROM sites),
every AS (SELECT page_id AS src, target AS url FROM targets UNION ALL SELECT page_id, {one_site} FROM pages)
SELECT DISTINCT src, doc_id AS dst FROM every JOIN known USING (url)""",
        "url_normalize": "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages",
        "domain_scope": f"SELECT page_id, {HOST} AS host FROM pages WHERE {HOST} LIKE 'blog.%'",
        "bfs_depth": f"""WITH RECURSIVE {GRAPH},
walk(id, depth) AS (SELECT unnest([1, 2])::BIGINT, 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = id WHERE depth < 3)
SELECT id, min(depth)::INT AS depth FROM walk GROUP BY id""",
        "visited_anti": f"""WITH {GRAPH}, seeds AS (SELECT DISTINCT dst FROM edges WHERE src IN (1, 2))
SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT dst FROM seeds) AND dst NOT IN (SELECT dst FROM seeds)""",
        "robots_allowed": f"SELECT page_id, {PATH} AS path, NOT ({' OR '.join(f'starts_with({PATH}, {c!r})' for c in CLOSED)}) AS allowed FROM pages",
        "page_parse": f"""WITH {LINKS}, counts AS (SELECT page_id, count(target) AS n FROM targets GROUP BY page_id)
SELECT doc_id AS page_id, title, body AS text, coalesce(n, 0)::INT AS n_links FROM ({PAGE_DOCS}) LEFT JOIN counts ON page_id = doc_id""",
        "page_links": f"""WITH {LINKS}, found AS (SELECT page_id, place, url_encode(target) AS t FROM targets WHERE target IS NOT NULL)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INT AS place, {_kept('t', ":/?#,|=&'()*+;!$@[]^")} AS target FROM found""",
        "url_canonical": "SELECT page_id, string_split(url, '#')[1] AS url FROM pages",
        "robots_parsed": f"SELECT page_id, {PATH} || ' /second' AS closed FROM pages",
        "crawl_archive": f"""WITH RECURSIVE p AS (SELECT page_id, string_split(url, '#')[1] AS url, {HOST} AS host FROM pages),
placed AS (SELECT *, row_number() OVER site AS place, min(page_id) OVER (PARTITION BY host) AS start, lead(page_id) OVER site AS onward FROM p WINDOW site AS (PARTITION BY host ORDER BY page_id)),
walk(page_id, start, depth) AS (SELECT page_id, start, 0 FROM placed WHERE place = 1
  UNION ALL SELECT onward, w.start, depth + 1 FROM walk w JOIN placed USING (page_id) WHERE onward IS NOT NULL AND depth < 3),
ranked AS (SELECT page_id, row_number() OVER (ORDER BY depth, start) - 1 AS doc_id FROM walk)
SELECT r.doc_id, url AS path, title, (len(body) + CASE WHEN onward IS NULL THEN 0 ELSE len('next ') END)::INT AS n_chars
FROM ranked r JOIN placed USING (page_id) JOIN ({PAGE_DOCS}) d ON d.doc_id = page_id WHERE r.doc_id < (SELECT greatest(1, count(*) // 2) FROM pages)""",
        "corpus_round_trip": f"WITH {WORDS} SELECT term, df FROM terms",
        "spell_display": f"""WITH {WORDS}, {_near(SUGGEST, False)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, term)::INT AS rank FROM near WHERE dist BETWEEN 1 AND 2)
SELECT word, rank, term || ' (edit distance: ' || dist || ')' AS shown FROM ranked WHERE rank <= 5""",
        "vbyte_bytes": f"""WITH {WORDS}, at_ AS (SELECT term, doc_id, unnest(positions)::BIGINT AS pos FROM postings),
gaps_ AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY term, doc_id ORDER BY pos), 0) AS gap FROM at_)
SELECT term, doc_id, {CODE.format(x='count(*)')} || string_agg({CODE.format(x='gap')}, '' ORDER BY pos) AS code FROM gaps_ GROUP BY term, doc_id""",
        "vbyte_round_trip": f"WITH {WORDS} SELECT term, doc_id, array_to_string(positions, ' ') AS positions FROM postings",
        "vbyte_len": f"WITH {WORDS}, {PLACES} SELECT term, doc_id, bytes FROM coded",
        "delta_gaps": f"WITH {WORDS}, {GAPS} SELECT term, doc_id, gap FROM gaps",
        "compression_stats": f"""WITH {WORDS}, {GAPS}, {PLACES},
lists AS (SELECT {VBYTE.format('count(*)')} + sum({VBYTE.format('gap')}) AS bytes FROM gaps GROUP BY term),
sums AS (SELECT sum(8 + 4 * n)::BIGINT AS a, (sum(bytes + 4) + (SELECT sum(bytes) FROM lists))::BIGINT AS b FROM coded)
SELECT a AS original_bytes, b AS compressed_bytes, round(b::DOUBLE / a, 6) AS ratio, round((1 - b::DOUBLE / a) * 100, 6) AS savings_percent FROM sums""",
        "snippets": _snippets(),
        "format_bytes": f"""WITH sizes AS (SELECT source, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source
UNION ALL SELECT source || '/' || doc_id, strlen(text)::BIGINT FROM documents)
SELECT source, bytes, {SIZE.format('bytes')} AS size FROM sizes""",
        "ext_filter": f"SELECT page_id, regexp_extract({PATH}, '[^/]\\.([^./]*)$', 1) AS extension, regexp_extract({PATH}, '[^/]\\.([^./]*)$', 1) IN ({', '.join(repr(e) for e in EXTENSIONS)}) AS indexable FROM pages",
        "corpus_merge": f"WITH {merged} SELECT term, df FROM terms",
        "incremental_skip": f"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages),
known AS (SELECT url FROM p QUALIFY row_number() OVER (PARTITION BY {one_site} ORDER BY page_id) = 1)
SELECT page_id, url FROM p WHERE url NOT IN (SELECT url FROM known)""",
        "fuzzy_search": _fuzzy_search(),
    }
    return out | {name: f"WITH {WORDS} {sql}" for name, sql in SETS.items()}
