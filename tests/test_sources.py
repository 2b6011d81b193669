import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph import cli, server
from lexigraph.functions import codec, web
from lexigraph.operators import crawl
from lexigraph.operators import index as indexes
from lexigraph.plans import catalog
from lexigraph.plans.engine import SearchEngine, printed
from lexigraph.sources import files, tables
from lexigraph.streaming import ingest

ROBOTS = "User-agent: Bot\nDisallow: /x\nUser-agent: *\nDisallow: /private # c\nDisallow:\nAllow: /private/ok\nUser-agent: other\nDisallow: /y\n"
HTML = '<html><head><title> T </title><style>x</style></head><body><p>one\n<b>two</b> three</p><a href="/k#f">four</a><noscript>n</noscript></body></html>'


@pytest.mark.parametrize("value", [0, 1, 127, 128, 255, 1000, 65535, 1000000, 4294967295])
def test_codec_numbers(value):
    assert codec.decode(codec.encode(value)) == (value, len(codec.encode(value)))


def test_codec_goldens(spark):
    assert codec.encode(200) == b"\xc8\x01" and codec.encode(2**32 - 1) == b"\xff\xff\xff\xff\x0f"
    ids = [3, 7, 15, 42, 100, 500, 501, 502, 10000]
    assert len(codec.compress(ids)) == 12 and codec.decompress(codec.compress(ids)) == ids
    docs = spark.createDataFrame([(0, "hash table hash"), (1, "hash map"), (2, "binary tree")], "doc_id bigint, body string")
    s = codec.compression_stats(indexes.build(docs).postings).first()
    assert (s.original_bytes, s.compressed_bytes) == (76, 48) and s.ratio == pytest.approx(0.631579, abs=1e-6)
    none = codec.compression_stats(indexes.build(docs.limit(0)).postings).first()
    assert (none.ratio, none.savings_percent) == (1.0, 0.0)


@given(st.lists(st.integers(0, 2**31), max_size=40))
def test_codec_round_trip(ids):
    ids = sorted(ids)
    assert codec.decompress(codec.compress(ids)) == ids


def test_robots_and_pages():
    assert web.parse_robots(ROBOTS) == ["/private"]
    assert web.parse_robots("User-agent: *\nUser-agent: Foo\nDisallow: /z") == []
    assert web.read_page(HTML, "http://h/p") == ("T", "T one two three four ", ["http://h/k"])
    assert web.read_page(HTML, "http://h/p", reverse=True)[1] == "four three two one T "
    assert web.normalize_url("HTTP://Ex.COM:80/a/../b#f") == "http://ex.com/b"
    assert web.normalize_url("mailto:x@y") is None
    assert [web.format_bytes(n) for n in (76, 1536, 1280)] == ["76 B", "1.5 KB", "1.2 KB"]
    assert web.escape("<a href=\"x\">'&") == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;"


def test_page_columns(spark):
    r = spark.createDataFrame([(HTML, "http://h/p#q")], "h string, u string").select(
        web.page_title(F.col("h"), F.col("u")), web.page_text(F.col("h")), web.page_text(F.col("h"), True), web.page_links(F.col("h")), web.without_fragment(F.col("u"))
    ).first()
    assert tuple(r) == ("T", "T one two three four ", "four three two one T ", ["/k#f"], "http://h/p")
    paths = spark.createDataFrame([(p,) for p in ("/private/ok", "/privateer", "/x", "/y")], "p string")
    assert [x[0] for x in paths.select(web.is_allowed(F.col("p"), F.array(F.lit("/private")))).collect()] == [False, False, True, True]


def test_folder(spark, tmp_path):
    for name, data in (("b.txt", b"hash table"), ("a.md", b"hash map"), ("_x.py", b"under"), (".h.rs", b"hidden file"), ("bad.txt", b"\xff\xfe"), ("skip.bin", b"x"), (".git/c.txt", b"no"), ("target/d.txt", b"no"), ("sub/e.TXT", b"no"), ("sub/f.csv", b"tree")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = sorted(files.read_folder(spark, str(tmp_path), 5).collect())
    assert [(r.doc_id, r.title) for r in rows] == [(5, ".h.rs"), (6, "_x.py"), (7, "a.md"), (8, "b.txt"), (9, "f.csv")]
    seen = sorted(r.title for r in files.read_store(spark, str(tmp_path)).collect())
    assert seen == ["a.md", "b.txt", "f.csv"]


SITE = {
    "http://h/": '<title>Home</title><a href="/a">x</a> <a href="/b">y</a> <a href="http://other/z">z</a> words here',
    "http://h/a": '<title>A</title>alpha text <a href="/c">c</a><a href="/">home</a>',
    "http://h/b": '<a href="/private/p">p</a><script>only()</script>',
    "http://h/c": '<title>C</title>gamma text <a href="/d">d</a>',
    "http://h/d": "too deep",
    "http://h/private/p": "closed",
}


def test_crawl(spark):
    fetch = crawl.table_fetcher(spark.createDataFrame(list(SITE.items()), "url string, html string"))
    robots = crawl.robots_table(spark, {"h": ROBOTS})
    result = crawl.crawl(spark, ["http://h/#top", "nonsense"], fetch, crawl.CrawlConfig(), robots)
    docs = {r.path: (r.doc_id, r.title) for r in result.documents.collect()}
    assert docs == {"http://h/": (0, "Home"), "http://h/a": (1, "A"), "http://h/b": (2, "http://h/b"), "http://h/c": (3, "C")}
    assert sorted(map(tuple, result.edges.collect())) == [(0, 1), (0, 2), (1, 0), (1, 3)]
    assert (result.metrics["indexed"], result.metrics["fetched"], result.metrics["skipped"]) == (4, 4, 2)
    few = crawl.crawl(spark, ["http://h/"], fetch, crawl.CrawlConfig(max_pages=2), robots)
    assert sorted(r.path for r in few.documents.collect()) == ["http://h/", "http://h/a"]
    known = spark.createDataFrame([("http://h/", 7)], "url string, doc_id bigint")
    more = crawl.crawl(spark, ["http://h/"], fetch, crawl.CrawlConfig(), robots, known, 8)
    assert sorted((r.doc_id, r.path) for r in more.documents.collect()) == [(8, "http://h/a"), (9, "http://h/b"), (10, "http://h/c")]
    assert sorted(map(tuple, more.edges.collect())) == [(8, 7), (8, 10)]


def test_crawl_reads_robots_of_every_host(spark):
    """Without given rules each host's own file is fetched; what cannot be had closes nothing."""
    site = SITE | {"http://h/robots.txt": ROBOTS, "http://other/z": "<title>Z</title>other words", "http://other/robots.txt": "User-agent: *\nDisallow: /z"}
    fetch = crawl.table_fetcher(spark.createDataFrame(list(site.items()), "url string, html string"))
    result = crawl.crawl(spark, ["http://h/"], fetch, crawl.CrawlConfig(same_domain_only=False))
    assert sorted(r.path for r in result.documents.collect()) == ["http://h/", "http://h/a", "http://h/b", "http://h/c"]
    assert result.metrics["skipped"] == 2  # the private page and the other host's
    del site["http://other/robots.txt"]
    fetch = crawl.table_fetcher(spark.createDataFrame(list(site.items()), "url string, html string"))
    wider = crawl.crawl(spark, ["http://h/"], fetch, crawl.CrawlConfig(same_domain_only=False))
    assert [(r.doc_id, r.path) for r in wider.documents.orderBy("doc_id").collect()] == list(enumerate(["http://h/", "http://h/a", "http://h/b", "http://other/z", "http://h/c"]))


class _Broken(BaseHTTPRequestHandler):
    """Answers that are cut short, or are no answers."""

    def do_GET(self):
        if self.path == "/good":
            self.wfile.write(b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: 17\r\n\r\n<p>fine words</p>")
        elif self.path == "/short":
            self.wfile.write(b"HTTP/1.1 200 OK\r\nContent-Length: 1000\r\n\r\nshort")
        else:
            self.wfile.write(b"nonsense\r\n\r\n")

    def log_message(self, *args):
        pass


def test_broken_answers_do_not_end_a_crawl(spark):
    server_ = HTTPServer(("127.0.0.1", 0), _Broken)
    threading.Thread(target=server_.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server_.server_port}"
    try:
        fetch = crawl.http_fetcher(crawl.CrawlConfig(delay_ms=1, timeout_secs=5))
        rows = fetch(spark.createDataFrame([(f"{base}/{p}",) for p in ("good", "short", "odd", "a b")], "url string")).collect()
    finally:
        server_.shutdown()
    assert {r.url.rsplit("/", 1)[1]: r.ok for r in rows} == {"good": True, "short": False, "odd": False, "a b": False}


def test_engine_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("hash.txt", "hash table hash"), ("map.txt", "hash map"), ("tree.txt", "binary tree of consensus")):
        (tmp_path / "in" / name).write_text(text)
    engine = SearchEngine.empty(spark)
    assert engine.add_folder(str(tmp_path / "in")) == 3
    fetch = crawl.table_fetcher(spark.createDataFrame(list(SITE.items()), "url string, html string"))
    assert engine.add_crawl(["http://h/"], fetch)["indexed"] == 5
    assert engine.save(str(tmp_path / "out")) > 0
    engine = SearchEngine.load(spark, str(tmp_path / "out")).cached()
    answer = engine.query("hash")
    assert [r.title for r in answer.rows] == ["hash.txt", "map.txt"] and answer.rows[0].snippet == "hash table hash"
    assert [r.title for r in engine.query("phrase: hash table").rows] == ["hash.txt"]
    assert engine.query("bool: hash NOT map").notes[-1] == "1 docs matched boolean filter"
    assert engine.query("fuzzy: hahs").rows and engine.query("spell: concensus").suggestion == "consensu"
    assert engine.query("concensus").mode == "spell-corrected"
    assert "No results" in printed(engine.query("zzzzzzzzz"))
    s = engine.statistics()
    assert s["documents"] == 8 and s["max_pr"] > 0
    said = []
    cli.repl(engine, ["", "help", "stats", "hash", "quit", "never"], said.append)
    assert "Documents: 8" in said[2] and len(said) == 4
    assert server.respond(engine, "/x")[0] == 404
    assert "hash.txt" in server.respond(engine, "/?q=hash")[1] and "<form" in server.respond(engine, "/")[1]


def test_options():
    o = cli.parse(["--port", "x", "--max-pages", "7", "--cross-domain", "--odd", "dir", "--save"])
    assert (o.port, o.crawl.max_pages, o.crawl.same_domain_only, o.target, o.save) == (8080, 7, False, "dir", None)
    assert cli.main([]) == 1


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(0, "hash table"), (1, "hash map")], "doc_id bigint, body string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("doc_id bigint, body string").parquet(str(tmp_path / "in"))
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    index = ingest.read_index(spark, str(tmp_path / "out"))
    assert index.terms().where("term = 'hash'").first().df == 2 and index.doc_stats.count() == 2


def test_a_corpus_grows_in_its_own_folder(spark, tmp_path):
    """Load, add, save to the same path, again and again; a save that fails leaves what was there."""
    path = str(tmp_path / "corpus")
    for n in range(4):
        folder = tmp_path / f"in{n}"
        folder.mkdir()
        (folder / f"f{n}.txt").write_text(f"common word{n}")
        engine = SearchEngine.load(spark, path) if n else SearchEngine.empty(spark)
        assert engine.add_folder(str(folder)) == 1
        assert engine.save(path) > 0
        assert engine.index.doc_stats.count() == engine.documents.count() == n + 1
        again = SearchEngine.load(spark, path)
        assert sorted(r.title for r in again.documents.collect()) == [f"f{i}.txt" for i in range(n + 1)]
        assert again.index.doc_frequency("common") == n + 1 and again.index.doc_frequency("none") == 0
    assert tables.versions(spark, path) == [3, 4]
    broken = again.documents.withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        tables.save(path, again.index, broken)
    assert SearchEngine.load(spark, path).documents.count() == 4
    with pytest.raises(FileNotFoundError):
        tables.load(spark, str(tmp_path / "nothing"))


def test_staged_tables_go_with_their_block(spark):
    outside = tables.stage(spark.range(3))
    with tables.stages(spark):
        inside = tables.stage(spark.range(5))
        assert inside.count() == 5
    assert outside.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(inside.inputFiles()[0].rsplit("/", 1)[0])
    unset = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_codes_as_columns(spark):
    lists = [[], [0], [127], [128, 129, 16384, 2**21, 2**28, 2**32 - 1], list(range(0, 5000, 3))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<bigint>")
    code = codec.compressed(F.col("ids"))
    for r in rows.select("ids", code.alias("code"), codec.decompressed(code).alias("back")).collect():
        assert bytes(r.code) == codec.compress(r.ids) and r.back == r.ids


def test_gaps_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(codec, "STRETCH_BITS", 3)
    ids = [0, 1, 7, 8, 9, 40, 41, 100]
    rows = spark.createDataFrame([(t, i) for t in "ab" for i in ids], "term string, doc_id bigint")
    got = sorted(map(tuple, codec.id_gaps(rows).collect()))
    assert got == [(t, b, b - a) for t in "ab" for a, b in zip([0, *ids], ids)]


def test_rows_are_numbered_in_order(spark):
    rows = spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1009).repartition(7)
    got = [(r.place, r.x) for r in tables.numbered(rows, "x").orderBy("place").collect()]
    assert [p for p, _ in got] == list(range(1000)) and got == sorted(got, key=lambda g: g[1])


def two_captures(spark, path):
    """A pages table in which two rows have one URL."""
    page = '<title>{0}</title><p>{0} words</p><a href="/{0}">x</a>'
    rows = [(1, "http://h/p", page.format("a")), (2, "http://h/p", page.format("b")), (3, "http://h/q#top", page.format("c"))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


def test_links_of_pages_of_one_url(spark, tmp_path):
    got = catalog.page_links(spark, two_captures(spark, tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "http://h/a"), (2, 0, "http://h/b"), (3, 0, "http://h/c")]


def test_parsed_pages_of_one_url_and_cut_references(spark, tmp_path):
    rows = catalog.page_parse(spark, two_captures(spark, tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [(1, "a", "a a words x ", 1), (2, "b", "b b words x ", 1), (3, "c", "c c words x ", 1)]
    cut = "<title>a&amp;&amp</title>&eacute; &lt &#38; &nosuch; & &am"
    assert web.read_page(cut, "http://h/", ended=True)[:2] == ("a&&amp", "a&&amp é &lt & &nosuch; & &am ")
    assert web.read_page(cut, "http://h/")[0] == "a&&"


def test_crawl_of_an_archive_with_captures_of_one_url(spark, tmp_path):
    """Each row is a page, as in the SQL: of one URL, on the way and elsewhere, and with a cut reference."""
    page = "<title>{0}</title><p>{0} words &amp</p>"
    urls = ["http://h/p#x", "http://h/p", "http://h/q", *(f"http://h/{i}" for i in range(6)), "http://h/q"]
    rows = [(i, u, page.format(f"t{i}")) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in catalog.crawl_archive(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [(i, f"http://h/{p}", f"t{i}", len(f"t{i} t{i} words &amp next ")) for i, p in enumerate("ppq0")]


def test_gaps_are_dealt_by_rows(spark, monkeypatch):
    """The tasks that sort grow with the rows, not with a setting."""
    monkeypatch.setattr(codec, "SORTED_ROWS", 10)
    rows = spark.createDataFrame([(f"t{i % 50}", i) for i in range(500)], "term string, doc_id bigint")
    gaps = codec.id_gaps(rows)
    assert "REPARTITION_BY_NUM" in (plan := gaps._jdf.queryExecution().toString()) and ", 50)" in plan
    assert sorted(map(tuple, gaps.collect())) == sorted((f"t{i % 50}", i, i if i < 50 else 50) for i in range(500))


def test_a_loaded_corpus_is_saved_with_its_neighbourhoods(spark, tmp_path, monkeypatch):
    """They are not made anew; both versions have the same."""
    path = str(tmp_path / "corpus")
    docs = spark.createDataFrame([(0, "p", "t", "hash table"), (1, "q", "t", "tree")], tables.SCHEMAS["documents"])
    tables.save(path, indexes.build(docs), docs)
    monkeypatch.setattr(tables, "by_variant", None)
    engine = SearchEngine.load(spark, path)
    before = sorted(map(tuple, engine.index.stored_deletions.collect()))
    engine.save(path)
    assert before and sorted(map(tuple, engine.index.stored_deletions.collect())) == before
