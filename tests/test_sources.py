import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.config import written
from passagework.functions import citations as C
from passagework.functions import html as H
from passagework.functions.paths import (
    base_name, check_collection_name, document_table_name, extension, first_match, is_valid_collection_name,
    page_table_name,
)
from passagework.sources import files as S
from passagework.sources import paged as P
from passagework.sources.folders import FolderReader, scan_folder, write_files
from passagework.sources.templates import attach_source_files, scan_source_files, scan_templates
from passagework.sources.web import _add_bucketed, crawl, crawl_round, load_web, page_links, url_list

DATE = 1_700_000_000_000


def read_pages(data):
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    return data[4:].decode().split("\f")


LOADERS = [S.pdf_loader(read_pages), S.text_loader()]


def write(folder, **files):
    for name, data in files.items():
        (folder / name.replace("__", ".")).write_bytes(data)


def by_name(parsed):
    return {r.filename: r for r in parsed.collect()}


def test_dispatch_falls_through_and_rejects(spark, tmp_path):
    write(
        tmp_path, good__pdf=b"%PDFone\ftwo", fake__pdf=b"plain words", upper__PDF=b"text too",
        nul__bin=b"%PDF\x00\x01", latin__txt="é".encode("latin-1"), crlf__txt=b"a\r\nb\rc", noext=b"x",
        empty__txt=b"",
    )
    (tmp_path / ".hidden").write_bytes(b"h")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_bytes(b"not read")
    parsed = S.load_files(S.scan_files(spark, str(tmp_path), include_empty=True), LOADERS, "c", DATE)
    got = by_name(S.loaded(parsed))
    assert "empty.txt" not in by_name(S.load_files(S.scan_files(spark, str(tmp_path)), LOADERS, "c", DATE))
    assert got["good.pdf"].type == "pdf" and got["good.pdf"].media_type == "application/pdf"
    assert [(p.page, p.content) for p in got["good.pdf"].pages] == [(1, "one"), (2, "two")]
    assert got["fake.pdf"].type == "plaintext" and got["fake.pdf"].extension == ".pdf"
    assert got["upper.PDF"].type == "plaintext"
    assert got["crlf.txt"].pages[0].content == "a\nb\nc"
    assert got["noext"].extension == "" and got["noext"].source == str(tmp_path / "noext")
    assert got["empty.txt"].pages[0].content == ""
    assert "deep.txt" not in got
    assert {os.path.basename(r.source) for r in S.rejected(parsed).collect()} == {"nul.bin", "latin.txt"}
    broken = S.load_files(S.scan_files(spark, str(tmp_path)), [S.pdf_loader(read_pages)], "c", DATE)
    reasons = {os.path.basename(r.source): r.reason for r in S.rejected(broken).collect()}
    assert reasons["fake.pdf"] == "cannot be read as pdf" and reasons["nul.bin"] == "no loader takes such a file"


def test_long_pages_keep_their_number(spark):
    data = b"%PDF" + b"word " * 1500 + b"\flast"
    files = spark.createDataFrame([("/a/b.pdf", bytearray(data))], "path string, content binary")
    pages = S.load_files(files, LOADERS, "c", DATE).first().pages
    assert [p.page for p in pages] == [1, 1, 2] and len(pages[0].content) <= 4000


def test_display_names(spark):
    files = spark.createDataFrame([("/tmp/u1", bytearray(b"a")), ("/tmp/u2", bytearray(b"b"))], "path string, content binary")
    names = spark.createDataFrame([("/tmp/u1", "My notes.txt")], "path string, name string")
    got = S.load_files(S.with_display_names(files, names), LOADERS, "c", DATE).collect()
    assert {(r.source, r.filename) for r in got} == {("/tmp/u1", "My notes.txt"), ("/tmp/u2", "u2")}


def test_ids_are_stable_and_depend_on_date(spark):
    files = spark.createDataFrame([("/a", bytearray(b"x"))], "path string, content binary")
    one, two, three = (S.load_files(files, LOADERS, "c", d).first().doc_id for d in (1, 1, 2))
    assert one == two != three


def test_paths(spark):
    cases = ["/a/b.txt", "/a/.hidden", "/a/x.tar.gz", "/a/plain", "/a.b/plain", "/a/..c.d", "/a/end.", "rel.md"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    for r in df.select("p", base_name(F.col("p")).alias("n"), extension(F.col("p")).alias("e")).collect():
        assert r.n == os.path.basename(r.p) and r.e == os.path.splitext(r.p)[1]


def test_names(spark):
    df = spark.createDataFrame([("ok",), ("Bad",), ("_x",), ("-x",), ("",), ("a_b-c",), ("..",), ("a*b",), ("a/b",), ("a b",), ("ä",)], "n string")
    valid = {r.n for r in df.filter(is_valid_collection_name(F.col("n"))).collect()}
    assert valid == {"ok", "a_b-c", "ä"}
    for name in ("Bad", "_x", "-x", "", "a/b", "..", "a*b", "a b"):
        try:
            check_collection_name(name)
            raise AssertionError(name)
        except ValueError:
            pass
    r = df.select(document_table_name(F.lit("c"), F.lit("pdf")), page_table_name(F.lit("c"), F.lit("pdf"))).first()
    assert tuple(r) == ("c.pdf", "c.pdf.pages")
    r = df.select(first_match(F.array(F.lit(3), F.lit(4)), F.lit(4)), first_match(F.array(F.lit(3)), F.lit(4))).first()
    assert tuple(r) == (1, -1)


def test_html_metadata(spark):
    rows = [
        ('<html lang="de"><title>A &amp;lt; B</title>', "A &lt; B", "de"),
        ("<HTML><head><TITLE id=x>two\nlines</TITLE>", "two\nlines", None),
        ("<p>none</p>", None, None), ("<html lang=fr><title></title>", None, "fr"),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(rows)], "i int, h string")
    for r in df.select("i", H.title(F.col("h")).alias("t"), H.language(F.col("h")).alias("l")).collect():
        assert (r.t, r.l) == rows[r.i][1:]


def test_resolve(spark):
    from urllib.parse import urljoin

    base = ["http://h.example/a/b.html?q=1#f", "https://h.example", "http://h.example/a/"]
    link = ["/x", "y.html", "../z", "./w", "//o.example/p", "http://t.example/", "?page=2", "a/../b", "../../.."]
    df = spark.createDataFrame([(b, x) for b in base for x in link], "b string, l string")
    for r in df.select("b", "l", H.resolve(F.col("b"), F.col("l")).alias("u")).collect():
        assert r.u == urljoin(r.b, r.l), (r.b, r.l, r.u)


def site(spark):
    def page(url, *links):
        return url, f"<html lang='en'><title>{url[-1]}</title>" + "".join(f'<a href="{x}">x</a>' for x in links)

    root = "http://s.example/"
    return spark.createDataFrame(
        [
            page(root, "a", "/b#top", "mailto:x@y", "style.css", "javascript:go()", "http://o.example/"),
            page(root + "a", "b", "a", "/c"), page(root + "b", "/missing", ""),
            page(root + "c", "d"), page(root + "d", "/"), page("http://o.example/", root + "e"), page(root + "e"),
        ],
        "url string, html string",
    )


def test_links_and_crawl(spark):
    stored, root = site(spark), "http://s.example/"
    links = {(r.url, r.target) for r in page_links(stored).collect()}
    assert {t for u, t in links if u == root} == {root + "a", root + "b", "http://o.example/"}
    roots = spark.createDataFrame([(root,), (root + "c",), ("http://unknown.example/",)], "url string")
    got = {(r.root, r.url): r.depth for r in crawl(stored, roots).collect()}
    assert got == {
        (root, root): 0, (root, root + "a"): 1, (root, root + "b"): 1, (root, root + "c"): 2, (root, root + "d"): 3,
        (root + "c", root + "c"): 0,
    }
    near = {r.url for r in crawl(stored, roots.limit(1), max_depth=2).collect()}
    assert near == {root, root + "a", root + "b"}


def test_crawled_pages_are_numbered_densely(spark):
    stored, root = site(spark), "http://s.example/"
    stored = stored.withColumn("html", F.when(F.col("url") == root + "a", F.concat("html", F.repeat(F.lit("word "), 3000))).otherwise(F.col("html")))
    reached = crawl(stored, spark.createDataFrame([(root,), (root + "c",)], "url string"))
    rows = load_web(stored, "c", DATE, reached).collect()
    mine = sorted((r for r in rows if r.doc_source == root), key=lambda r: r.page_no)
    assert [r.page_no for r in mine] == list(range(len(mine))) and len(mine) == 5 + 3
    assert [r.source for r in mine][:2] == [root, root + "a"] and mine[-1].source == root + "d"
    assert [r.page_no for r in rows if r.doc_source == root + "c"] == [0]
    assert len({r.doc_id for r in rows}) == 2 and mine[0].language == "en"


def test_url_list(spark):
    df = spark.createDataFrame([("http://a",), ("",), ("http://b",)], "url string")
    assert url_list(df).count() == 2


def test_templates(spark):
    here = os.path.join(os.path.dirname(__file__), "templates")
    folders = {"task": f"{here}/tasks", "persona": f"{here}/personas", "enhancer": f"{here}/enhancers"}
    got = {(r.kind, r.name): (r.greeting, r.prompt) for r in scan_templates(spark, folders, ".prompt").collect()}
    assert got == {
        ("task", "fact"): ("Which fact is missing?", "State the requested fact.\n         Name the passage."),
        ("task", "locate"): ("Which document is wanted?", None),
        ("persona", "archivist"): (None, "write as an archivist would."),
        ("enhancer", "risk"): (None, "Name one risk."), ("enhancer", "hint"): (None, "Add a hint."),
    }


def test_source_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("file text\nline 2")
    path = str(tmp_path / "a.txt")
    files = scan_source_files(spark, str(tmp_path))
    queries = spark.createDataFrame([(1, path), (2, None)], "query_id int, source_file_path string")
    got = {r.query_id: r.source_file for r in attach_source_files(queries, files).collect()}
    assert got == {1: "file text\nline 2", 2: None}
    bad = spark.createDataFrame([(1, "/none.txt")], "query_id int, source_file_path string")
    try:
        attach_source_files(bad, files).collect()
        raise AssertionError("a missing file must fail")
    except Exception as e:
        assert "/none.txt does not exist!" in str(e)


def test_citations(spark):
    docs = [
        ("pdf", "D", "/x/a.pdf", "a.pdf", None), ("web", "D", "http://top", None, None),
        ("plaintext", "D", "/x/a.txt", "a.txt", ".txt"), ("note", "D", "/x/n", "n", None), ("feed", "D", "src", None, None),
    ]
    df = spark.createDataFrame(docs, "type string, doc_id string, source string, filename string, extension string")
    df = df.withColumns({"ingest_date": F.lit(5), "p": F.struct(F.lit(3).alias("page"), F.lit("http://sub").alias("source"))})
    page = lambda f: F.col(f"p.{f}")
    got = {
        r.type: (r.page, r.doc, r.plain) for r in df.select(
            "type", C.page_link(F.lit("c"), F.col, page).alias("page"), C.doc_link(F.lit("c"), F.col).alias("doc"),
            C.plain_page_citation(F.col, page).alias("plain")).collect()
    }
    blank = '{target="_blank"}'
    assert got == {
        "pdf": (f"PDF File: [page 3 of a.pdf](</files/c/pdf/D#page=3>){blank}", f"PDF File: [a.pdf](</files/c/pdf/D>){blank}",
                "   PDF File: page 3 of /x/a.pdf"),
        "web": (f"Web page: <http://sub>{blank} scraped 5 from parent URL <http://top>{blank}", f"Web page: <http://top>{blank}",
                "   Web page: http://sub scraped 5, top level URL: http://top"),
        "plaintext": (f".txt file [a.txt](</files/c/plaintext/D>){blank}",) * 2 + (None,),
        "note": (f"note file [n](</files/c/note/D>){blank}",) * 2 + (None,),
        "feed": ("feed type document from src",) * 2 + (None,),
    }
    own = {"feed": lambda c, doc: F.concat(F.lit("Feed "), doc("source"))}
    assert df.filter("type = 'feed'").select(C.doc_link(F.lit("c"), F.col, own)).first()[0] == "Feed src"


def test_text_is_judged_by_all_its_bytes(spark):
    rows = spark.createDataFrame([(1, b"a" * 5000), (2, b"a" * 5000 + b"\0"), (3, b"")], "n int, content binary")
    assert [r.t for r in rows.orderBy("n").select(S.is_text_content(rows.content).alias("t")).collect()] == [True, False, True]


def test_a_crawl_ends_where_nothing_new_is_found(spark):
    rows = [(f"http://s.ex/{i}", f'<a href="http://s.ex/{i + 1}">next</a>') for i in range(6)]
    stored = spark.createDataFrame([("http://s.ex/", '<a href="/0">in</a>'), *rows], "url string, html string")
    found = crawl(stored, spark.createDataFrame([("http://s.ex/",)], "url string"))
    assert found.count() == 7 and found.agg({"depth": "max"}).first()[0] == 6


def test_a_long_chain_is_crawled_to_its_end(spark):
    rows = [(f"http://s.ex/{i}", f'<a href="/{i + 1}">next</a>') for i in range(54)]
    stored = spark.createDataFrame(rows, "url string, html string").coalesce(1)
    found = crawl(stored, spark.createDataFrame([("http://s.ex/0",), ("http://s.ex/",)], "url string"))
    assert found.count() == 1
    chain = spark.createDataFrame([(u.replace("ex/", "ex/0/"), h.replace('"/', '"/0/')) for u, h in rows], "url string, html string")
    chain = chain.unionByName(spark.createDataFrame([("http://s.ex/0/", '<a href="0">in</a>')], "url string, html string"))
    found = crawl(chain.coalesce(1), spark.createDataFrame([("http://s.ex/0/",)], "url string"))
    assert found.count() == 55 and found.agg({"depth": "max"}).first()[0] == 54
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("crawl_")]


def test_a_round_shuffles_neither_edges_nor_visited_pages(spark, tmp_path):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    edges = spark.range(500).select(F.concat(F.lit("r/"), "id").alias("url"), F.concat(F.lit("r/"), F.col("id") * 2).alias("target"))
    seen = spark.range(100).select(F.lit("r").alias("root"), F.concat(F.lit("r/"), "id").alias("url"), F.lit(0).alias("depth"))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        _add_bucketed(edges, "round_edges", str(tmp_path / "e"), ["url"], 8)
        for _ in range(2):
            _add_bucketed(seen, "round_seen", str(tmp_path / "s"), ["root", "url"], 8)
        found = crawl_round(written(seen.limit(90)), spark.table("round_edges"), spark.table("round_seen"), 8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        depth = {i: len(x) - len(x.lstrip(" +:-")) for i, x in enumerate(lines)}
        for i, line in enumerate(lines):
            if "spark_catalog.default.round_" in line:
                above, at = [], depth[i]
                for j in range(i - 1, -1, -1):
                    if depth[j] < at:
                        above.append(lines[j].strip(" +:-"))
                        at = depth[j]
                joined = next(k for k, x in enumerate(above) if "Join" in x)
                assert not any(x.startswith("Exchange") for x in above[:joined]), plan
        assert {r.url for r in found.collect()} == {f"r/{2 * i}" for i in range(90)} - {f"r/{i}" for i in range(100)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for t in ("round_edges", "round_seen"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_link_rules(spark):
    html = ("<a href=tel:123><a HREF='/q'><a href=\"ftp://x/y\"><a href=HTTP://z/><a href=plain.html><A hReF = \"/a?b=1&amp;c=&#50;#top\">"
            "<a href='mailto:x@y'><a href=' /spaced '><a href='data:text/plain,x'><a href=Script:x><a href='x.css'><a href='#here'>")
    stored = spark.createDataFrame([("http://s.ex/d/p", html)], "url string, html string")
    assert {r.target for r in page_links(stored).collect()} == {
        "http://s.ex/q", "HTTP://z/", "http://s.ex/d/plain.html", "http://s.ex/a?b=1&c=2", "http://s.ex/spaced"}


ODD_HTML = [
    "a<b>c</b>d", "x < y && y > z", "<a title='1>2' href=\"a>b\">in</a>", "<!-- a > b --> c <!-- x -- y --> d", "<script>if (a</b>) '<p>'</script>t",
    "<SCRIPT type=x>1</ScRiPt >u", "<style>a>b{}</style>v", "&lt;b&gt; &#65;&#x42;&eacute;&notin;&amp;amp; &amp &unknown; &#0;",
    "<?php x ?>y", "<!DOCTYPE html>z", "</ x>1", "</>2", "a<br/>b<br />c", "<p\nclass=a\n>d", "<a b=c'd>e", "3<4", "<", "</", "a<1>b", "", "<x y='a\nb'>c",
]


@pytest.mark.parametrize("markup", ODD_HTML)
def test_text_of_odd_markup_equals_the_parser(markup):
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.raw = [], None

        def handle_starttag(self, tag, attrs):
            self.raw = tag if tag in ("script", "style") else None

        def handle_endtag(self, tag):
            self.raw = None

        def handle_data(self, data):
            if self.raw is None:
                self.out.append(data)

    parser = Text()
    parser.feed(markup)
    parser.close()
    assert H.text_of(markup) == "".join(parser.out)


def test_where_the_standard_is_stricter_than_the_parser():
    assert H.text_of("<!---->e<!-->f<!--->g") == "efg" and H.text_of("<style/>no</style>w") == "w"
    assert H.text_of("a<title>b<c>&amp;</title>d<textarea><p></textarea>") == "ab<c>&d<p>"
    assert H.text_of("a<b c='no end>d") == "a" and H.text_of("a<!-- no end") == "a"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-='\"ab &;#s\n", max_size=60))
def test_text_of_any_markup_ends_and_holds_no_whole_tag(markup):
    text = H.text_of(markup)
    assert len(text) <= len(markup) and "<a>" not in text and "<!--" not in text


def test_unclosed_markup_takes_linear_time():
    import time

    start = time.time()
    for piece in ("<a b=\"", "<!--", "<a ", "<script>", "<", "<a =' ", "&", "</"):
        H.text_of(piece * 200_000)
    assert time.time() - start < 20


def test_strip_html_of_rows(spark):
    df = spark.createDataFrame([("<p>a&nbsp;b",), (None,), ("",)], "h string")
    assert [r.t for r in df.select(H.strip_html("h").alias("t")).collect()] == ["a\xa0b", None, ""]
    assert df.select(H.unescape(F.lit("&copy;&#x2014;&amp;lt;")).alias("t")).first().t == "\xa9\u2014&lt;"


def test_every_file_of_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    content = {".hidden": b"h", "_part": b"p", "empty.txt": b"", "a.txt": b"text", "odd name%20 é.bin": b"\x00\xff"}
    for name, data in content.items():
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(data)
    (folder / "sub").mkdir()
    (folder / "sub" / "deep.txt").write_bytes(b"not read")
    got = {r.path: bytes(r.content) for r in scan_folder(spark, str(folder)).collect()}
    assert got == {str(folder / n): d for n, d in content.items()}
    assert {r.path for r in scan_folder(spark, f"file://{folder}", f"file:{folder}").collect()} == set(got)
    assert scan_folder(spark, str(folder / "sub")).count() == 1
    (tmp_path / "none").mkdir()
    assert scan_folder(spark, str(tmp_path / "none")).count() == 0
    parsed = S.loaded(S.load_files(scan_folder(spark, str(folder)), LOADERS, "c", DATE))
    assert {r.filename for r in parsed.collect()} == {".hidden", "_part", "empty.txt", "a.txt"}


def test_files_are_dealt_by_size_and_read_in_bounded_batches(spark, tmp_path, monkeypatch):
    from passagework.sources import folders

    monkeypatch.setattr(folders, "_PARTITION_BYTES", 1000)
    monkeypatch.setattr(folders, "_BATCH_BYTES", 250)
    files = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.repeat(F.lit("x"), 100).alias("content"))
    assert write_files(files, str(tmp_path / "in")) == 40
    reader = FolderReader([str(tmp_path / "in")])
    parts = reader.partitions()
    assert len(parts) == 4 and all(len(p.paths) == 10 for p in parts)
    assert [b.num_rows for b in reader.read(parts[0])] == [3, 3, 3, 1]


def test_a_book_is_read_page_by_page(spark):
    held = []

    def book(data):
        for i in range(10_000):
            held.append(i)
            yield f"page {i} " * 20

    files = [("/a/book.pdf", b"x"), ("/a/bad.pdf", b"plain"), ("/a/none.pdf", b"none"), ("/a/nul.bin", b"\x00")]

    def pages(data):
        if data == b"plain":
            yield "first"
            raise ValueError("broken on page 2")
        if data == b"x":
            yield from book(data)

    readers = [P.PageReader("pdf", lambda path, data: path.endswith(".pdf"), pages, "application/pdf"), P.text_reader()]
    names = ["source", "type", "media_type", "failed", "page_no", "page", "content"]
    sizes = []
    for rows in P.read_batches(files, readers, names, 4000, 200):
        sizes.append(len(rows))
        assert len(rows) <= P.ROWS_PER_BATCH
    assert len(held) == 20_000 and sum(sizes) == 10_000 + 3
    table = spark.createDataFrame(files, "path string, content binary")
    got = P.scan_pages(table, readers, "c", DATE)
    rows = {r.source: r for r in got.filter("page_no is null or page_no = 0").collect()}
    assert rows["/a/bad.pdf"].type == "plaintext" and rows["/a/bad.pdf"].failed == "pdf: ValueError: broken on page 2"
    assert rows["/a/bad.pdf"].content == "plain" and rows["/a/bad.pdf"].extension == ".pdf"
    assert rows["/a/none.pdf"].page_no is None and rows["/a/none.pdf"].type == "pdf" and rows["/a/nul.bin"].type is None
    assert got.filter("type = 'pdf' and page_no is not null").agg(F.max("page_no"), F.max("page")).first()[:] == (9999, 10_000)
    assert P.documents_of_pages(got).count() == 3 and P.pages_of_scan(got).count() == 10_001
    want = {r.source: r.doc_id for r in S.load_files(table, [S.text_loader()], "c", DATE).collect()}
    assert rows["/a/bad.pdf"].doc_id == want["/a/bad.pdf"]


def test_links_of_a_url_that_is_stored_twice_are_one_edge(spark):
    rows = [("http://a.example/x", '<a href="/y">1</a><a href="/z">2</a>'), ("http://a.example/x", '<a href="/y">again</a>')]
    found = page_links(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted((r.url, r.target) for r in found) == [
        ("http://a.example/x", "http://a.example/y"), ("http://a.example/x", "http://a.example/z")]
