"""Column functions against hand-derived tables and against the standard library."""

import html as stdhtml
import random

import pytest
from pyspark.sql import functions as F

from docspark.functions import clean, html, pytext, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("r")).first().r


ODD = ["", " ", "a", "\x1c a\x85", "　x ", "a\r\nb\x0bc d", "é́\n\n\n b", "𐐷 \t x\n", "\n", "x\n\n"]


def test_strip_and_lines_like_python(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" a\n\r\t\x1c\x85  é") for _ in range(rng.randrange(12))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(
        "x", pytext.strip(F.col("x")).alias("s"), pytext.split_lines(F.col("x")).alias("l"), pytext.collapse_inline(F.col("x")).alias("i")).collect()
    for r in rows:
        assert r.s == r.x.strip()
        assert r.l == r.x.splitlines()
        assert r.i == " ".join(r.x.split())


@pytest.mark.parametrize("text, want", [
    ("# Demo\n\nA short local article for testing.", "Demo\n\nA short local article for testing."),
    ("[t](http://u) and ![alt](x)", "t and alt"), ("- one\n- two", "one two"), (None, ""), ("", ""), ("a &amp; b\r\n\r\nc", "a & b\n\nc"),
    ("```\ncode\n```\nx `y` **z**", "x y z"), ("1. a\n2) b\n> q", "a b q"), ("snake_case_name", "snakecasename"),
])
def test_clean(spark, text, want):
    assert one(spark, text, clean.clean_source_text) == want


@pytest.mark.parametrize("text, lang, want", [
    ("Foo — bar [1] a/b", "zh", "Foo，bar a b"), ("Foo — bar [1] a/b", "en", "Foo, bar a b"), ("你好，世界！", "zh", "你好,世界!"), (None, "en", ""),
])
def test_script(spark, text, lang, want):
    assert one(spark, text, lambda x: clean.render_script(x, lang)) == want


def test_identity(spark):
    ids = spark.range(1).select(
        pytext.stable_id(F.lit("https://example.com/a"), F.lit(""), F.lit("T"), F.lit("")).alias("a"), pytext.stable_id(F.lit(""), F.lit("a.md"), F.lit("Demo"), F.lit("1")).alias("b"),
        clean.document_slug(F.lit("Hello World!"), F.lit(3), F.lit("x")).alias("c"), clean.document_slug(F.lit("  A_b--C. "), F.lit(None).cast("int"), F.lit("x")).alias("d"),
        clean.document_slug(F.lit("!"), F.lit(12345), F.lit("x")).alias("e"), clean.safe_filename(F.lit('a/b:  "c"')).alias("f"), clean.numbered_title(F.lit(None).cast("string"), F.lit(2)).alias("g")).first()
    assert (ids.a, ids.b, ids.c, ids.d, ids.e, ids.f, ids.g) == ("930b46fd891c", "423aba18d846", "0003-hello-world", "a-b-c", "12345-x", "a b c", "2. Untitled")


@pytest.mark.parametrize("title, path, want", [(" T ", "", "T"), ("", "d/demo.note.md", "demo.note"), (None, "/a/.hidden", ".hidden"), ("", "", "Untitled")])
def test_inferred_title(spark, title, path, want):
    row = spark.createDataFrame([(title, path)], "t string, p string").select(clean.inferred_title(F.col("t"), F.col("p")).alias("r")).first()
    assert row.r == want


@pytest.mark.parametrize("raw, title, text", [
    ("<html><head><title>Ignore</title></head><body><h1>Hello</h1><script>x()</script><p>Readable text.</p></body></html>", "Hello", "Hello Readable text."),
    ("<p>a</p><p>b</p>", "", "a b"), ("<p>a\n\nb</p>", "", "a\n\nb"), ("<b>a</b> <i>b</i>", "", "ab"), ("<ul><li>x</li><li>y</li></ul>", "", "- x - y"),
    ("<p>&amp;lt;</p>", "", "<"), ("<title>T</title><p>z</p>", "T", "z"), ("", "", ""),
])
def test_readable(raw, title, text):
    assert html.readable(raw) == (title, text)


PAGE = '<html><body><nav>No</nav><main id="content"><h1>Article Title</h1><p>Keep me.</p><aside>Drop</aside></main><footer>F</footer></body></html>'


def test_filter():
    kept = html.filter_markup(PAGE, "#content", "", ["aside"])
    assert kept == '<main id="content"><h1>Article Title</h1><p>Keep me.</p></main>'
    assert html.filter_markup(PAGE, ".nothing") == PAGE
    assert html.filter_markup("<h1>T</h1><p>x</p>", ".nothing", "h1") == "<article><h1>T</h1>\n</article>"
    assert "Drop" not in html.filter_markup(PAGE, "", "", ["aside"])


@pytest.mark.parametrize("selector, want", [
    ("div", True), ("DIV", True), ("#Main", True), ("#main", False), (".b", True), ("div.a", True), ("p.a", False), ("div#Main", True), ("p,.a", True), ("body div", False),
])
def test_selectors(selector, want):
    assert html.selector_matches("div", [("id", "Main"), ("class", "a b")], html.parse_selector(selector)) is want


def test_links_and_sitemap():
    assert html.page_links("http://h/a/b", '<a href="c#x">1</a><a href="/d">2</a><a href="mailto:z">3</a><a>4</a><a href="c">5</a>') == ["http://h/a/c", "http://h/d", "http://h/a/c"]
    assert html.sitemap_locations('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://h/a </loc></url></urlset>') == ["http://h/a"]
    assert html.sitemap_locations("<broken") == []


def test_url_predicates(spark):
    row = spark.createDataFrame([("http://ex.com:8/a?b",)], "u string").select(
        urls.authority(F.col("u")).alias("a"), urls.same_domain(F.col("u"), ["http://ex.com:8/"]).alias("s"), urls.url_allowed(F.col("u"), [r"/a"], [r"b$"]).alias("x"), urls.url_allowed(F.col("u")).alias("y")).first()
    assert (row.a, row.s, row.x, row.y) == ("ex.com:8", True, False, True)


def test_unescape_like_python(spark):
    for t in ("&amp;para", "&lt;&copy;&#x41;&bogus;", "none"):
        assert one(spark, t, clean.unescape) == stdhtml.unescape(t)
