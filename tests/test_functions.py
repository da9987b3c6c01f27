"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sitelode.functions import contacts, html, text, urls, vectors


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", type(None): "string", list: "array<double>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTP://WWW.Ex.com:80//a//b/?utm_source=x&q=1#f", "http://www.ex.com:80/a/b?q=1"),
        ("https://ex.com", "https://ex.com/"),
        ("https://ex.com/?ref=2&Ref=3&a=", "https://ex.com/?Ref=3&a="),
        ("https://ex.com/x?q=a%26b", "https://ex.com/x?q=a&b"),
        ("https://ex.com/a;v=1", "https://ex.com/a"),
        ("https://ex.com/x?q=%zz", "https://ex.com/x?q=%zz"),
        ("https://ex.com/a/", "https://ex.com/a"),
        (None, None),
    ],
)
def test_normalize_url(spark, url, expected):
    assert one(spark, urls.normalize_url(F.col("u")), u=url) == expected


@pytest.mark.parametrize(
    ("url", "base", "expected"),
    [
        ("https://www.ex.com/a", "http://ex.com", True), ("https://blog.ex.com", "https://ex.com", False),
        ("https://ex.com:8080/", "https://ex.com/", False), ("mailto:a@ex.com", "https://ex.com", False), ("HTTPS://EX.com", "https://ex.com", True),
    ],
)
def test_is_internal(spark, url, base, expected):
    assert one(spark, urls.is_internal(F.col("u"), F.col("b")), u=url, b=base) is expected


@pytest.mark.parametrize(
    ("url", "expected"),
    [("https://e.com/a/f.PDF", False), ("https://e.com/x.json", True), ("https://e.com/wp-content/uploads/p", False), ("https://e.com/", True)],
)
def test_is_page_url(spark, url, expected):
    assert one(spark, urls.is_page_url(F.col("u")), u=url) is expected


@pytest.mark.parametrize(
    ("path", "expected"),
    [("/shop/postcard", "blog"), ("/products/x", "product"), ("/home/", "generic"), ("/Home", "homepage"), ("", "homepage"), ("/x", "generic")],
)
def test_page_type(spark, path, expected):
    assert one(spark, urls.page_type(F.col("u")), u="https://e.com" + path) == expected


def test_absolute_url(spark):
    assert one(spark, urls.absolute_url("l", "b"), l="../c?x", b="https://e.com/a/b") == "https://e.com/c?x"
    assert one(spark, urls.absolute_url("l", "b"), l="http://[bad", b="https://e.com/") is None


def test_html_fields():
    page = (
        "<html><head><title> A &amp; B </title><meta name='Description' content='no'><meta name='description' content=' yes '>"
        "<script>x = '</p>'</script></head><body><nav><a href='/n'>menu</a></nav><!-- gone --><p>one <b>two<p>three"
        "<a href='/x'>link</a><img src='i.png'><template>t</template><footer>foot<a href='/f'>f</a></footer></body></html>"
    )
    got = html.read_html(page)
    assert got == {
        "title": "A & B", "meta_desc": "yes", "content": "A & B one two three link", "links": ["/x"], "images": ["i.png"],
    }
    assert html.read_html("<title></title>x") == {"title": "", "meta_desc": "", "content": "x", "links": [], "images": []}


def test_raw_title_and_hrefs(spark):
    page = "<TITLE>T &amp; U</TITLE><nav><a class=x href='/n'>m</a></nav><a href=\"/y\">y</a>"
    assert one(spark, html.raw_title(F.col("h")), h=page) == "T &amp; U"
    assert one(spark, html.all_hrefs(F.col("h")), h=page) == ["/n", "/y"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("a&nbsp;&nbsp;b", "a b"), ("a​ b", "a b"), ("１２", "12"), ("a\x01b", "a b"), ("a  \n\n\n\nb ", "a\n\nb"),
        (None, ""), ("", ""), ("&amp;lt;b&amp;gt;", "&lt;b&gt;"),
    ],
)
def test_fix_encoding(spark, raw, expected):
    assert one(spark, text.fix_encoding(F.col("t")), t=raw) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("&lt;b&gt;", ""), ("Please subscribe today", ""), ("resubmit", "resubmit"), ("ésubmit", "ésubmit"), ("© 2024 Acme", "© 2024 Acme"), ("a© 2024", ""),
        ("a <script>x</script>b", "a  b"), ("one\r\ntwo three", "one\ntwo\nthree"), (None, ""),
        ("x" * 117 + " read more yy", "x" * 117 + "   yy"), ("x" * 100 + " read more yy", ""),
    ],
)
def test_clean_text(spark, raw, expected):
    assert one(spark, text.clean_text(F.col("t")), t=raw) == expected


def test_tiny_lines(spark):
    assert one(spark, text.remove_tiny_lines(F.col("t")), t="Submit now\n\nkeep this whole line") == "keep this whole line"


def test_sections(spark):
    rows = lambda t: [(r["pos"], r["section"], r["content"]) for r in one(spark, text.sections(F.col("t")), t=t)]
    assert rows("Hello there\nabout us and more\nbody") == [(0, "hello_there", ""), (1, "about", "body")]
    assert rows("low line\n1234\nTitle One\nx\ny") == [(0, "intro", "low line\n1234"), (1, "title_one", "x\ny")]
    assert rows("nothing here") == [(0, "main", "nothing here")]
    assert rows("A B C D E F G is long") == [(0, "main", "A B C D E F G is long")]
    assert rows("") == []


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Mail Bob.Smith@Example.COM.", ["bob.smith@example.com."]), ("info [at] ex [dot] com", ["info@ex.com"]), ("info at ex dot com", []),
        ("email at ex.com", ["email@ex.com"]), ("a@b.co A@B.co c@d.org", ["a@b.co", "c@d.org"]), (None, []), ("[email protected]", ["email@example.com"]),
    ],
)
def test_emails(spark, raw, expected):
    assert one(spark, contacts.emails(F.col("t")), t=raw) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("+91 98266 03803 or (731) 493-8802", "+919826603803"), ("555-1234", None), ("152.143.123.131", "+152143123131"),
        ("1234 5678 9012 3456", None), ("5551234567 5551234568", None), ("12345678", "12345678"), ("1234567890", "1234567890"), (None, None),
    ],
)
def test_phone(spark, raw, expected):
    assert one(spark, contacts.phone(F.col("t")), t=raw) == expected


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.70710678)
    assert one(spark, vectors.unit(F.col("a")), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vectors.parse_vector(F.col("j")), j="[1, 2.5]") == [1.0, 2.5]
    for bad in ("x", "[1, null]", "{}", None):
        assert one(spark, vectors.parse_vector(F.col("j")), j=bad) is None


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("mailto:a@ex.com", "mailto:a@ex.com"), ("tel:5550100;ext=2", "tel:5550100"), ("javascript:void(0);", "javascript:void(0);"),
        ("https://ex.com/x?q=a%20b%zz", "https://ex.com/x?q=a b%zz"),
    ],
)
def test_normalize_other_schemes(spark, url, expected):
    assert one(spark, urls.normalize_url(F.col("u")), u=url) == expected


def test_fixed_patterns(spark):
    assert one(spark, text.clean_text(F.col("t")), t="a\u00a9  2024 Acme\nkept") == "kept"
    assert one(spark, text.fix_encoding(F.col("t")), t="a\x91b\x85c\td \ne\t\nf") == "a\x91b\x85c\td\ne\t\nf"
    assert one(spark, text.clean_text(F.col("t")), t="<script>x</style>kept") == "kept"
