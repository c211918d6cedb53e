import re
from datetime import datetime
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from siftrank.functions import dates, html as H
from siftrank.operators import extract as X
from siftrank.sources.tables import load


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first().o


PAGE = (
    '<html><head><title>A&amp;B</title><META name="Date" content="Tue, 09 Dec 2003 22:39:08 GMT">'
    '<script>x("</p>")</script><style>p{margin:0}</style></head><body><!-- <b>no</b> --><p>one<br>two'
    '<img src="a>b" alt="pic"> caf&eacute;&#33;&#x21;&nope;<i>x</i>y</body></html>'
)


def test_page_parts(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    row = X.extract_pages(pages).first()
    assert row.title == "A&B"
    assert row.body == "A&B one two[pic] café!!xy"
    assert row.props == {"date": "tue, 09 dec 2003 22:39:08 gmt"}


def test_title_is_part_of_the_body_but_not_of_the_summary(spark):
    pages = spark.createDataFrame(
        [(1, PAGE), (2, "<title>T</title>"), (3, "<p>text only"), (4, "<title>text</title><p>text more")],
        "page_id long, html string",
    )
    got = {r.doc_id: r.summary for r in X.page_summaries(pages).collect()}
    assert got == {1: "one two[pic] café!!xy", 2: "T", 3: "text only", 4: "text"}


def test_long_tags_do_not_overflow(spark):
    page = "<p title='" + "x" * 200_000 + "'>body</p><img alt=\"" + "y" * 100_000 + '">'
    assert one(spark, H.body_text, page) == "body [" + "y" * 100_000 + "]"


@pytest.mark.parametrize(
    "text, want",
    [("a & b", "a & b"), ("&lt;p&gt;", "<p>"), ("&#55296;&#1114112;&#x1F600;", "\U0001F600"), ("&", "&"), ("&#000000065;&#x0000000042;&#0;", "AB\0")],
)
def test_entities(spark, text, want):
    assert one(spark, H.decode_entities, text) == want


class _Words(HTMLParser):
    """Words of a page by Python's own parser."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag == "img" and dict(attrs).get("alt"):
            self.out.append(f"[{dict(attrs)['alt']}]")
        self.out.append("" if tag in ("a", "b", "i", "span", "em") else " ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_given_pages_have_the_words_another_parser_finds(spark):
    pages = load(spark, "/root/testdata/sf0.001", "pages")
    got = {r.doc_id: r.body for r in X.extract_pages(pages).collect()}
    for row in pages.collect():
        parser = _Words()
        parser.feed(row.html)
        letters = re.sub(r"\s", "", "".join(parser.out))
        assert re.sub(r"\s", "", got[row.page_id]) == letters


def _cut(text, size):
    """The cutting rule, one character at a time."""
    chunks = []
    while text:
        end = len(text) if len(text) <= size else size
        if len(text) > size:
            for n in range(size - 1, min(size + 20, len(text))):
                if text[n].isspace():
                    end = n
                    break
        chunks.append(text[:end])
        text = text[end:]
    return chunks


@pytest.mark.parametrize("size", [5, 40, 333])
def test_chunks_follow_the_rule(spark, size):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    rows = X.chunk_documents(docs, size).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda c: c["text"]).alias("c")
    )
    got = {r.doc_id: r.c for r in rows.collect()}
    for row in docs.collect():
        if row.text:
            assert got[row.doc_id] == _cut(row.text, size)


def test_dates(spark):
    ts = spark.createDataFrame([(datetime(2004, 9, 21, 13, 50, 11),)], "t timestamp_ntz")
    row = ts.select(
        dates.date_to_string(dates.round_date(F.col("t"), "month"), "second").alias("m"),
        dates.date_to_string(dates.round_date(F.col("t"), "hour"), "second").alias("h"),
    ).first()
    assert (row.m, row.h) == ("20040901000000", "20040921130000")


@pytest.mark.parametrize(
    "text, want",
    [
        ("2004", "2004-01-01 00:00:00.000"), ("200409", "2004-09-01 00:00:00.000"),
        ("20040921135011", "2004-09-21 13:50:11.000"), ("20040921135011123", "2004-09-21 13:50:11.123"),
        ("20040", None), ("2004xx", None), ("200413", None),
    ],
)
def test_dates_by_length(spark, text, want):
    got = one(spark, lambda c: F.date_format(dates.string_to_date(c), "yyyy-MM-dd HH:mm:ss.SSS"), text)
    assert got == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("Tue, 09 Dec 2003 22:39:08 GMT", "2003-12-09 22:39:08"),
        (" Tue Dec 09 16:45:08 2003 EST ", "2003-12-09 21:45:08"),
        ("Tue, 09-Dec-2003 22:39:08 GMT", "2003-12-09 22:39:08"),
        ("yesterday", None),
    ],
)
def test_header_dates(spark, text, want):
    got = one(spark, lambda c: F.date_format(dates.parse_any(c), "yyyy-MM-dd HH:mm:ss"), text)
    assert got == want


def test_values_gathered_in_blocks(spark):
    rows = spark.createDataFrame([(1, p, f"v{p}") for p in (4, 0, 2, 1)], "id long, pos long, v string")
    got = [(r.block, r["values"]) for r in X.gather_values(rows, "id", "pos", "v", 2).orderBy("block").collect()]
    assert got == [(0, ["v0", "v1"]), (1, ["v2"]), (2, ["v4"])]
