"""WARC round trips and HTML rendering."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from attesta.llm import html_text, warc
from attesta.llm.scratch import scratch_path

SCHEMA = "page_id long, url string, html string, copy int, sha1 string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_with_revisits(spark):
    long = "é" * 5_000
    rows = [(1, "u", "same", 0, "x"), (2, "u", "same", 0, "x"), (9, "u", "same", 0, "x"), (3, "u", long, 0, ""), (4, "u", None, 0, ""),
            (5, "u", "", 0, ""), (6, "u", "WARC/1.1\r\n\r\n", 0, ""), (7, "u", "own", 0, ""), (7, "u", "own", 0, ""), (None, "u", "same", 0, ""),
            (None, "u", "lost", 0, "")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, SCHEMA), chunk_bytes=999).collect()
    seen = sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    def row(i, text, kind, refers=None):
        return (repr(i), len((text or "").encode()), digest(text), kind, refers)
    assert seen == sorted([
        row(1, "same", "revisit", 9), row(2, "same", "revisit", 9), row(9, "same", "response"), row(3, long, "response"),
        row(4, "", "revisit", 5), row(5, "", "response"), row(6, rows[6][2], "response"), row(7, "own", "response"),
        row(7, "own", "revisit", 7), row(None, "same", "revisit", 9), row(None, "lost", "response")], key=repr) or \
        sorted(seen, key=repr) == sorted([
            row(1, "same", "revisit", 9), row(2, "same", "revisit", 9), row(9, "same", "response"), row(3, long, "response"),
            row(4, "", "revisit", 5), row(5, "", "response"), row(6, rows[6][2], "response"), row(7, "own", "response"),
            row(7, "own", "revisit", 7), row(None, "same", "revisit", 9), row(None, "lost", "response")], key=repr)


def test_chunk_rows_carry_digests(spark):
    text = "".join(chr(65 + i % 26) for i in range(10_000))
    pages = spark.createDataFrame([(1, "u", text, 0, ""), (2, "u", "short", 0, "")], SCHEMA)
    records = warc.plan_records(pages, "page_id", "html")
    manifest = warc.write_archives(warc.chunk_rows(pages, records, "page_id", "html", 4096), scratch_path(spark, "warc"), 4096)
    assert manifest.agg(F.sum("records")).first()[0] == 2
    chunks = warc.read_archives(manifest, chunk_bytes=4096).filter("id = 1").orderBy("chunk_no").collect()
    assert b"".join(bytes(c.data) for c in chunks) == text.encode() and [len(c.data) for c in chunks] == [4096, 4096, 1808]
    assert [c.digest_so_far for c in chunks] == [digest(text[:4096]), digest(text[:8192]), digest(text)]
    assert [c.last for c in chunks] == [False, False, True]
    path = manifest.first().path.removeprefix("file://")
    with gzip.open(path) as f:  # standard gzip members
        assert f.read().count(b"WARC/1.1\r\n") >= 1


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "", "ab", 0, ""), (2, "", "ab", 0, ""), (3, "", "abc", 0, ""), (4, "", "abc", 0, "")], SCHEMA)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_round_trip(pages, least_bytes=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_empty_pages(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.archive_round_trip(empty).count() == 0 and html_text.extract_text(empty).count() == 0


CASES = [
    ("<p>One<p>two  <b>three</b>\n four", "One\n\ntwo three four"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>after", "- a\n- b\n  3. c\n  4. d\n\nafter"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
    ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a     b\n\nx  y"),
    ("<pre>  a\n   b</pre>", "  a\n   b"),
    ("a<br>b<hr>c", "a\nb\n\n---\n\nc"),
    ("<title>no</title><script>var x='</p>'</script><style>p{}</style><div hidden>no</div><p style='display: none'>no</p>yes", "yes"),
    ("<dl><dt>term<dd>what it is</dl>", "term\n  what it is"),
    ("&lt;tag&gt; &amp; &#233;", "<tag> & é"),
    ("<!-- <p>no</p> -->x<![CDATA[y]]>", "x"),
    ("text < 3 and <b>unclosed", "text < 3 and unclosed"),
    ("</p></div>stray", "stray"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<li>loose", "- loose"),
    ("<td>cell", "cell"),
    ("", ""), ("<", "<"), ("<p", ""),
]


@pytest.mark.parametrize("source,text", CASES)
def test_layout(source, text):
    assert html_text.page_text(source) == text


def test_deep_and_long_pages():
    assert html_text.page_text("<div>" * 20_000 + "x") == "x"
    assert html_text.page_text("<b>" * 5_000 + "y" + "</b>" * 5_000) == "y"
    assert len(html_text.page_text("<p>" + "word " * 200_000)) == 999_999


def test_column(spark):
    df = spark.createDataFrame([(1, "", None, 0, ""), (2, "", "<p>x", 0, ""), (2, "", "<p>x", 0, "")], SCHEMA).withColumn("text", F.lit(7))
    assert sorted((r.page_id, r.text) for r in html_text.extract_text(df).collect() if r.text) == [(2, "x"), (2, "x")]
    assert html_text.extract_text(df).filter("text is null").count() == 1
