"""HTML events, what pages say about themselves, documents in parts."""

import json

import pytest
from pyspark.sql import functions as F

from patchlens.functions import html
from patchlens.sources import reports, scratch, sinks


def written(source):
    return "".join(f"<{n}>" if k == html.OPEN else f"</{n}>" if k == html.CLOSE else n for k, n, _ in html.events(source))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<b>b<br><p>c</p></b>d", "<p>a<b>b<br></br></b></p><p>c</p>d"),
        ("<ul><li>1<li>2<ul><li>3</ul></ul>", "<ul><li>1</li><li>2<ul><li>3</li></ul></li></ul>"),
        ("<table><tr><td>1<td>2<p>z<tr><th>3</table>x", "<table><tr><td>1</td><td>2<p>z</p></td></tr><tr><th>3</th></tr></table>x"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<!doctype html><head><title>a<b></title><meta x><p>q", "<head><title>a<b></title><meta></meta></head><p>q</p>"),
        ("a<!-- <p> --><!-- never ends", "a"),
        ("<script>if (a</b) '</p>'</script >x", "<script>if (a</b) '</p>'</script>x"),
        ("</div><td>1 < 2 & 3 <", "<td>1 < 2 & 3 <</td>"),
        ("<a href=x'y title=\"a>b\">t</a><i", "<a>t</a>"),
        ("", ""),
    ],
)
def test_events_nest(source, want):
    assert written(source) == want


def test_attributes():
    assert html.attributes(""" href=x'y title="a>b" C='d' disabled href=z /""") == {"href": "x'y", "title": "a>b", "c": "d", "disabled": ""}


@pytest.mark.parametrize("source", ["<a" * 100_000, '<a ="> ' * 50_000, "<p><table>" + "<b>" * 50_000 + "<div>" * 50_000, "<li><ul>" + "<b>" * 30_000 + "<li></li>" * 30_000, "<!--" * 100_000, "<li>" + "<div>" * 20_000 + "<td>" * 20_000])
def test_odd_markup_takes_time_in_proportion(source):
    assert sum(1 for _ in html.events(source)) < 400_000


def test_metadata_of_broken_markup(spark):
    page = """<title>A &amp; B</title><h1>One<h2>Two</h2><table><tr><th class='Metadata-title'>author<td>x<td>Mon
    <tr><th>committer</th><td>y <b>z</b></td><td>Tue Jan 02 03:04:05 2024 +0200</table><time datetime="2024-01-02T03:04:05Z">then</time>
    <a href='/a?b=1&amp;c'>l</a><span>Commit date</span> <strong>Jan 02, 2024 3:04AM</strong><strong>no</strong><script>Commit date <strong>no</strong></script>"""
    found = html.metadata(page)
    assert found["title"] == "A & B" and found["headings"][-1] == "Two" and found["links"] == ["/a?b=1&c"] and found["times"] == ["2024-01-02T03:04:05Z"]
    assert found["rows"] == [{"title": "author", "cells": ["x", "Mon"]}, {"title": "committer", "cells": ["y z", "Tue Jan 02 03:04:05 2024 +0200"]}]
    assert found["spoken"] == "Jan 02, 2024 3:04AM"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<time datetime='2024-01-02T00:00:00Z'>"), (5, "Commit date <strong>Jan 02, 2024 3:04AM")], "i int, html string")
    rows = reports.page_metadata(df, F.col("html")).select("i", F.unix_timestamp(reports.commit_page_date(F.col("page"))).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [1704157445, None, None, 1704153600, 1704164640]


def test_a_document_in_parts(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.concat(F.lit('quoted " text\n'), F.col("id").cast("string")).alias("v")).repartition(5)
    sinks.document(df, str(tmp_path / "d"), "rows", "k")
    parts = sorted((tmp_path / "d").glob("part-*"))
    whole = json.loads("".join(p.read_text() for p in parts))
    assert [r["k"] for r in whole["rows"]] == list(range(1000))
    assert sorted(map(tuple, reports.document(spark, str(tmp_path / "d"), "k bigint, v string").collect())) == sorted(map(tuple, df.collect()))
    sinks.document(df.filter("false"), str(tmp_path / "e"), "rows", "k")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*")))) == {"rows": []}


def test_a_failed_document_leaves_nothing(spark, tmp_path):
    broken = spark.range(100).select("id", F.when(F.col("id") == 50, F.raise_error("lost")).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="lost"):
        sinks.document(broken, str(tmp_path / "d"), "rows", "id")
    assert not list((tmp_path / "d").glob("part-*")) if (tmp_path / "d").exists() else True


def test_files_are_named_by_their_folders(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, value string")
    target = scratch.files(df, ".rej", str(tmp_path / "x"))
    (tmp_path / "x" / "s").mkdir()
    (tmp_path / "x" / "s" / "c.rej").write_text("3")
    (tmp_path / "x" / "s" / "c.txt").write_text("4")
    assert sorted((r.path, r.content.strip()) for r in reports.reject_files(spark, target).collect()) == [("a.rej", "1"), ("b.rej", "2"), ("s/c.rej", "3")]
