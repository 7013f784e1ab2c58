"""Parsers on golden documents."""

import json

from pyspark.sql import functions as F

from larkspur.sources import boards, documents

LIST = """# Roles
| Company | Role | Location | Apply |
| --- | --- | --- | --- |
| **Quillfen** | Intern \\| Data | Rome | [go](https://a.com/1) |
| ↳ | Intern B | Oslo | 🔒 |
| too | few |
| Beta | C | Bonn | https://b.com/2 |
"""


def test_markdown(spark):
    docs = spark.createDataFrame([(1, LIST), (2, None), (3, "")], "doc long, text string")
    got = [tuple(r) for r in documents.listings(docs, "doc", "text").orderBy("line").collect()]
    assert got == [(1, 1, 4, "Quillfen", "Intern | Data", "Rome", "https://a.com/1", False), (1, 1, 5, "Quillfen", "Intern B", "Oslo", None, True), (1, 1, 7, "Beta", "C", "Bonn", "https://b.com/2", False)]


def test_html(spark):
    page = "<p>\n<table>\n<tr><th>Company</th><th>Role</th></tr>\n<tr><td>A &amp; B</td><td><b>X</b></td></tr>\n<tr><td>only</td></tr></table>"
    docs = spark.createDataFrame([(1, page)], "doc long, text string")
    assert [tuple(r) for r in documents.scan(docs, "text", "html").select("line", "cells").collect()] == [(4, ["A & B", "X"])]


def test_boards(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"jobs": [{"id": 7, "title": "T", "absolute_url": "u", "updated_at": "2026-01-02T00:00:00Z", "location": {"name": "L"}}], "meta": {"total": 1}}))
    (tmp_path / "a.json").write_text(json.dumps({"jobs": [{"id": "x", "title": "T", "location": "A", "secondaryLocations": [{"location": "B"}, {"location": "A"}], "isListed": True, "jobUrl": "u"}, {"id": "y", "isListed": False}]}))
    (tmp_path / "l.json").write_text(json.dumps({"id": "q", "text": "T", "hostedUrl": "h", "createdAt": 0, "categories": {"location": "P"}}) + "\nnot json\n")
    g, a, lv = boards.greenhouse(spark, f"{tmp_path}/g.json", "s").first(), boards.ashby(spark, f"{tmp_path}/a.json", "s").collect(), boards.lever(spark, f"{tmp_path}/l.json", "s").collect()
    assert (g.external_id, g.locations, g.semantics) == ("7", ["L"], "updated")
    assert [(r.external_id, r.locations) for r in a] == [("x", ["A", "B"])]
    assert [(r.external_id, r.locations, r.apply_url) for r in lv] == [("q", ["P"], "h")]


def test_job_postings_and_sitemap(spark):
    page = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"T","hiringOrganization":{"name":"E"}},{"@type":"Person"}]}</script><script type="application/ld+json">{bad</script>'
    got = boards.job_postings(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id", "html").collect()
    assert [(r.id, r.title, r.employer) for r in got] == [(1, "T", "E")]
    assert boards.sitemap(spark.createDataFrame([("<urlset><loc> http://a/?x=1&amp;y </loc></urlset>",)], "t string"), "t").first()[0] == "http://a/?x=1&y"


def test_snapshot_is_written_once(spark, tmp_path):
    rows = spark.range(3)
    assert [boards.write_snapshot(rows, f"file://{tmp_path}", "s", "h") for _ in range(2)] == [True, False]
    inside, beyond = boards.within_cap(spark.createDataFrame([("ab",), ("abc",)], "b string"), "b", 2)
    assert (inside.count(), beyond.count()) == (1, 1)
    assert spark.read.parquet(f"file://{tmp_path}").select(F.count("*")).first()[0] == 3
