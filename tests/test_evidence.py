"""Sections, dates, modes, deadlines, hashes and the whole evidence of single postings."""

import hashlib
import json

from pyspark.sql import functions as F

from larkspur.functions import extract
from larkspur.plans import evidence


def each(spark, f, cases):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, x string")
    return [r.v for r in rows.select("k", f(F.col("x")).alias("v")).orderBy("k").collect()]


def test_sections_cover_the_text_without_a_gap(spark):
    texts = ["", None, "no heading at all", "Pay:\n30\nPlace:\nOslo", "é😀 before\n## Über uns\nwe\n\n  Pay (US): \n 40 \nEnds. Not: this\n", "\n\nA:\n", "a.b:\nno heading\n" + "x" * 100 + ":\n"]
    for whole, got in zip(texts, each(spark, evidence.sections, texts), strict=True):
        starts = [s.start for s in got]
        assert starts == sorted(set(starts)) and (starts[:1] == [0] or not whole)
        for s, end in zip(got, [*starts[1:], len(whole or "")]):
            assert whole[s.start : end].endswith(s.text + whole[s.start : end][len(whole[s.start : end].rstrip()) :])
            assert s.label is None or s.label in whole[s.start : end].split("\n")[0]
    assert [(s.label, s.text) for s in each(spark, evidence.sections, texts)[4]] == [(None, "é😀 before"), ("Über uns", "we"), ("Pay (US)", "40 \nEnds. Not: this")]


def test_many_sections_of_a_very_long_text(spark):
    (got,) = each(spark, evidence.sections, ["".join(f"Part {k}:\n{'word ' * 40}\n" for k in range(1500))])
    assert len(got) == 1500 and got[-1].label == "Part 1499"


def test_dates(spark):
    cases = {"on 2027-05-01.": "2027-05-01", "May 1st, 2027": "2027-05-01", "by 9 sept 2027": "2027-09-09", "5/13/2027": "2027-05-13", "13/5/2027": "2027-05-13", "5/6/2027": None, "30 February 2027": None, "2027-13-01": None, "May 22": None, "": None, None: None}
    assert [str(d) if d else None for d in each(spark, extract.stated_date, list(cases))] == list(cases.values())


def test_modes_deadlines_and_seasons(spark):
    modes = {"Work location: On-site": "onsite", "This role is a hybrid position. x": "hybrid", "The job is remote if you like": None, "The job may change. This internship is fully remote": "remote", "remote": None, "": None, None: None}
    assert each(spark, evidence.page_work_mode, list(modes)) == list(modes.values())
    due = {
        "Applications are reviewed on a rolling basis.": ("rolling", None), "Applications may be reviewed on rolling basis": None, "Started 2027-01-01. Deadline unknown. Apply by June 3, 2027": ("date", "2027-06-03"), "": None, None: None,
        "If late, applications are accepted on a rolling basis. Closes 2027-02-03.": ("date", "2027-02-03"),
    }
    assert [(d.kind, str(d.date) if d.date else None) if d else None for d in each(spark, evidence.deadline, list(due))] == list(due.values())
    seasons = {"SUMMER Internship 2027": ("summer", 2027), "Graduating Spring 2026. Fall 2027 start": ("fall", 2027), "winter": None, None: None}
    assert [tuple(s) if s else None for s in each(spark, extract.stated_season, list(seasons))] == list(seasons.values())


def test_content_hash(spark):
    rows = spark.createDataFrame([(" Títle\x07 ", "a\r\nb\rc\x00\t\"q\""), ("t", "ab€€"), (None, None)], "t string, d string")
    told = [("Títle", 'a\nb\nc\t"q"', "complete"), ("t", "ab€", "incomplete"), ("", "", "complete")]
    sha = [hashlib.sha256(json.dumps({"title": t, "description": d, "completeness": c}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for t, d, c in told]
    got = rows.select(evidence.content_hash(F.col("t"), F.col("d"), 8).alias("x")).collect()
    assert got[0].x.hash != sha[0] and not got[0].x.complete
    assert rows.select(evidence.content_hash(F.col("t"), F.col("d")).alias("x")).first().x.hash == sha[0]
    got = rows.select(evidence.content_hash(F.col("t"), F.col("d"), 7).alias("x")).collect()
    assert [r.x.hash for r in got[1:]] == sha[1:] and [r.x.complete for r in got[1:]] == [False, True]


def test_structured_fields_and_titles(spark):
    rows = spark.createDataFrame(
        [(1, "Intern", "Pay: $30 - $35 per hour\nNYC:\nUSD 30 - 35 per hour", "$30 - $35 per hour", "rolling", "Hybrid"), (2, "PhD intern", "", None, None, None), (3, None, None, None, None, None), (4, "x", "Deadline: 2027-01-02", None, "soon", "moon")],
        "id int, title string, description string, pay string, due string, evidence_mode string",
    )
    got = {r.id: r.evidence for r in evidence.with_evidence(rows, pay="pay", due="due", mode="evidence_mode").collect()}
    assert [(p.low, p.high, p.currency, p.label) for p in got[1].pay] == [(30, 35, "USD", "NYC")] and (got[1].work_mode, got[1].deadline.kind) == ("hybrid", "rolling")
    assert got[2].from_title.levels == ["doctoral"] and got[2].levels == [] and got[3] is None
    assert str(got[4].deadline.date) == "2027-01-02" and got[4].work_mode is None and got[4].excerpts["deadline"].endswith("Deadline: 2027-01-02")
    assert evidence.with_evidence(rows.limit(0)).count() == 0 and evidence.with_evidence(rows).columns[:6] == rows.columns
