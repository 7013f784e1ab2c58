"""Selections, repairs and stated pay on small cases: nulls, empty tables, ties, what is passed over."""

import pytest
from pyspark.sql import functions as F

from larkspur.functions import money
from larkspur.plans import selection

ITEMS = "g int, item string, parent string, rank int"


def _selected(spark, rows, most):
    return {r.item for r in selection.closed_selection(spark.createDataFrame(rows, ITEMS), "g", "item", "parent", "rank", most).collect()}


def test_child_brings_its_parent(spark):
    rows = [(1, "b", "p", 1), (1, "x", None, 2), (1, "p", None, 3), (1, "y", None, 4)]
    assert _selected(spark, rows, 3) == {"b", "p", "x"}


def test_what_needs_two_places_is_passed_over(spark):
    rows = [(1, "x", None, 1), (1, "b", "p", 2), (1, "c", "x", 3), (1, "y", None, 4), (1, "p", None, 5)]
    assert _selected(spark, rows, 2) == {"x", "c"}
    assert _selected(spark, rows, 9) == {"x", "b", "p", "c", "y"}
    assert _selected(spark, [], 2) == set()


def test_only_place_goes_to_who_needs_one(spark):
    assert _selected(spark, [(1, "b", "p", 1), (1, "p", None, 2), (1, "y", None, 3)], 1) == {"p"}


def test_claims_refuse_what_is_not_allowed(spark):
    rows = [("a", 1, "delivered"), ("a", 2, "accepted"), ("a", 3, "accepted"), ("a", 4, "delivered"), ("a", 5, "unknown"), ("b", 1, None)]
    got = selection.delivery_claims(spark.createDataFrame(rows, "claim string, at int, said string"), "claim", "at", "said")
    assert {tuple(r) for r in got.collect()} == {("a", "delivered", 2, 3), ("b", "claimed", 0, 1)}


def test_titles_are_repaired(spark):
    known = spark.createDataFrame([("a", "Data Intern (Core)"), ("a", "Data Intern"), ("b", "Data Intern of b"), ("a", None)], "company string, title string")
    cut = spark.createDataFrame([("a", "Data In..."), ("b", "Data In…"), ("c", "Data Intern (Rec..."), ("a", "..."), ("a", " whole "), ("a", None), (None, "Data In...")], "company string, title string")
    got = {(r.company, r.title): r.repaired for r in selection.repaired_titles(cut, known, "company", "title").collect()}
    assert got == {("a", "Data In..."): "Data Intern", ("b", "Data In…"): "Data Intern of b", ("c", "Data Intern (Rec..."): "Data Intern", ("a", "..."): "...", ("a", " whole "): "whole", ("a", None): None, (None, "Data In..."): "Data"}


@pytest.mark.parametrize(("text", "told"), [(None, []), ("", []), ("USD $50/hr and $600 per hour", [(50.0, 50.0, "USD", "hourly"), (600.0, 600.0, "XXX", "hourly")]), ("CHF 30 per hour", [(30.0, 30.0, "CHF", "hourly")])])
def test_stated_pay(spark, text, told):
    df = spark.createDataFrame([(text,)], "text string").select(money.pay_ranges(F.col("text")).alias("x"))
    assert [tuple(x) for x in df.first().x] == told


def test_fields_go_at_every_depth(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'at', 2, 'xs', array(named_struct('at', 3, 'b', 4), null)) AS v UNION ALL SELECT null")
    got = [r.v for r in df.select(selection.without_fields(F.col("v"), df.schema["v"].dataType, frozenset({"at"})).alias("v")).collect()]
    assert got[0].asDict(True) == {"a": 1, "xs": [{"b": 4}, None]} and got[1] is None


def test_members_and_snapshots(spark):
    pairs = spark.sql("SELECT * FROM VALUES (array(1, 2, 2), array(2, 1, 2)), (array(1, 2), array(1, 1)), (array(1), null), (null, null) AS t(a, b)")
    assert [r.same for r in pairs.select(selection.same_members(F.col("a"), F.col("b")).alias("same")).collect()] == [True, False, False, True]
    rows = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    got = selection.verified_selection(rows, "k", spark.createDataFrame([(2,), (2,), (3,)], "k int"), ["k", "v"]).collect()
    assert [(r.k, r.all_rows) for r in got] == [(2, 2)]
