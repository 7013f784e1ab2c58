"""Golden cases and invariants of operators and functions on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.functions import classify, money, scores, text, time, url
from larkspur.operators import filters, relational
from larkspur.plans import grouping, reconcile


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("name", "key"), [("Acme Inc. Ltd", "acme"), ("Inc", "inc"), ("Café Größe GmbH", "cafe gro e"), ("Co Works", "co works")])
def test_company_key(spark, name, key):
    assert one(spark, text.company_key(F.lit(name))) == key


@pytest.mark.parametrize(
    ("shown", "want"),
    [("$45 - $55/hr", (45.0, 55.0, "hour", 55.0)), ("$120,000/year", (120000.0, 120000.0, "year", 57.6923)), ("$60k - $80k per year", (60000.0, 80000.0, "year", 38.4615)), ("$2/hr", None), ("none", None), (None, None)],
)
def test_pay(spark, shown, want):
    got = one(spark, money.pay(F.lit(shown).cast("string")))
    assert (tuple(got) if got else None) == want


def test_season_and_past(spark):
    assert one(spark, classify.season(F.lit("Summer 2027 intern"), 2026)) == "summer-2027"
    assert one(spark, classify.season(F.lit("Fall or winter 2027"), 2026)) == "offseason-2027"
    assert one(spark, classify.season(F.lit("Summer 2040"), 2026)) is None
    june, may = (F.lit(dt.date(2027, m, 1)) for m in (6, 5))
    assert one(spark, classify.past_season(F.lit("summer-2027"), june)) is True
    assert one(spark, classify.past_season(F.lit("summer-2027"), may)) is False


def test_zone_day(spark):
    ts = F.lit("2026-09-18 02:00:00").cast("timestamp")
    assert one(spark, time.zone_day(ts, "America/Los_Angeles")) == dt.date(2026, 9, 17)
    assert one(spark, time.zone_day(ts, "No/Where")) == dt.date(2026, 9, 18)


def test_quiet_hours(spark):
    minute = F.lit(23 * 60 + 30)
    assert one(spark, time.is_quiet(minute, 22 * 60, 7 * 60)) is True
    assert one(spark, time.is_quiet(F.lit(12 * 60), 22 * 60, 7 * 60)) is False
    assert one(spark, time.is_quiet(minute, 60, 60)) is False


def test_opportunity_score(spark):
    pay = scores.piecewise(F.lit(35.0), [(20.0, 20.0), (50.0, 80.0)])
    assert one(spark, pay) == 50.0
    assert one(spark, scores.opportunity(F.lit(50.0), F.lit(None).cast("double"), F.lit(90.0))) == 64.3
    assert one(spark, scores.half_up(F.lit(-0.25))) == -0.2


def test_word_prefix_is_not_substring(spark):
    assert one(spark, filters.prefixes_words(F.lit("Avenue road"), ["av"])) is True
    assert one(spark, filters.prefixes_words(F.lit("Brave"), ["av"])) is False


def test_unspecified_never_excludes(spark):
    rows = spark.createDataFrame([("unspecified", False), ("conflicting", None), (None, False), ("stated", False), ("stated", None), ("stated", True)], "s string, m boolean")
    assert [r[0] for r in rows.select(filters.unless_stated(F.col("s"), F.col("m"))).collect()] == [True, True, True, False, False, True]


@pytest.mark.parametrize("n", [1, 3, 19, 20, 21, 24, 40, 41, 43, 60, 61, 499])
def test_chunks(spark, n):
    """Brute force: chunks of 20, a last one of fewer than 4 borrows from the one before."""
    sizes = [20] * (n // 20) + ([n % 20] if n % 20 else [])
    if len(sizes) > 1 and sizes[-1] < 4:
        sizes[-2] -= 4 - sizes[-1]
        sizes[-1] = 4
    got = grouping.bounded_chunks(spark.range(n).withColumn("k", F.lit(1)), ["k"], ["id"]).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in got] == sizes


LEDGER = "id long, material_hash string, policy int, state string, omissions int, retry_at timestamp"


def test_diff_truth_table(spark):
    now = dt.datetime(2026, 1, 2)
    ledger = spark.createDataFrame(
        [(1, "a", 1, "done", 0, now), (2, "a", 2, "absent", 2, now), (3, "a", 2, "done", 0, now), (4, "a", 2, "retry", 0, now), (5, "a", 2, "done", 0, now), (6, "a", 2, "done", 0, now), (7, "a", 2, "done", 1, now), (8, "a", 2, "retry", 0, dt.datetime(2026, 1, 3))], LEDGER
    )
    current = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "b"), (4, "a"), (5, "a"), (8, "a")], "id long, material string")
    got = {r["id"]: (r["kind"], r["omissions"]) for r in reconcile.diff(current, ledger, "id", 2, F.lit(now)).collect()}
    assert got == {0: ("new", 0), 1: ("stale-policy", 0), 2: ("reappeared", 0), 3: ("changed", 0), 4: ("retryable", 0), 5: ("unchanged", 0), 6: ("omitted", 1), 7: ("absent", 2), 8: ("unchanged", 0)}
    assert reconcile.diff(current, ledger, "id", 2, F.lit(now), complete=False).count() == 0


def test_snapshot_hash_ignores_order(spark):
    rows = [(1, k, f"h{k}") for k in range(50)]
    digest = lambda r: reconcile.snapshot_hash(spark.createDataFrame(r, "g long, id long, h string").repartition(3), ["g"], "id", "h", F.col("id") % 7).collect()
    assert digest(rows) == digest(rows[::-1]) != digest([*rows[:-1], (1, 49, "other")])


def test_authority_keeps_best_and_names_conflicts(spark):
    rows = spark.createDataFrame([(1, 0, 5.0), (1, 1, 9.0), (2, 1, 3.0), (2, 1, 4.0), (2, 2, 3.0), (3, 2, None)], "k long, p int, v double")
    got = {r["k"]: (r["value"], r["conflict"], r["evidence"]) for r in reconcile.by_authority(rows, "k", "p", "v").collect()}
    assert got == {1: (5.0, False, 2), 2: (None, True, 3), 3: (None, False, 1)}


def test_aliases_quarantine(spark):
    aliases = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "z")], "k long, alias string")
    claims = spark.createDataFrame([("a", 10), ("b", 11)], "alias string, c long")
    got = {r["k"]: (r["decision"], r["c"]) for r in reconcile.resolve_aliases(aliases, claims, "k", "alias", "c").collect()}
    assert got == {1: ("quarantine", None), 2: ("merge", 10), 3: ("create", None)}


def test_streak_resets_on_gap(spark):
    days = spark.createDataFrame([(1, d) for d in (1, 2, 3, 5, 7)] + [(2, 5), (2, 6)], "k long, d long")
    assert {r["k"]: (r["longest"], r["current"]) for r in relational.streaks(days, "k", "d").collect()} == {1: (3, 1), 2: (2, 2)}


def test_change_only_replay_is_noop(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id long, s string, n long")
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, None, None)], "id long, s string, n long")
    changes = relational.change_only(new, old, "id", ["s", "n"])
    assert sorted((r["id"], r["change"]) for r in changes.collect()) == [(2, "update"), (3, "insert")]
    after = relational.upsert(old, changes, "id")
    assert relational.change_only(new, after, "id", ["s", "n"]).count() == 0
    assert relational.insert_if_absent(old, spark.createDataFrame([(2, "x", 1), (4, "y", 2), (4, "x", 9)], old.schema), "id").collect() == [(4, "x", 9)]


def test_interval_join_equals_brute_force(spark):
    base = dt.datetime(2026, 1, 1)
    left = [(k % 3, i, base + dt.timedelta(seconds=37 * i * i % 9000)) for i, k in enumerate(range(60))]
    right = [(k % 3, i, base + dt.timedelta(seconds=91 * i % 9000)) for i, k in enumerate(range(80))]
    got = relational.within_interval(spark.createDataFrame(left, "k long, l long, a timestamp"), spark.createDataFrame(right, "k long, r long, b timestamp"), "k", "a", "b", 600)
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] < y[2] <= x[2] + dt.timedelta(seconds=600))
    assert sorted((r["l"], r["r"]) for r in got.collect()) == want


def test_overlay_partial_cover_stays(spark):
    cards = spark.createDataFrame([(1, [1, 2]), (2, [3])], "c long, roles array<long>")
    live = spark.createDataFrame([(1,), (3,)], "r long")
    assert [r["c"] for r in reconcile.overlay(cards, live, "c", "roles", "r").collect()] == [1]


def test_urls(spark):
    assert one(spark, url.canonical(F.lit("HTTPS://A.Example.com/x/?b=2&utm_source=z&a=1#top"))) == "https://a.example.com/x?a=1&b=2"
    assert one(spark, url.canonical(F.lit("not an address"))) is None
    assert one(spark, url.registrable(F.lit("jobs.acme.co.uk"))) == "acme.co.uk"
    assert one(spark, url.admissible(F.lit("https://a.b.com/"), ["b.com"], ["a.b.com"])) is False


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, d long")
    assert relational.streaks(none, "k", "d").count() == 0
    assert relational.ordinal(none, ["k"]).count() == 0
    assert relational.shares(none, "k").count() == 0


def test_pack_equals_brute_force(spark):
    rows = [(k, t, (k * 7 + t * 13) % 11 + 1) for k in range(9) for t in range(15)]
    want = {}
    for k in range(9):
        fill = number = 0
        for t in range(15):
            s = rows[k * 15 + t][2]
            if t and fill + s > 20:
                fill, number = 0, number + 1
            fill += s
            want[k, t] = number
    got = grouping.pack(spark.createDataFrame(rows, "k long, t long, s long"), "k", "t", "s", 20)
    assert {(r["k"], r["t"]): r["pack"] for r in got.collect()} == want
