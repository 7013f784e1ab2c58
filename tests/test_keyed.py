"""Keyed state over several micro-batches against plain sequential versions, and the queries against their twins."""

import datetime as dt
import random

import parity
import pytest
from pyspark.sql import functions as F

from larkspur import catalogue
from larkspur.streaming import flows, keyed

SCHEMA = "user_id long, ts timestamp, event_id long, event string"
BASE = 1_700_000_000_000


def run(spark, tmp_path, batches, build):
    """Each list of rows is a file, each file a micro-batch, in order."""
    source = f"{tmp_path}/in"
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame([(u, dt.datetime.fromtimestamp(at / 1000, dt.timezone.utc), i, e) for u, at, i, e in rows], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = flows.read_events(spark, source, spark.read.parquet(source).schema, 1)
    with keyed.rocks(spark):
        flows.drain(build(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return spark.read.parquet(f"{tmp_path}/out")


@pytest.mark.parametrize("name", ["admission_moves", "first_event_releases"])
def test_queries(spark, name):
    assert parity.compare(spark, catalogue.QUERIES[name], catalogue.ORACLE[name], "/root/testdata/sf0.001") == ""


def test_every_rule():
    want = {("pending", "dispatch"): "queued", ("absent", "dispatch"): "queued", ("pending", "lease"): "processing", ("queued", "lease"): "processing", ("processing", "settle"): "settled", ("processing", "retry"): "queued",
            ("processing", "quarantine"): "quarantined", ("processing", "reclaim-lease"): "queued", ("quarantined", "reopen"): "queued", ("settled", "reopen"): "queued", ("absent", "reappear"): "queued", **{(s, "mark-absent"): "absent" for s in keyed.STATES}}
    for state in keyed.STATES:
        for event in [*keyed.EVENTS, "unheard-of"]:
            move = keyed.Row(state).take(1, 1, event, keyed.DELAYS_MS, keyed.LEASE_MS)
            assert move[4] == want.get((state, event), state)
            assert (move[5] is None) == ((state, event) in want)
            if move[5]:
                assert move[5] == f"illegal-transition:{state}->{event}"


def test_leases_retries_and_quarantine():
    row, go = keyed.Row(), lambda at, event: row.take(at, at, event, keyed.DELAYS_MS, keyed.LEASE_MS)
    assert go(0, "lease")[4] == "processing" and row.lease_until == 120_000
    assert go(10, "retry")[4:] == ("queued", None, 1) and row.retry_at == 60_010
    assert go(60_009, "lease")[5] == "retry-not-due" and go(60_010, "lease")[4] == "processing"
    assert row.expire(180_009) is None and row.expire(180_010)[0] == 180_010 and row.state == "queued"
    go(200_000, "lease")
    assert go(200_001, "retry")[4] == "queued" and row.retry_at == 500_001
    go(600_000, "lease")
    assert go(600_001, "retry")[4:] == ("quarantined", None, 3)
    assert go(600_001, "reopen")[5] == "late" and go(600_002, "reopen")[4:] == ("queued", None, 0)


def test_admission_over_micro_batches(spark, tmp_path):
    rng = random.Random(8)
    events, at = [], BASE
    for i in range(600):
        at += rng.choice((0, 0, 5_000, 70_000))
        events.append((rng.randrange(7), at, i, rng.choice([*keyed.EVENTS, "lease", "lease", "retry", "dispatch"])))
    events.append((99, at + 10_000_000, 601, "dispatch"))
    want = []
    rows = {}
    for user, t, i, e in events:
        row = rows.setdefault(user, keyed.Row())
        if ended := row.expire(t):
            want.append((user, *ended))
        want.append((user, *row.take(t, i, e, keyed.DELAYS_MS, keyed.LEASE_MS)))
    want += [(u, *ended) for u, row in rows.items() if (ended := row.expire(at + 10_000_000))]
    cuts = [0, 100, 101, 350, len(events)]
    got = run(spark, tmp_path, [events[a:b] for a, b in zip(cuts, cuts[1:])], lambda s: keyed.admission(s, "user_id"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(m[3] == "reclaim-lease" and m[2] is None for m in want) > 10 and any(m[5] == "quarantined" and m[3] == "retry" for m in want)


def test_releases_of_shuffled_micro_batches(spark, tmp_path):
    rng = random.Random(5)
    events = [(rng.randrange(4), BASE + rng.randrange(600) * 1000, i, "view") for i in range(500)]
    events += [(u, t, i, e) for u, t, i, e in events[:20]]
    end = (50, BASE + 10_000_000, 9_999, "view")
    want = []
    for user in range(4):
        opened, members = None, []
        for at, i in sorted({(t, i) for u, t, i, _ in events if u == user}):
            if opened is None or at >= opened + 8_000:
                if members:
                    want.append((user, opened, opened + 8_000, sorted(members), keyed.release_id(user, opened, members)))
                opened, members = at, []
            members.append(i)
        want.append((user, opened, opened + 8_000, sorted(members), keyed.release_id(user, opened, members)))
    rng.shuffle(events)
    got = run(spark, tmp_path, [events[:150], events[150:151], events[151:400], events[400:], [end]], lambda s: keyed.first_event_windows(s, "user_id", 8_000, "20 minutes"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got.where(F.size("members") > 1).count() > 20
