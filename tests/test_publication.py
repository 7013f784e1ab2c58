"""A publisher that stops at any stage leaves readers a whole version; increments equal full rebuilds."""

import random

import parity
import pytest
from pyspark.sql import functions as F

from larkspur import catalogue
from larkspur.sinks import publication

SCHEMA = "id long, title string, pay double"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/published"


def seen(spark, root):
    rows = publication.current(spark, root, "id")
    return None if rows is None else sorted(map(tuple, rows.select("id", "title", "pay").collect()))


def dirs(root, kind):
    import os

    path = f"{root.removeprefix('file://')}/{kind}"
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


def test_query(spark):
    assert parity.compare(spark, catalogue.QUERIES["paged_publication"], catalogue.ORACLE["paged_publication"], "/root/testdata/sf0.001") == ""


def test_stops_leave_the_version_before(spark, root, monkeypatch):
    first, second = [(1, "a", 1.0), (2, "b", None)], [(2, "b", None), (3, None, 3.0)]
    table = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert seen(spark, root) is None
    assert publication.publish(table(first), root, "id", 1_000).written == 2

    def killed(*_):
        raise KeyboardInterrupt

    for stage in ("stage_pages", "verify", "activate"):
        monkeypatch.setattr(publication, stage, killed)
        with pytest.raises(KeyboardInterrupt):
            publication.publish(table(second), root, "id", 2_000)
        monkeypatch.undo()
        assert seen(spark, root) == first
    # Only what was staged for a rename that may have happened is left, and goes after the delay.
    assert len(dirs(root, "pages")) == 2
    assert publication.retire(spark, root, 2_000 + publication.DELAY_MS - 1) == []
    assert len(publication.retire(spark, root, 2_000 + publication.DELAY_MS)) == 2 and seen(spark, root) == first
    done = publication.publish(table(second), root, "id", 3_000)
    assert (done.outcome, done.written, done.retired) == ("published", 1, 1) and seen(spark, root) == second


def test_lost_or_altered_rows_are_not_shown(spark, root, monkeypatch):
    table = spark.createDataFrame([(i, f"t{i}", float(i)) for i in range(40)], SCHEMA)
    publication.publish(table, root, "id", 1_000)
    whole = publication.stage_pages
    for spoil in (lambda df: df.where("id <> 7"), lambda df: df.withColumn("title", F.upper("title")), lambda df: df.unionByName(df.where("id = 7"))):
        monkeypatch.setattr(publication, "stage_pages", lambda rows, *a, s=spoil: whole(s(rows), *a))
        with pytest.raises(publication.Unverified):
            publication.publish(table.withColumn("pay", F.col("pay") + 1), root, "id", 2_000)
    monkeypatch.undo()
    assert len(seen(spark, root)) == 40 and len(dirs(root, "pages")) == len(dirs(root, "manifests")) == 1
    for keys in ([1, 1], [None, 2]):
        with pytest.raises(ValueError, match="null or repeats"):
            publication.publish(spark.createDataFrame([(k, "x", 1.0) for k in keys], SCHEMA), root, "id", 2_000)


def test_unchanged_stale_damaged_and_empty(spark, root):
    import glob
    import os

    table = spark.createDataFrame([(i, f"t{i}", float(i)) for i in range(25)], SCHEMA)
    first = publication.publish(table, root, "id", 1_000, page_rows=4)
    assert len(glob.glob(f"{root.removeprefix('file://')}/pages/*/*.parquet")) >= 7
    assert publication.publish(table.orderBy(F.desc("id")), root, "id", 2_000).outcome == "unchanged"
    assert publication.publish(table.limit(3), root, "id", 1_999).outcome == "stale" and len(seen(spark, root)) == 25
    os.remove(glob.glob(f"{root.removeprefix('file://')}/pages/*/*.parquet")[0])
    mended = publication.publish(table, root, "id", 3_000)
    assert (mended.outcome, mended.version, mended.written) == ("repaired", first.version, 25) and len(seen(spark, root)) == 25
    assert publication.publish(table.limit(0), root, "id", 4_000).retired == 25 and seen(spark, root) == []
    assert publication.publish(table, root, "id", 5_000).written == 25


def test_increments_equal_full_rebuilds(spark, root, tmp_path):
    rng, state = random.Random(3), {i: ("t", 0.0) for i in range(60)}
    for turn in range(1, 8):
        for i in rng.sample(range(80), 9):
            if rng.random() < 0.3:
                state.pop(i, None)
            else:
                state[i] = (rng.choice("abc"), float(turn))
        table = spark.createDataFrame([(i, *v) for i, v in state.items()], SCHEMA)
        done = publication.publish(table, root, "id", 1_000 * turn, live_sets=3)
        assert done.version == publication.publish(table, f"file://{tmp_path}/full{turn}", "id", 1).version
        assert seen(spark, root) == sorted((i, *v) for i, v in state.items())
        assert len(publication.pointer(spark, root)["parts"]) <= 4
        publication.retire(spark, root, 1_000 * turn + 500, delay=1_000)
    page = publication.page_after(spark, root, "id", 10, 5).collect()
    assert [r.id for r in page] == sorted(i for i in state if i > 10)[:5]
