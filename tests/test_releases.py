"""Releases of users' events: open ones are returned, and micro-batches out of order change nothing."""

import datetime

from larkspur.queries import streams
from larkspur.streaming import flows

T = datetime.datetime(2024, 1, 1)


def test_open_and_late_releases(spark, tmp_path):
    minutes = {1: [0, 30, 90, 151, 400], 2: [399], 3: [10, 70, 131]}
    rows = [(u, T + datetime.timedelta(minutes=m)) for u, ms in minutes.items() for m in ms]
    for k, part in enumerate([rows[4:], rows[1:3], rows[3:4], rows[:1]]):
        spark.createDataFrame(part, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{k}")
    stream = flows.read_events(spark, f"{tmp_path}/*", "user_id long, ts timestamp", 1)
    got = sorted((r.user_id, (r.opened_at - T).seconds // 60, (r.closes_at - T).seconds // 60, r.n) for r in streams.releases(spark, stream).collect())
    assert got == [(1, 0, 150, 3), (1, 151, 211, 1), (1, 400, 460, 1), (2, 399, 459, 1), (3, 10, 130, 2), (3, 131, 191, 1)]
