"""Streams over the events table, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.plans import reconcile
from larkspur.session import table
from larkspur.storage import scratch
from larkspur.streaming import flows, keyed


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream. The pattern matches a file as well as a folder, of which a plain path must be one."""
    stream = flows.read_events(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema)
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


@query("outbox_dedupe", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def outbox_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every purchase is delivered twice and comes out once."""
    stream = _events(spark, sf).where("event_type = 'purchase'").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = scratch(spark, "outbox")
    flows.drain(flows.outbox(stream, "event_id", "ts", "1 hour").select("event_id", "user_id"), out, scratch(spark, "checkpoint"))
    return spark.read.schema("event_id long, user_id long").parquet(out)


@query("stream_discovery", "SELECT event_type, count(*) AS n, min(event_id) AS first_id, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Micro-batches of events, each folded in by key; a batch that runs again overwrites its own part."""
    out = scratch(spark, "discovery")

    def step(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    flows.drain_each(_events(spark, sf), scratch(spark, "checkpoint"), step)
    parts = spark.read.parquet(out)
    users = parts.groupBy("event_type", "user_id").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    return users.groupBy("event_type").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.count("*").alias("users"))


@query("state_machine")
def state_machine(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's admission state after all events, with how often it moved."""
    stream = _events(spark, sf).withColumn("at", F.unix_micros("ts") * 1000 + F.col("event_id") % 1000)
    out = scratch(spark, "states")
    flows.drain(flows.state_machine(stream, "user_id", "at", "event_type"), out, scratch(spark, "checkpoint"))
    states = spark.read.schema("user_id long, state string, last long, moves long, late long").parquet(out)
    return states.groupBy("user_id").agg(F.max_by("state", "last").alias("state"), F.max("moves").alias("moves"))


@query(
    "release_windows",
    """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS release FROM g)
    SELECT user_id, min(ts) AS opened_at, max(ts) + INTERVAL 1 HOUR AS closes_at, count(*) AS n FROM s GROUP BY user_id, release""",
)
def release_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events within an hour of each other are one release; those still open at the end count too."""
    return releases(spark, _events(spark, sf))


def releases(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Micro-batches of releases, made one where they meet; a batch that runs again overwrites its own part."""
    out = scratch(spark, "releases")

    def step(batch: DataFrame, number: int) -> None:
        flows.release_parts(batch, "user_id", "ts", "1 hour").write.mode("overwrite").parquet(f"{out}/batch={number}")

    flows.drain_each(stream, scratch(spark, "checkpoint"), step)
    parts = spark.read.schema("user_id long, opened_at timestamp, closes_at timestamp, n long").parquet(out)
    return flows.merge_releases(parts, "user_id").select("user_id", "opened_at", "closes_at", "n")


@query(
    "qualification",
    """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type <> 'error'), g AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS i FROM d), l AS (SELECT user_id, i, count(*) AS run, max(day) AS fin FROM g GROUP BY 1, 2)
    SELECT user_id, least(2, arg_max(run, fin)) AS streak, arg_max(run, fin) >= 2 AS qualified FROM l GROUP BY 1""",
)
def qualification(spark: SparkSession, sf: str) -> DataFrame:
    """Two complete days in a row qualify; a gap begins anew."""
    from larkspur.operators.relational import streaks

    days = table(spark, sf, "events").where("event_type <> 'error'").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day")).distinct()
    s = streaks(days, "user_id", "day")
    return s.select("user_id", F.least(F.lit(2).cast("long"), "current").alias("streak"), (F.col("current") >= 2).alias("qualified"))


@query("material_hashes", "SELECT o_orderkey, sha256('{\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_orderpriority\":\"' || o_orderpriority || '\"}') AS material FROM orders")
def material_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", reconcile.material_hash("o_orderstatus", "o_orderpriority").alias("material"))


#: The events of the table as events of an admission: by type, and by whether the id is even.
ADMISSION = {"view": ("dispatch", "lease"), "click": ("settle", "lease"), "error": ("retry", "quarantine"), "purchase": ("mark-absent", "reopen"), "signup": ("reappear", "reclaim-lease")}
HOUR = 3_600_000
_NAMES = " ".join(f"WHEN event_type = '{t}' AND event_id % 2 = {k} THEN '{e}'" for t, pair in ADMISSION.items() for k, e in enumerate(pair))


@query(
    "admission_moves",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, CASE {_NAMES} END AS event, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
    m AS (
        SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS t, 'pending' AS state, 0 AS attempts, 0::BIGINT AS retry_at, 0::BIGINT AS lease_until, NULL::VARCHAR AS event, NULL::VARCHAR AS was, true AS ok, false AS reclaimed FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL
        SELECT user_id, k, t, CASE WHEN NOT ok THEN was WHEN event = 'mark-absent' THEN 'absent' WHEN event = 'lease' THEN 'processing' WHEN event = 'settle' THEN 'settled' WHEN event = 'quarantine' OR event = 'retry' AND attempts >= 2 THEN 'quarantined' ELSE 'queued' END,
            CASE WHEN NOT ok OR event IN ('lease', 'quarantine', 'reclaim-lease') THEN attempts WHEN event = 'retry' THEN attempts + 1 ELSE 0 END,
            CASE WHEN NOT ok OR event IN ('lease', 'quarantine', 'reclaim-lease') THEN retry_at WHEN event = 'retry' AND attempts = 0 THEN t + {2 * HOUR} WHEN event = 'retry' AND attempts = 1 THEN t + {8 * HOUR} ELSE 0 END,
            CASE WHEN ok THEN CASE WHEN event = 'lease' THEN t + {24 * HOUR} ELSE 0 END ELSE lease_until END, event, was, ok, reclaimed
        FROM (SELECT *, CASE event WHEN 'dispatch' THEN was IN ('pending', 'absent') WHEN 'lease' THEN was IN ('pending', 'queued') AND t >= retry_at WHEN 'reopen' THEN was IN ('settled', 'quarantined') WHEN 'mark-absent' THEN true WHEN 'reappear' THEN was = 'absent' ELSE was = 'processing' END AS ok
            FROM (SELECT m.user_id, e.k, e.t, e.event, m.attempts, m.retry_at, CASE WHEN m.state = 'processing' AND m.lease_until <= e.t THEN 'queued' ELSE m.state END AS was, CASE WHEN m.state = 'processing' AND m.lease_until <= e.t THEN 0 ELSE m.lease_until END AS lease_until, m.state = 'processing' AND m.lease_until <= e.t AS reclaimed FROM m JOIN e ON e.user_id = m.user_id AND e.k = m.k + 1) x) y
    ),
    last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS r FROM m)
    SELECT user_id, event, was, state, ok, count(*) AS n FROM (
        SELECT user_id, event, was, state, ok FROM m WHERE k > 0
        UNION ALL SELECT user_id, 'reclaim-lease', 'processing', 'queued', true FROM m WHERE reclaimed
        UNION ALL SELECT user_id, 'reclaim-lease', 'processing', 'queued', true FROM last WHERE r = 1 AND state = 'processing' AND lease_until <= (SELECT max(epoch_us(ts) // 1000) FROM events)
    ) GROUP BY ALL""",
)
def admission_moves(spark: SparkSession, sf: str) -> DataFrame:
    """How often each user's row moved by each event from each state, leases that ran out among them."""
    named = F.expr(f"CASE {_NAMES} END").alias("event")
    stream = flows.read_events(spark, f"{sf}/events.parque[t]", table(spark, sf, "events").schema).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id", named)
    out = scratch(spark, "admission")
    with keyed.rocks(spark):
        flows.drain(keyed.admission(stream, "user_id", delays=(2 * HOUR, 8 * HOUR), lease=24 * HOUR), out, scratch(spark, "checkpoint"))
    moves = spark.read.parquet(out)
    return moves.groupBy("user_id", "event", "was", "state", F.col("reason").isNull().alias("ok")).agg(F.count("*").alias("n"))


@query(
    "first_event_releases",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t FROM events),
    x AS (SELECT DISTINCT user_id, t, min(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {12 * HOUR} FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM e),
    w AS (SELECT user_id, min(t) AS opened_at FROM e GROUP BY 1 UNION ALL SELECT w.user_id, x.following FROM w JOIN x ON x.user_id = w.user_id AND x.t = w.opened_at WHERE x.following IS NOT NULL),
    g AS (SELECT w.user_id, w.opened_at, count(*) AS n, string_agg(e.event_id, ',' ORDER BY e.event_id) AS ids FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.opened_at AND e.t < w.opened_at + {12 * HOUR} GROUP BY w.user_id, w.opened_at)
    SELECT user_id, opened_at, opened_at + {12 * HOUR} AS flush_at, n, left(sha256('release-v1|' || user_id || '|' || opened_at || '|' || ids), 20) AS release_id FROM g WHERE opened_at + {12 * HOUR} <= (SELECT max(t) FROM e)""",
)
def first_event_releases(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events within twelve hours of the first one are a release; those still open at the end aren't out yet."""
    out = scratch(spark, "releases")
    with keyed.rocks(spark):
        flows.drain(keyed.first_event_windows(_events(spark, sf), "user_id", 12 * HOUR, "0 seconds"), out, scratch(spark, "checkpoint"))
    return spark.read.parquet(out).select("user_id", "opened_at", "flush_at", F.size("members").cast("long").alias("n"), "release_id")
