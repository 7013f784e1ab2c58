"""Streams over files of events. Each wraps the batch operators or keeps state by key; all run to the end of their input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What a row's admission may do: (state, event) -> next state. Events that have no rule leave the state as it is.
TRANSITIONS = {
    ("pending", "view"): "leased",
    ("pending", "error"): "retry",
    ("leased", "click"): "done",
    ("leased", "error"): "retry",
    ("retry", "view"): "leased",
    ("done", "purchase"): "published",
    ("published", "signup"): "done",
}


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream, in micro-batches of so many files; files are taken by their time of writing."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, in micro-batches, into Parquet, and stop. Replaying adds nothing: the checkpoint knows what is done."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def drain_each(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> None:
    """Run a batch operator on every micro-batch; its effect must be keyed by the batch number, so that a replay is a no-op."""
    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start().awaitTermination()


def outbox(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each event once, however often it is delivered within the watermark's delay."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def release_windows(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Events of a key that follow each other within `gap`: one release, closed when the watermark has passed it.

    For streams without an end: rows later than `late` are dropped and open releases are held back. Over an input
    that ends, fold micro-batches with `release_parts` and `merge_releases`, which lose neither.
    """
    seen = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return seen.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("opened_at"), F.col("w.end").alias("closes_at"), "n")


def release_parts(batch: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """The releases within one micro-batch, open ones too: key, opened_at, closes_at, n. Rows without a time have none."""
    seen = batch.where(F.col(time).isNotNull()).select(key, F.col(time).cast("timestamp").alias("opened_at"))
    return merge_releases(seen.withColumn("closes_at", F.col("opened_at") + F.expr(f"INTERVAL {gap}")).withColumn("n", F.lit(1).cast("long")), key)


def merge_releases(parts: DataFrame, key: str) -> DataFrame:
    """Releases of all micro-batches made one where they meet; in whatever order rows came, none is late."""
    before = Window.partitionBy(key).orderBy("opened_at", "closes_at").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col("opened_at") > F.max("closes_at").over(before)).cast("int"), F.lit(1))
    upto = Window.partitionBy(key).orderBy("opened_at", "closes_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = parts.withColumn("fresh", fresh).withColumn("release", F.sum("fresh").over(upto))
    return numbered.groupBy(key, "release").agg(F.min("opened_at").alias("opened_at"), F.max("closes_at").alias("closes_at"), F.sum("n").alias("n")).drop("release")


def state_machine(stream: DataFrame, key: str, order: str, event: str, transitions: dict[tuple[str, str], str] | None = None, start: str = "pending") -> DataFrame:
    """Follow every key's state through its events; a row for each key and micro-batch with the state after it.

    Events are taken in `order` within a batch; one that is older than the state's last is late and is dropped.
    """
    rules = transitions or TRANSITIONS

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last, moves, late = state.get if state.exists else (start, -1, 0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for at, what in zip(rows[order], rows[event], strict=True):
            if at <= last:
                late += 1
                continue
            to = rules.get((now, what), now)
            moves, now, last = moves + (to != now), to, int(at)
        state.update((now, last, moves, late))
        yield pd.DataFrame({key: [k[0]], "state": [now], "last": [last], "moves": [moves], "late": [late]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, state string, last long, moves long, late long", "state string, last long, moves long, late long", "append", GroupStateTimeout.NoTimeout)


def apply_transitions(current: DataFrame, events: DataFrame, key: str, state: str, event: str, transitions: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """One step of the machine in batch: at most one event for each key, the rules as a map of constants."""
    rules = transitions or TRANSITIONS
    known = F.create_map(*[F.lit(x) for (s, e), to in rules.items() for x in (f"{s}|{e}", to)])
    both = current.join(events.select(F.col(key).alias("__k"), F.col(event).alias("__e")), F.col(key) == F.col("__k"), "left")
    return both.withColumn(state, F.coalesce(F.try_element_at(known, F.concat_ws("|", state, "__e")), state)).drop("__k", "__e")
