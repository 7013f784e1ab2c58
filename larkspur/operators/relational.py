"""Joins, aggregates, windows, set operations and pages as functions of DataFrames.

None of them collects, and each shuffles at most once on its key. Sides that are small by nature are left
to adaptive execution, which broadcasts them by their measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order` (which must break ties)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def without(df: DataFrame, *others: tuple[DataFrame, str, str]) -> DataFrame:
    """Anti join against several sets: (frame, our column, their column) each."""
    for other, ours, theirs in others:
        df = df.join(other.select(F.col(theirs).alias("__key")).distinct(), F.col(ours) == F.col("__key"), "left_anti")
    return df


def two_hop(events: DataFrame, alias: DataFrame, target: DataFrame, key: str, alias_from: str, alias_to: str, target_key: str) -> DataFrame:
    """Left join to aliases, then inner to the target on the coalesced key."""
    names = alias.select(F.col(alias_from).alias("__from"), F.col(alias_to).alias("__to"))
    return events.join(names, F.col(key) == F.col("__from"), "left").withColumn("canonical", F.coalesce("__to", key)).drop("__from", "__to").join(target, F.col("canonical") == F.col(target_key))


def within_interval(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs on a key whose right time lies in (left time, left time + seconds].

    Times are cut into bins of that width; a left row meets its own bin and the next, so the join is an equi
    join on key and bin, and a key with many rows is spread over its bins.
    """
    bin_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("__bin", F.explode(F.array(bin_of(left_time), bin_of(left_time) + 1)))
    b = right.withColumnRenamed(on, "__on").withColumn("__b", bin_of(right_time))
    hit = (F.col(on) == F.col("__on")) & (F.col("__bin") == F.col("__b")) & (F.col(right_time) > F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"interval {seconds} seconds"))
    return a.join(b, hit).drop("__bin", "__b", "__on")


def ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """A global running number from 0 in `order`, without one task seeing all rows.

    Rows are range-partitioned; each partition's count is summed up for those behind it, and numbers inside a
    partition come from a window over it.
    """
    ranged = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    # One row for each partition: a window over these few numbers is small by construction.
    base = counts.select(F.col("__p").alias("__q"), (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__base"))
    inner = Window.partitionBy("__p").orderBy(*order)
    return ranged.join(F.broadcast(base), F.col("__p") == F.col("__q")).withColumn(name, F.col("__base") + F.row_number().over(inner) - 1).drop("__p", "__q", "__base")


def numbered(df: DataFrame, keys: list[str], order: str, width: int = 10_000, name: str = "place") -> DataFrame:
    """A running number from 1 within each key (none of them null), by a whole number that grows with the rows, though a key may hold most rows.

    Rows of a key are numbered within stretches of `width` of `order`; the counts of earlier stretches are added.
    """
    cut = df.withColumn("__s", F.floor(F.col(order) / width))
    counts = cut.groupBy(*keys, "__s").agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__s")) - F.col("__c")).drop("__c")
    inner = F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(order))
    return cut.withColumn("__i", inner).join(before, [*keys, "__s"]).withColumn(name, F.col("__before") + F.col("__i")).drop("__s", "__i", "__before")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to and with this row, within each key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def streaks(days: DataFrame, key: str, number: str) -> DataFrame:
    """Longest run of consecutive numbers for each key, and the streak that the last one is in (1 after a gap)."""
    island = F.col(number) - F.row_number().over(Window.partitionBy(key).orderBy(number))
    runs = days.withColumn("__i", island).groupBy(key, "__i").agg(F.count("*").alias("run"), F.max(number).alias("__end"))
    return runs.groupBy(key).agg(F.max("run").alias("longest"), F.max_by("run", "__end").alias("current"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page in `order`, numbered: takes the best offset + limit rows of each task only."""
    top = df.orderBy(*order).limit(offset + limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") > offset)


def after_key(df: DataFrame, order: list[str], last: list, limit: int) -> DataFrame:
    """A keyset page: the rows behind `last` in ascending order. The leading column's bound is pushed to the scan."""
    return df.where(F.col(order[0]) >= F.lit(last[0]).cast(df.schema[order[0]].dataType)).where(F.struct(*order) > F.struct(*[F.lit(x).cast(df.schema[c].dataType).alias(c) for c, x in zip(order, last, strict=True)])).orderBy(*order).limit(limit)


def least_due(branches: list[tuple[DataFrame, str]], key: str, limit: int) -> DataFrame:
    """The least due time of each key over branches that are each limited to their first rows."""
    cut = [b.select(key, F.col(due).alias("due")).orderBy("due", key).limit(limit) for b, due in branches]
    return reduce(DataFrame.unionByName, cut).groupBy(key).agg(F.min("due").alias("due"))


def conflict_free(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with one distinct value, which is kept; min and max tell it, so no set is gathered."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__hi")).where(F.col(value) == F.col("__hi")).drop("__hi")


def shares(df: DataFrame, key: str) -> DataFrame:
    """Count and share of each key; the total is one row."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("__total"))
    return counted.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.try_divide("n", "__total"), 6)).drop("__total")


def classifier_metrics(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """True and false positives, false negatives, precision and recall (null on a zero denominator)."""
    n = df.agg(F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(actual & ~predicted).alias("fn"))
    return n.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def change_only(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows to write: new keys, and keys of which some column differs, null-safely."""
    before = old.select(F.col(key).alias("__key"), F.struct(*columns).alias("__was"))
    same = F.col("__was").isNotNull() & F.struct(*columns).eqNullSafe(F.col("__was"))
    return new.join(before, F.col(key) == F.col("__key"), "left").where(~same).withColumn("change", F.when(F.col("__key").isNull(), "insert").otherwise("update")).drop("__key", "__was")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The base with changed rows replaced and new ones added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes.select(*base.columns))


def insert_if_absent(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Claims: the rows whose key the base doesn't have yet, one for each key (the least row)."""
    rest = [c for c in rows.columns if c != key]
    fresh = rows.join(base.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*rest)).alias("__row"))
    return fresh.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])
