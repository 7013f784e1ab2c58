"""Grouping into cards, bounded chunks, packing, and ranking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELEASE, CHUNK, LEAST_TAIL = 4, 20, 4


def stable_id(*parts: Column | str) -> Column:
    """A 20-character id: the digest's URL-safe base64."""
    digest = F.base64(F.unhex(F.sha2(F.concat_ws("\u001f", *parts), 256)))
    return F.substring(F.translate(digest, "+/", "-_"), 1, 20)


def release_cards(roles: DataFrame, keys: list[str], least: int = RELEASE) -> DataFrame:
    """Mark rows of keys with at least `least` rows as parts of one release; the others stand alone."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return roles.withColumn("n", n).withColumn("card", F.when(F.col("n") >= least, "release").otherwise("individual"))


def chunk_number(place: Column, n: Column, size: int = CHUNK, least: int = LEAST_TAIL) -> Column:
    """The chunk of the place-th (from 1) of n rows: chunks of `size`, the last one topped up to `least` from the one before."""
    k = F.ceil(n / size).cast("long")
    rest = n - size * (k - 1)
    lent = F.when(k > 1, F.greatest(F.lit(0), least - rest)).otherwise(0)
    return F.when(place - 1 >= size * (k - 1) - lent, k - 1).otherwise(F.floor((place - 1) / size)).cast("long")


def bounded_chunks(df: DataFrame, keys: list[str], order: list[str], size: int = CHUNK, least: int = LEAST_TAIL) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w)).withColumn("chunk", chunk_number(F.col("place"), F.col("n"), size, least))


def first_distinct(pos: Column, value: Column, limit: int) -> Column:
    """The first `limit` distinct values by position, as an aggregate; keep the values of a group few."""
    return F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), value.alias("v")))), lambda s: s["v"])), 1, limit)


def program_groups(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """Groups by an explicit key; rows without one are groups of their own."""
    return df.withColumn("group_key", F.coalesce(key, F.concat(F.lit("single:"), F.col(row_id).cast("string"))))


def pack(df: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Number the packs of rows, in order, that are filled up to `most` one after the other, within each key.

    What a pack holds depends on all packs before it, so a key's rows go to one task in order; they stream
    through it in batches, and only the fill of the current pack is kept.
    """
    placed = df.repartition(key).sortWithinPartitions(key, order)
    schema = f"{placed.select(key).schema[0].simpleString().replace(':', ' ')}, {placed.select(order).schema[0].simpleString().replace(':', ' ')}, pack long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, fill, number = None, 0, 0
        for pdf in batches:
            out = []
            for k, s in zip(pdf[key], pdf[size], strict=True):
                if k != last:
                    last, fill, number = k, 0, 0
                elif fill + s > most:
                    fill, number = 0, number + 1
                fill += s
                out.append(number)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "pack": out})

    return placed.select(key, order, size).mapInPandas(run, schema)


def best_per_parent(df: DataFrame, parent: str, score: Column, tie: str, per_parent: int, limit: int) -> DataFrame:
    """The best rows of each parent, and of those the best overall."""
    ranked = df.withColumn("score", score)
    inner = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(parent).orderBy(F.desc("score"), tie))).where(F.col("__n") <= per_parent)
    return inner.drop("__n").orderBy(F.desc("score"), tie).limit(limit)


def publish(desired: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """What an incremental publish does: write new and changed cards, retire those gone; unchanged ones cost nothing."""
    was = stored.select(F.col(key).alias("__key"), F.col(digest).alias("__digest"))
    both = desired.join(was, F.col(key) == F.col("__key"), "full_outer")
    action = F.when(F.col("__key").isNull(), "write").when(F.col(key).isNull(), "retire").when(F.col(digest) != F.col("__digest"), "write").otherwise("keep")
    return both.select(F.coalesce(key, "__key").alias(key), action.alias("action"))
