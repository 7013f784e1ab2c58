"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors get one more number, so that the largest inner product becomes the least distance, and are rotated
at random, so that any part of their columns tells of the whole. Lists around centroids are probed; in a
probed list the columns are read block by block, and a candidate is abandoned as soon as a hypothesis test
on its partial distance says that it can't be among the nearest. What is left is scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, hinted, materialize

TOP = 20
#: The index is fitted on about so many rows; every row is indexed. Lists, the share of them that is probed, and rounds of fitting.
SAMPLE, MOST_LISTS, PROBED, ROUNDS = 16_384, 512, 0.8, 10
#: Columns read at a time; standard errors of the test; candidates and queries that one task step holds.
COLUMNS, TEST, BLOCK, QUERIES = 16, 1.8, 8192, 256
#: Queries of one group, with which a part of a list is searched.
ASKED = 8192


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0) & F.exists(vector, lambda x: x != 0)


class Space:
    """The rotation, and the centroids and bounds that a sample gives; `longest` is the greatest length of all vectors."""

    def __init__(self, sample: np.ndarray, lists: int, longest: float):
        rng = np.random.default_rng(4)
        self.dim, self.longest = sample.shape[1], longest
        self.rotation = np.linalg.qr(rng.normal(size=(self.dim + 1, self.dim + 1)))[0].astype(np.float32)
        points = self.candidates(sample)
        self.centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)].astype(np.float64)
        for _ in range(ROUNDS):
            own = self.nearest(points, 1)[:, 0]
            for k in np.unique(own):
                self.centroids[k] = points[own == k].mean(0)
        self.sample = points

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Lifted by a last number that makes all as long as the longest, and rotated."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return (np.c_[x, rest].astype(np.float32)) @ self.rotation

    def queries(self, x: np.ndarray) -> np.ndarray:
        """Made as long as the longest, which changes no order, with a last number of 0, and rotated."""
        scaled = x * (self.longest / np.linalg.norm(x, axis=1, keepdims=True))
        return np.c_[scaled, np.zeros(len(x))].astype(np.float32) @ self.rotation

    def nearest(self, points: np.ndarray, n: int) -> np.ndarray:
        far = (self.centroids**2).sum(1) - 2 * points @ self.centroids.T
        return np.argsort(far, 1, kind="stable")[:, :n]

    def bounds(self, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query, a squared distance within which the sample alone has k vectors besides its own."""
        if len(self.sample) <= k:
            return np.full(len(queries), np.inf, np.float32)
        far = (queries**2).sum(1)[:, None] + (self.sample**2).sum(1) - 2 * queries @ self.sample.T
        return np.partition(far, k, 1)[:, k] * np.float32(1 + 1e-5) + np.float32(1e-5)

    def scan(self, queries: np.ndarray, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, candidate) numbers that survive all tests. A partial distance over d of D columns beyond bound * d/D * (1 + TEST/sqrt(d))^2 rejects."""
        full = queries.shape[1]
        partial = np.zeros((len(queries), len(points)), np.float32)
        alive = None
        for lo in range(0, full, COLUMNS):
            q, c = queries[:, lo : lo + COLUMNS], points[:, lo : lo + COLUMNS]
            d = min(full, lo + COLUMNS)
            limit = bound * (d / full) * (1 + TEST / np.sqrt(d)) ** 2 if d < full else bound
            if alive is None:
                partial += (q * q).sum(1)[:, None] + (c * c).sum(1) - 2 * q @ c.T
                ok = partial <= limit[:, None]
                if d == full or ok.mean() < 0.25:
                    alive = np.nonzero(ok)
                    sums = partial[alive]
            else:
                i, j = alive
                sums = sums + ((q[i] - c[j]) ** 2).sum(1)
                ok = sums <= limit[i]
                alive, sums = (i[ok], j[ok]), sums[ok]
        return alive


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _scanned(queries: DataFrame, held: DataFrame, parts: DataFrame, space: Broadcast, lists: slice, top: int) -> DataFrame:
    """The top + 1 best distinct vectors (qvid, vid, score) of each query (qvid, vec, bound) in those of its lists, nearest first.

    Only what lies within the query's bound, a squared distance, is looked for.
    """

    @F.pandas_udf("array<int>")
    def probes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vec in batches:
            yield pd.Series(list(space.value.nearest(space.value.queries(_matrix(vec)), lists.stop)[:, lists].astype("int32")))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            exact, ids = _matrix(right["vec"]), right["vid"].to_numpy()
            points = space.value.candidates(exact)
            for lo in range(0, len(left), QUERIES):
                part = left.iloc[lo : lo + QUERIES]
                q = _matrix(part["vec"])
                i, j = space.value.scan(space.value.queries(q), points, part["bound"].to_numpy().astype(np.float32))
                score = np.einsum("ij,ij->i", q[i], exact[j])
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) <= top
                out.append(pd.DataFrame({"qvid": part["qvid"].to_numpy()[i[keep]], "vid": ids[j[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"qvid": pd.Series(dtype="int64"), "vid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    asked = queries.select("qvid", "vec", "bound", F.explode(probes("vec")).alias("list"))
    # Queries are dealt into blocks too, so that neither side of a group grows with the data.
    blocks = max(1, -(-queries.count() // ASKED))
    dealt = F.pmod(F.xxhash64("qvid"), F.lit(blocks)).cast("int").alias("block")
    asked = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), dealt, "qvid", "vec", "bound")
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    near = asked.groupBy("list", "part", "block").cogroup(held.groupBy("list", "part", "block")).applyInPandas(scan, "qvid long, vid long, score double")
    return _best(near, top)


def _best(near: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("qvid").orderBy(F.desc("score"), "vid")
    return near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")


def search(rows: DataFrame, every: int = 20, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For every row whose id is divisible by `every`, its `top` nearest others by inner product: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller id; fewer where there are fewer candidates. Rows without an id and
    vectors that are null, zero, or hold null or non-finite components take no part; nor do those whose
    length isn't the commonest one of the sample. Equal vectors are searched and indexed once, whatever their
    number, and only their smallest ids can be results. A repeated row counts once. Other columns are not read.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    raw = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    distinct = materialize(raw.groupBy("vec").agg(F.min("id").alias("vid"), F.max("id").alias("last")), "vectors")
    total = distinct.count()
    bits = 20
    share = min(1 << bits, int(SAMPLE * 1.1 * (1 << bits) / max(1, total)) + 1)
    sample = distinct.where(F.pmod(F.xxhash64("vid"), F.lit(1 << bits)) < share).select("vid", "vec").toPandas().sort_values("vid", kind="stable")
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sample["vec"].map(len).mode()[0])
    sample = sample[sample["vec"].map(len) == dim]
    lists = min(MOST_LISTS, max(1, round(total**0.5 / 4)))
    longest = distinct.where(F.size("vec") == dim).agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)))).first()[0]
    space = spark.sparkContext.broadcast(Space(_matrix(sample["vec"]), lists, longest))
    lists = len(space.value.centroids)
    raw, distinct = raw.where(F.size("vec") == dim), distinct.where(F.size("vec") == dim)

    # Which ids have equal vectors; `top` ids and the query's own are all that a result can need of them.
    repeated = materialize(distinct.where("vid < last").select("vec", "vid"), "repeated")
    copies = raw.join(hinted(repeated), "vec").select("vid", "id").distinct()
    first = copies.withColumn("n", F.row_number().over(Window.partitionBy("vid").orderBy("id"))).where(F.col("n") <= top + 1).select("vid", "id")
    first = materialize(first, "copies")
    asked = raw.where(F.col("id") % every == 0).join(hinted(repeated), "vec", "left")
    asked = materialize(asked.select(F.col("id").alias("query_id"), F.coalesce("vid", "id").alias("qvid"), "vec").distinct(), "queries")

    @F.pandas_udf("int")
    def own_list(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vec in batches:
            yield pd.Series(space.value.nearest(space.value.candidates(_matrix(vec)), 1)[:, 0].astype("int32"))

    indexed = materialize(distinct.select("vid", "vec", own_list("vec").alias("list")), "index")
    # A list of any size is dealt out in parts of about BLOCK vectors.
    parts = F.broadcast(indexed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))  # at most MOST_LISTS rows
    held = indexed.join(parts, "list").select("list", F.pmod(F.xxhash64("vid"), "parts").cast("int").alias("part"), "vid", "vec")

    @F.pandas_udf("double")
    def bounds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vec in batches:
            yield pd.Series(space.value.bounds(space.value.queries(_matrix(vec)), 3 * top).astype(float))

    # The sample bounds the search in a query's nearest list; what is found there bounds the others.
    queries = materialize(asked.groupBy("qvid").agg(F.any_value("vec").alias("vec")).withColumn("bound", bounds("vec")), "bounds")
    probed = math.ceil(PROBED * lists)
    near = materialize(_scanned(queries, held, parts, space, slice(0, 1), top), "near")
    least = near.groupBy("qvid").agg(F.count("*").alias("c"), F.min("score").alias("floor")).where(F.col("c") > top).select("qvid", "floor")
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x))
    within = (2 * longest**2 - 2 * longest / size * F.col("floor")) * (1 + 1e-4) + 1e-5
    closer = materialize(queries.join(least, "qvid", "left").select("qvid", "vec", F.least("bound", within).alias("bound")), "bounds")
    if probed > 1:
        near = materialize(_best(near.unionByName(_scanned(closer, held, parts, space, slice(1, probed), top)), top), "near")
    # Whoever found too few in the probed lists searches all of them, with no bound.
    enough = near.groupBy("qvid").count().where(F.col("count") >= min(top + 1, total)).select("qvid")
    short = materialize(queries.join(enough, "qvid", "left_anti").select("qvid", "vec", F.lit(float("inf")).alias("bound")), "short")
    near = near.join(short, "qvid", "left_anti").unionByName(_scanned(short, held, parts, space, slice(0, lists), top))
    full = near.join(hinted(first), "vid", "left").select("qvid", F.coalesce("id", "vid").alias("vec_id"), "score")
    met = asked.select("query_id", "qvid").join(full, "qvid").where("query_id <> vec_id").select("query_id", "vec_id", "score").distinct()
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
