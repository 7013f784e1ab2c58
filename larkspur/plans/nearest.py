"""Exact nearest vectors by cosine, in pairs of a block of queries and a block of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a block, and of the piece of a block's pair that is multiplied at once.
ROWS_OF_BLOCK, QUERIES_OF_BLOCK, ROWS_AT_ONCE, QUERIES_AT_ONCE = 50_000, 16_384, 4096, 1024


def _units(vectors: pd.Series) -> np.ndarray:
    """Vectors at length one, in doubles; those that are null or zero hold no number."""
    width = next((len(v) for v in vectors if v is not None), 1)
    x = np.array([np.full(width, np.nan) if v is None else v for v in vectors], dtype=np.float64).reshape(len(vectors), width)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best of a block of rows. Rows go in order of vec_id, so that one of an equal score never replaces an earlier one."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids, r, asked, q = rows["vec_id"].to_numpy(), _units(rows["e"]), queries["query_id"].to_numpy(), _units(queries["e"])
    found = []
    for at in range(0, len(asked), QUERIES_AT_ONCE):
        some, u = asked[at : at + QUERIES_AT_ONCE], q[at : at + QUERIES_AT_ONCE]
        score, best = np.full((len(some), k), -1.0), np.zeros((len(some), k), np.int64)
        for start in range(0, len(ids), ROWS_AT_ONCE):
            these = ids[start : start + ROWS_AT_ONCE]
            s = u @ r[start : start + ROWS_AT_ONCE].T
            s[np.isnan(s)] = 1.0
            s = np.floor(np.clip(s, 0.0, 1.0) * 1e6 + 0.5) / 1e6
            s[some[:, None] == these[None, :]] = -1.0
            for i in np.nonzero(s.max(axis=1) > score[:, -1])[0]:
                fresh = np.nonzero(s[i] > score[i, -1])[0]
                both, them = np.concatenate([score[i], s[i, fresh]]), np.concatenate([best[i], these[fresh]])
                top = np.argsort(-both, kind="stable")[:k]
                score[i], best[i] = both[top], them[top]
        held = score >= 0
        found.append(pd.DataFrame({"query_id": np.repeat(some, held.sum(axis=1)), "vec_id": best[held], "score": score[held]}))
    return pd.concat(found)


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score and place of each query's k nearest rows other than itself.

    Queries have query_id and e, rows vec_id and e. The score is the cosine, cut to 0 and 1, to six places; ties go to
    the lesser vec_id. Vectors without a length score 1. Every pair of blocks is a group of its own, and only its
    queries' k best leave it.
    """
    blocks, query_blocks = -(-rows.count() // ROWS_OF_BLOCK) or 1, -(-queries.count() // QUERIES_OF_BLOCK) or 1
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", "e", dealt("query_id", query_blocks).alias("query_block"), every(blocks).alias("block"))
    there = rows.select("vec_id", "e", dealt("vec_id", blocks).alias("block"), every(query_blocks).alias("query_block"))
    met = asked.groupBy("block", "query_block").cogroup(there.groupBy("block", "query_block"))
    best = met.applyInPandas(lambda q, r: _best(q, r, k) if len(q) and len(r) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}), "query_id long, vec_id long, score double")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k)
