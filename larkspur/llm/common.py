"""What the operators share: the folder all executors see, written tables, broadcasts by size, and Python batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_folder: dict[str, str] = {}
_resident: dict[str, Any] = {}

#: Bytes of a table's values that may be broadcast, once they were added up.
BROADCAST_BYTES = 24 << 20
#: Bytes and rows of one Arrow batch, so that whole, very long texts fit into a worker's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": (("10000",), "500"), "spark.sql.execution.arrow.maxBytesPerBatch": (("67108864", "67108864b", "268435456b", "2147483647b", "2147483647"), str(4 << 20))}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where that is unset and the master is this machine (tests) a temporary folder is made and used for
    checkpoints too; on a cluster, where executors would not see it, this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-larkspur-")
        spark.sparkContext.setCheckpointDir(_own_folder[app])
    return _own_folder[app]


def run_folder(spark: SparkSession) -> str:
    """Where this application's tables lie; `sweep` deletes it."""
    return f"{shared_folder(spark)}/larkspur/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the run's folder that nothing has used yet."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession, path: str | None = None) -> None:
    """Delete what this application has written to the shared folder (or one path of it), archives of failed tasks among it.

    Results read those tables until they are written elsewhere, so whoever consumed them calls this.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path or run_folder(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """The bytes of one value, before any compression."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value).cast("long"), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.greatest(F.size(value), F.lit(0)).cast("long"), F.lit(0)) * 16 + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def byte_size(df: DataFrame) -> int:
    """Bytes that a written table's rows take in memory, added up over all of them."""
    return df.agg(F.sum(sum((_bytes(F.col(f.name), f.dataType) for f in df.schema.fields), F.lit(24)))).first()[0] or 0


def hinted(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its bytes were added up and are few; else left to a shuffled join."""
    return F.broadcast(df) if byte_size(df) <= most else df


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, for whole and very long texts, where the session still has Spark's own defaults."""
    for key, (default, bound) in BATCH.items():
        if spark.conf.get(key) in default:
            spark.conf.set(key, bound)


def resident(key: str, make: Callable[[], Any]) -> Any:
    """The one large model that a Python worker keeps from task to task; asking for another lets the former go."""
    if key not in _resident:
        _resident.clear()
        gc.collect()
        _resident[key] = make()
    return _resident[key]


def text_or_empty(name: str = "text") -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_digest(name: str = "text") -> list[Column]:
    """128 bits that stand for a text, null as a text of its own: t1 and t2."""
    return [F.xxhash64(name).alias("t1"), F.xxhash64(F.lit(7), name).alias("t2")]


def ids_shared(digested: DataFrame) -> bool:
    """Whether some doc_id, null among them, stands for several texts. Columns doc_id, t1 and t2 are read."""
    return digested.groupBy("doc_id").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.min("t2").alias("c"), F.max("t2").alias("d")).where("a <> b or c <> d").limit(1).count() > 0
