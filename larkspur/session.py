"""Session construction and table loading."""

from __future__ import annotations

import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, adaptive execution, skew handling.

    `master` is left to spark-submit unless given; keyword arguments with dots replaced by double
    underscores override any setting.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path may lie in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package's source, once for each application, so that Python functions can import it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="spark-larkspur-")) / "larkspur-package.zip"
    with zipfile.ZipFile(file, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(app)


def travels(*modules: str) -> None:
    """From now on code of these modules is sent by value: the driver's own workers for data sources and keyed streams don't see what `ship_package` adds."""
    for module in modules:
        cloudpickle.register_pickle_by_value(sys.modules[module])
