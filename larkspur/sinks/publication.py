"""A published table: pages staged under names of their own, read back, and only then pointed to.

A publication writes the rows that are new or changed, and a manifest of all keys with each row's digest and
the page set that holds it. Readers follow the one file `current`; it is replaced by a rename once everything
it names was read back, so they see a whole version or the one before, wherever a publisher stops. What a
version leaves behind goes later, so that readers that began with it can end. Several publishers at once
need a lock outside: of two that overlap, the last rename wins.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a page file; page sets that a version may be made of before it is written anew; milliseconds until what is superseded goes.
PAGE_ROWS, LIVE_SETS, DELAY_MS = 50_000, 8, 120_000


class Unverified(RuntimeError):
    """What was read back isn't what was to be written."""


@dataclass(frozen=True)
class Published:
    """What a publication did: published, unchanged, repaired or stale, the version, and how many rows were written and retired."""

    outcome: str
    version: str
    written: int = 0
    retired: int = 0


def digest(columns: list[str]) -> Column:
    """A row's content as SHA-256 of its JSON, fields by name, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def version_of(manifest: DataFrame) -> str:
    """20 characters for a set of (key, digest), whatever its order: sums of two hashes, added up before the shuffle."""
    wide = [F.sum(F.xxhash64(F.lit(seed), "key", "digest").cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return manifest.agg(F.substring(F.sha2(F.concat_ws("|", F.count("*"), *wide).cast("binary"), 256), 1, 20)).first()[0]


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def pointer(spark: SparkSession, root: str) -> dict | None:
    """What `current` says, or None before the first publication."""
    fs, p = _path(spark, f"{root}/current")
    return json.loads(spark.read.text(p.toString(), wholetext=True).first()[0]) if fs.exists(p) else None


def activate(spark: SparkSession, root: str, state: dict) -> None:
    """Replace `current` at once: written beside it, then renamed over it."""
    fs, beside = _path(spark, f"{root}/.current-{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, _path(spark, f"{root}/current")[1], options)


def _manifest(spark: SparkSession, root: str, state: dict) -> DataFrame:
    return spark.read.parquet(f"{root}/manifests/{state['token']}")


def _rows(spark: SparkSession, root: str, key: str, state: dict) -> DataFrame:
    """All rows of a version: those of its page sets that its manifest names, with `__pages` and the manifest's `__digest`."""
    sets = [spark.read.parquet(f"{root}/pages/{t}").withColumn("__pages", F.lit(t)) for t in state["parts"]]
    named = _manifest(spark, root, state).select(F.col("key").alias(key), F.col("pages").alias("__pages"), F.col("digest").alias("__digest"))
    return reduce(DataFrame.unionByName, sets).join(named, [key, "__pages"])


def current(spark: SparkSession, root: str, key: str) -> DataFrame | None:
    """The published rows, one whole version; None before the first one and while a damaged version waits for its repair."""
    state = pointer(spark, root)
    if state is None or state.get("hidden"):
        return None
    rows = _rows(spark, root, key, state)
    return rows.select(*[c for c in rows.columns if not c.startswith("__")])


def page_after(spark: SparkSession, root: str, key: str, after: Any, limit: int) -> DataFrame | None:
    """The next `limit` published rows by key; the bound on the key reaches the scan, and page files are sorted by it."""
    rows = current(spark, root, key)
    return rows if rows is None else (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def stage_pages(rows: DataFrame, root: str, token: str, key: str, page_rows: int) -> None:
    """Rows in files of page_rows, ordered by key; nobody reads them before they are pointed to."""
    rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.option("maxRecordsPerFile", page_rows).parquet(f"{root}/pages/{token}")


def verify(spark: SparkSession, root: str, key: str, state: dict, sets: list[str]) -> None:
    """Read back the rows that a manifest expects in these page sets and compare digests; raise Unverified if a row is lost, doubled or altered."""
    expected = _manifest(spark, root, state).where(F.col("pages").isin(sets)).count()
    rows = _rows(spark, root, key, state).where(F.col("__pages").isin(sets))
    same = digest([c for c in rows.columns if not c.startswith("__")]) == F.col("__digest")
    found, intact = rows.agg(F.count("*"), F.count_if(same)).first()
    if found != expected or intact != expected:
        raise Unverified(f"of {expected} rows {found} were read back, {intact} of them as written")


def _intact(spark: SparkSession, root: str, key: str, state: dict) -> bool:
    """Whether every row of a version can be read as its manifest says; lost files count as damage."""
    try:
        verify(spark, root, key, state, state["parts"])
    except Exception:  # whatever a store raises for lost or broken files
        return False
    return True


def publish(rows: DataFrame, root: str, key: str, at: int, page_rows: int = PAGE_ROWS, live_sets: int = LIVE_SETS) -> Published:
    """Publish a table whose rows have a unique, non-null key. `at` is the time of its making, in milliseconds.

    Only new and changed rows are written; those that are gone leave the manifest. A version older than the
    published one is stale and changes nothing. One with equal content is read back whole and stays; if it is
    damaged it is hidden from readers, written anew and shown again. Doubled or null keys raise ValueError, and
    rows that read back differently Unverified (a table that isn't the same when it is computed twice, too);
    readers then still have the version before. An empty table is a version without rows. Rows come back with
    their columns; names beginning with `__` are used inside.
    """
    spark = rows.sparkSession
    was = pointer(spark, root)
    if was and was["at"] > at:
        return Published("stale", was["version"])
    token = f"{at:015d}-{uuid.uuid4().hex[:12]}"
    state = {"token": token, "at": at, "superseded": [*was["superseded"], {"token": was["token"], "parts": was["parts"], "at": at}] if was else []}
    columns = rows.columns
    wanted = rows.select(F.col(key).alias("key"), digest(columns).alias("digest"))
    fresh = not was or bool(was.get("hidden")) or len(was["parts"]) >= live_sets
    try:
        if fresh:
            manifest = wanted.withColumn("pages", F.lit(token))
        else:
            stored = _manifest(spark, root, was).select(F.col("key").alias("__key"), F.col("digest").alias("__digest"), F.col("pages").alias("__pages"))
            kept = F.when(F.col("digest") == F.col("__digest"), F.col("__pages"))
            manifest = wanted.join(stored, F.col("key") == F.col("__key"), "left").select("key", "digest", F.coalesce(kept, F.lit(token)).alias("pages"))
        manifest.write.parquet(f"{root}/manifests/{token}")
        made = spark.read.parquet(f"{root}/manifests/{token}")
        if made.where("key is null").limit(1).count() or made.groupBy("key").count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is null or repeats")
        state["version"], outcome = version_of(made), "published"
        if was and not was.get("hidden") and state["version"] == was["version"]:
            if _intact(spark, root, key, was):
                activate(spark, root, was | {"at": at})
                _delete(spark, f"{root}/manifests/{token}")
                return Published("unchanged", was["version"])
            activate(spark, root, was | {"at": at, "hidden": True})
            _delete(spark, f"{root}/manifests/{token}")
            return Published("repaired", *_tuple(publish(rows, root, key, at, page_rows, live_sets)))
        mine = made.where(F.col("pages") == token).select(F.col("key").alias(key))
        stage_pages(rows.join(mine, key, "left_semi"), root, token, key, page_rows)
        state["parts"] = sorted({r[0] for r in made.select("pages").distinct().collect()} | {token})  # live_sets + 1 at most
        verify(spark, root, key, state, [token])
        written = made.where(F.col("pages") == token).count()
        gone = 0 if not was else _manifest(spark, root, was).join(made.select("key"), "key", "left_anti").count()
    except BaseException:
        _delete(spark, f"{root}/manifests/{token}")
        _delete(spark, f"{root}/pages/{token}")
        raise
    # From here on a failure may already have shown the version: nothing is deleted, `retire` clears what isn't named.
    activate(spark, root, state)
    return Published(outcome, state["version"], written, gone)


def _tuple(p: Published) -> tuple[str, int, int]:
    return p.version, p.written, p.retired


def retire(spark: SparkSession, root: str, at: int, delay: int = DELAY_MS) -> list[str]:
    """Delete manifests and page sets that the current version doesn't name and that were superseded, or staged and never shown, `delay` before `at`."""
    state = pointer(spark, root)
    if state is None:
        return []
    recent = [s for s in state["superseded"] if s["at"] > at - delay]
    needed = {state["token"], *state["parts"], *(t for s in recent for t in (s["token"], *s["parts"]))}
    gone = []
    for kind in ("manifests", "pages"):
        fs, p = _path(spark, f"{root}/{kind}")
        for found in fs.listStatus(p) if fs.exists(p) else []:
            token = found.getPath().getName()
            if token not in needed and int(token.partition("-")[0]) <= at - delay:
                fs.delete(found.getPath(), True)
                gone.append(f"{kind}/{token}")
    activate(spark, root, state | {"superseded": recent})
    return sorted(gone)
