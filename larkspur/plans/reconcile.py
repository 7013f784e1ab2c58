"""Snapshot diffs, omissions, hashes, authority merges, identity and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def material_hash(*columns: str) -> Column:
    """SHA-256 over columns in a fixed order, null kept apart from empty."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def snapshot_hash(df: DataFrame, keys: list[str], row_id: str, row_hash: str, bucket: Column) -> DataFrame:
    """A digest of each group's rows that doesn't depend on their order.

    Rows are dealt by `bucket`, a function of their id, into buckets whose sorted rows are hashed, and then the
    buckets' digests are; with enough buckets a group of any size is never gathered in one row.
    """
    dealt = df.withColumn("__b", bucket)
    part = dealt.groupBy(*keys, "__b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col(row_id).cast("string"), row_hash))), "\n"), 256).alias("__d"), F.count("*").alias("__n"))
    return part.groupBy(*keys).agg(F.sum("__n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "__d"))), lambda s: s["__d"]), "\n"), 256).alias("snapshot_hash"))


def diff(current: DataFrame, ledger: DataFrame, key: str, version: int, now: Column, complete: bool = True) -> DataFrame:
    """Classify every key of a complete snapshot (key, material) against the ledger
    (key, material_hash, policy, state, omissions, retry_at).

    Precedence: new, stale-policy, reappeared, changed, retryable, unchanged; absent keys are omitted (first
    miss) or absent (second in a row). An incomplete snapshot says nothing: no rows.
    """
    if not complete:
        current, ledger = current.limit(0), ledger.limit(0)
    old = ledger.select(F.col(key).alias("__key"), "material_hash", "policy", "state", "omissions", "retry_at")
    both = current.select(F.col(key), "material").join(old, F.col(key) == F.col("__key"), "full_outer")
    misses = F.coalesce("omissions", F.lit(0)) + 1
    kind = (
        F.when(F.col("__key").isNull(), "new")
        .when(F.col(key).isNull() & (misses >= 2), "absent")
        .when(F.col(key).isNull(), "omitted")
        .when(F.col("policy") != version, "stale-policy")
        .when((F.col("state") == "absent") | (F.col("omissions") > 0), "reappeared")
        .when(F.col("material") != F.col("material_hash"), "changed")
        .when((F.col("state") == "retry") & (F.col("retry_at") <= now), "retryable")
        .otherwise("unchanged")
    )
    return both.select(F.coalesce(key, "__key").alias(key), kind.alias("kind"), F.when(F.col(key).isNull(), misses).otherwise(0).alias("omissions"))


def omission_streaks(presence: DataFrame, keys: list[str], seq: str, present: str, last: int) -> DataFrame:
    """Misses in a row at the last of numbered complete snapshots, and whether two make the key absent."""
    seen = presence.groupBy(*keys).agg(F.max(F.when(F.col(present), F.col(seq))).alias("__last"))
    streak = F.lit(last) - F.col("__last")
    return seen.where("__last is not null").select(*keys, streak.alias("streak"), (streak >= 2).alias("absent"))


def dedupe_rows(rows: DataFrame, key: str, material: str, payload: str) -> DataFrame:
    """One row per key: of equal material the bytewise least payload; different material is a conflict, which callers must refuse."""
    g = rows.groupBy(key).agg(F.min(payload).alias(payload), F.min(material).alias("__lo"), F.max(material).alias("__hi"), F.count("*").alias("copies"))
    return g.select(key, payload, "copies", (F.col("__lo") != F.col("__hi")).alias("conflict"))


def by_authority(evidence: DataFrame, key: str, priority: str, value: str) -> DataFrame:
    """Each key's value of the best (least) priority, or a conflict where that priority has several values.

    Two aggregates whose partial sums are one row per key and priority: nothing is gathered.
    """
    per = evidence.groupBy(key, priority).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    best = per.groupBy(key).agg(F.min_by(F.struct("lo", "hi", "n"), priority).alias("b"), F.min(priority).alias("priority"), F.sum("n").alias("evidence"))
    same = F.col("b.lo").eqNullSafe(F.col("b.hi"))
    return best.select(key, "priority", F.when(same, F.col("b.lo")).alias("value"), (~same).alias("conflict"), "evidence")


def suppressed_ranges(bands: DataFrame, keys: list[str], official: Column, low: str, high: str) -> DataFrame:
    """The hull of each group's bands; official bands, where there are any, silence all others."""
    has = bands.withColumn("__o", official)
    g = has.groupBy(*keys).agg(F.bool_or("__o").alias("official"), F.min(F.when(F.col("__o"), F.col(low))).alias("lo_o"), F.max(F.when(F.col("__o"), F.col(high))).alias("hi_o"), F.min(low).alias("lo"), F.max(high).alias("hi"))
    return g.select(*keys, "official", F.when(F.col("official"), F.col("lo_o")).otherwise(F.col("lo")).alias("low"), F.when(F.col("official"), F.col("hi_o")).otherwise(F.col("hi")).alias("high"))


def window_hull(windows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The hull of each key's windows, and a conflict where they have no common day."""
    g = windows.groupBy(key).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.max(start).alias("__s"), F.min(end).alias("__e"))
    return g.select(key, "start", "end", (F.col("__s") > F.col("__e")).alias("conflict"))


def resolve_aliases(aliases: DataFrame, claims: DataFrame, key: str, alias: str, canonical: str) -> DataFrame:
    """Each key's claims over its aliases: none creates, one merges, several quarantine it. One hop, never transitive."""
    found = aliases.select(key, F.col(alias).alias("__a")).distinct().join(claims.select(F.col(alias).alias("__c"), canonical).distinct(), F.col("__a") == F.col("__c"), "left")
    g = found.groupBy(key).agg(F.min(canonical).alias("lo"), F.max(canonical).alias("hi"))
    decision = F.when(F.col("lo").isNull(), "create").when(F.col("lo") == F.col("hi"), "merge").otherwise("quarantine")
    return g.select(key, decision.alias("decision"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias(canonical))


def roll_up(statuses: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The strongest status of each key, in the order given."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(status))
    return statuses.groupBy(key).agg(F.min_by(status, F.when(rank > 0, rank)).alias(status))


def canonical_reference(refs: DataFrame, key: str, order: list[Column], scope: str) -> DataFrame:
    """Each key's best reference, and whether its references disagree on `scope`."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = Window.partitionBy(key)
    ranked = refs.withColumn("__n", F.row_number().over(w)).withColumn("conflict", F.min(scope).over(whole) != F.max(scope).over(whole))
    return ranked.where("__n = 1").drop("__n")


def admission(df: DataFrame, reasons: Column, blocking: list[str], grace: Column) -> DataFrame:
    """Eligible without a blocking reason or within the grace period; alerts need both no reason at all and no grace."""
    block = F.array_intersect(reasons, F.array(*[F.lit(b) for b in blocking]))
    return df.select("*", reasons.alias("reasons"), ((F.size(block) == 0) | grace).alias("eligible"), (F.size(reasons) == 0).alias("alert"))


def merge_provenance(a: Column, b: Column, order: list[str]) -> Column:
    """The union of two source lists in order of authority; unknown sources come last, by name."""
    known = F.array(*[F.lit(o) for o in order])
    return F.transform(F.array_sort(F.transform(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda s: F.struct(F.coalesce(F.nullif(F.array_position(known, s), F.lit(0)), F.lit(10**6)).alias("o"), s.alias("s")))), lambda x: x["s"])


def overlay(published: DataFrame, live: DataFrame, card: str, roles: str, role: str) -> DataFrame:
    """Published cards, less those of which every role is live again; a card that live rows cover in part stays."""
    r = published.select(card, F.explode(roles).alias("__r"))
    covered = r.join(live.select(F.col(role).alias("__l")).distinct(), F.col("__r") == F.col("__l"), "left").groupBy(card).agg(F.bool_and(F.col("__l").isNotNull()).alias("__all"))
    return published.join(covered.where("__all"), card, "left_anti")
