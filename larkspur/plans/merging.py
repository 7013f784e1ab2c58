"""Merges of what several sources say about one posting: roles, fields, occurrences, identities, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task sorts, if keys are many: 50 to 85 MB of four columns. Up to so many tasks, rows go straight to a file for each
#: (spark.shuffle.sort.bypassMergeThreshold); beyond, a split's rows are held in memory first, so tasks take up to MOST_ROWS before there are more.
TASK_ROWS, STREAMED_TASKS, MOST_ROWS = 500_000, 200, 5_000_000


def reconcile_catalog(stored: DataFrame, occurrences: DataFrame, key: str, field: str) -> DataFrame:
    """Create, merge or close each role from its source occurrences; a row per key of either side.

    Occurrences have key, seq, official, eligible, open, gone, flag and `field`; stored roles have key, was_open,
    was_flag and `field`. The latest eligible official value wins, then the stored one, then the first reported
    one. A role is open while any occurrence is, unless one says that it is gone; a closed role reopens only on
    an eligible official occurrence. Flags once set stay. One aggregate with partial sums, then one join.
    """
    wins = F.col("official") & F.col("eligible")
    said = occurrences.groupBy(key).agg(
        F.max_by(F.when(wins, F.col(field)), F.when(wins, F.col("seq"))).alias("__official"), F.min_by(field, "seq").alias("__first"), F.bool_or(wins).alias("__revive"),
        F.bool_or("open").alias("__any_open"), F.bool_or("gone").alias("__gone"), F.bool_or("flag").alias("__flag"), F.count("*").alias("references"),
    )
    both = stored.withColumn("__stored", F.lit(True)).withColumnRenamed(field, "__kept").join(said, key, "full")
    known = F.col("__stored").isNotNull()
    may_open = ~known | F.coalesce("was_open", F.lit(False)) | F.coalesce("__revive", F.lit(False))
    is_open = F.coalesce(F.col("__any_open") & ~F.col("__gone") & may_open, F.lit(False))
    value = F.coalesce("__official", "__kept", "__first")
    flag = F.coalesce("__flag", F.lit(False)) | F.coalesce("was_flag", F.lit(False))
    changed = ~value.eqNullSafe(F.col("__kept")) | (flag != F.coalesce("was_flag", F.lit(False))) | (is_open != F.coalesce("was_open", F.lit(False)))
    action = F.when(~known, "create").when(F.col("was_open") & ~is_open, "close").when(changed, "merge").otherwise("unchanged")
    return both.select(key, action.alias("action"), value.alias(field), is_open.alias("open"), flag.alias("flag"), F.coalesce("references", F.lit(0)).alias("references"))


def latest_slots(evidence: DataFrame, slot: list[str], seq: str, fields: list[str]) -> DataFrame:
    """The last write of each evidence slot."""
    return evidence.groupBy(*slot).agg(F.max_by(F.struct(*fields), seq).alias("__e")).select(*slot, *[F.col(f"__e.{f}").alias(f) for f in fields])


def reconcile_fields(evidence: DataFrame, stored: DataFrame, key: str, priority: str, fields: list[str]) -> DataFrame:
    """A row per key and field that any evidence has: the value of the best (least) priority, or the stored one and a conflict.

    Fields are text. Where the best priority has several values the stored value stays and all of them are named.
    """
    long = evidence.unpivot([key, priority], fields, "field", "value").where("value is not null")
    per = long.groupBy(key, "field", priority).agg(F.array_sort(F.collect_set("value")).alias("__v"))
    best = per.groupBy(key, "field").agg(F.min_by("__v", priority).alias("__v"))
    kept = stored.unpivot([key], fields, "field", "__kept")
    conflict = F.size("__v") > 1
    joined = best.join(kept, [key, "field"], "left")
    return joined.select(key, "field", F.when(conflict, F.col("__kept")).otherwise(F.col("__v")[0]).alias("value"), conflict.alias("conflict"), F.when(conflict, F.array_join("__v", "|")).alias("candidates"))


def merge_occurrences(rows: DataFrame, slot: list[str], attached: str, seq: Column, admission: str, url: str, exact: str) -> DataFrame:
    """One occurrence of each slot: attached at the earliest, the latest admission, all addresses in order, exact if any is."""
    g = rows.groupBy(*slot).agg(F.min(attached).alias("attached"), F.max_by(admission, seq).alias("admission"), F.array_sort(F.collect_set(url)).alias("urls"), F.bool_or(exact).alias("exact"))
    return g.withColumn("urls", F.array_join(F.col("urls").cast("array<string>"), ","))


def select_assessment(rows: DataFrame, key: str, at: str, outcome: str, informative: Column) -> DataFrame:
    """The outcome of each key's latest observations, informative ones if there are any; unknown where they disagree."""
    ranked = rows.withColumn("__r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("__r = 1")
    pick = lambda agg: F.coalesce(agg(F.when(informative, F.col(outcome))), agg(outcome))
    g = ranked.groupBy(key).agg(pick(F.min).alias("__lo"), pick(F.max).alias("__hi"))
    return g.select(key, F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise("unknown").alias("outcome"), (F.col("__lo") != F.col("__hi")).alias("conflict"))


def decide_identity(refs: DataFrame, key: str, scope: str, posting: str, fresh: str, confirmed_before: str) -> DataFrame:
    """confirmed, unconfirmed or quarantined: scopes or ids that disagree fail closed; without fresh evidence a former confirmation stands."""
    now = F.col(fresh)
    g = refs.groupBy(key).agg(
        F.count_distinct(F.when(now, F.col(scope))).alias("scopes"), F.count_distinct(F.when(now, F.col(posting))).alias("ids"), F.bool_or(confirmed_before).alias("__before")
    )
    status = F.when((F.col("scopes") > 1) | (F.col("ids") > 1), "quarantined").when((F.col("scopes") == 1) & (F.col("ids") == 1), "confirmed").when(F.col("__before"), "confirmed").otherwise("unconfirmed")
    return g.select(key, status.alias("status"), "scopes", "ids")


def sorting_tasks(df: DataFrame) -> int:
    """Tasks to deal a table's rows out to, so that each sorts few of them and those that write to it hold none."""
    rows = df.count()
    return max(df.sparkSession.sparkContext.defaultParallelism, min(STREAMED_TASKS, -(-rows // TASK_ROWS)), -(-rows // MOST_ROWS))


def promote_labels(snapshots: DataFrame, key: list[str], seq: str, label: str, last: int = 3) -> DataFrame:
    """Each key's label if its last snapshots agree on exactly one, else the mapping is superseded.

    Rows are counted and dealt out by key and snapshot (`sorting_tasks`), where each snapshot becomes its least
    and greatest label; then those of a key meet. So no task sorts a whole split of the input or what small shuffled
    partitions are coalesced to, and a key with very many rows arrives as its distinct snapshots.
    """
    tasks = sorting_tasks(snapshots)
    each = snapshots.repartition(tasks, *key, seq).groupBy(*key, seq).agg(F.min(label).alias("__lo"), F.max(label).alias("__hi"))
    latest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(seq)))
    voting = each.repartition(tasks, *key).withColumn("__r", latest).where(F.col("__r") <= last)
    g = voting.groupBy(*key).agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.count(seq).alias("snapshots"))
    one = F.col("__lo") == F.col("__hi")
    return g.select(*key, F.when(one, "promoted").otherwise("superseded").alias("decision"), F.when(one, F.col("__lo")).alias("label"), "snapshots")


def personalized_releases(matching: DataFrame, release: list[str], cohort: list[str], role: str, least: int = 4) -> DataFrame:
    """Roles that matched, as releases: a whole release of `least` roles or more, else one for each cohort."""
    many = F.count("*").over(Window.partitionBy(*release)) >= least
    keyed = matching.withColumn("cohort", F.when(many, F.lit("*")).otherwise(F.concat_ws("|", *cohort)))
    g = keyed.groupBy(*release, "cohort").agg(F.count("*").alias("roles"), F.min(role).alias("first_role"))
    kind = F.when(F.col("cohort") == "*", "employer-release").when(F.col("roles") == 1, "individual").otherwise("program-group")
    return g.select(*release, "cohort", kind.alias("presentation"), "roles", "first_role")


def rotating_scopes(scopes: DataFrame, scope: str, sequence: int, limit: int) -> DataFrame:
    """The `limit` scopes of one turn: scopes in order, each turn begins where the last ended and wraps around.

    The distinct scopes are numbered in two steps: counts of ordered partitions first, then numbers within them.
    """
    distinct = scopes.select(scope).distinct()
    ordered = distinct.withColumn("__b", F.substring(F.md5(F.col(scope).cast("string")), 1, 2))
    sizes = ordered.groupBy("__b").agg(F.count("*").alias("__n"))  # at most 256 buckets
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy(F.md5(F.col(scope).cast("string")))) - 1
    numbered = ordered.join(F.broadcast(sizes), "__b").withColumn("place", place)
    start = F.lit((max(1, sequence) - 1) * limit) % F.col("__all")
    return numbered.where((F.col("__all") <= limit) | (F.pmod(F.col("place") - start, F.col("__all")) < limit)).select(scope, "place")
