"""Duplicate jobs made one: members by shared claims, and what they carry moved to the job that stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.storage import written

# How far an application has come, and how sure a delivery is; the greater one stays.
APPLICATIONS = {"saved": 0, "applied": 1, "assessment": 2, "interview": 3, "rejected": 4, "withdrawn": 4, "offer": 5}
RECEIPTS = {"delivered": 5, "accepted": 4, "unknown": 4, "pending": 4, "definitive-failure": 3, "retryable": 2}


def rank(status: Column, ranks: dict[str, int], other: int) -> Column:
    """A status's place among `ranks`; `other` for any that isn't there, null among them."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), status), F.lit(other))


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every id in the edges (a, b).

    Each round sends every id to its least neighbour, follows those pointers down to an id that has no lesser
    neighbour, and puts that one in the edges' place. What is left links such ids only, at most half as many every
    other round, so the work of all rounds together is a few times that of the first. Every step is a written table.
    """
    ordered = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    links, rounds = written(edges.where("a <> b").select(*ordered("a", "b")).distinct(), "links"), []
    while not links.isEmpty():
        ends = _ends(written(links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")), "pointers"))
        rounds.append(ends)
        of_a, of_b = (ends.select(F.col("id").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        met = links.join(of_a, "a").join(of_b, "b", "left").select("to_a", F.coalesce("to_b", "b").alias("to_b")).where("to_a <> to_b")
        links = written(met.select(*ordered("to_a", "to_b")).distinct(), "links")
    if not rounds:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    found = rounds.pop().withColumnRenamed("to", "component")
    for ends in reversed(rounds):
        later = found.select(F.col("id").alias("to"), "component")
        found = written(ends.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component")).union(found), "labels")
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())


def _ends(pointers: DataFrame) -> DataFrame:
    """id and `to`, where the chain of its pointers ends; they lead to lesser ids, so it does. Each round doubles the way; ids that are through aren't looked up again."""
    through, moving, all_of = [], pointers, pointers
    while True:
        further = all_of.select(F.col("id").alias("to"), F.col("to").alias("further"))
        step = written(moving.join(further, "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "pointers")
        through, moving = [*through, step.where("not moved").select("id", "to")], step.where("moved").select("id", "to")
        all_of = moving
        for done in through:
            all_of = all_of.union(done)
        if moving.isEmpty():
            return all_of


def members(jobs: DataFrame, claims: DataFrame, job: str, claim: str, first: list[Column], known: bool = False) -> DataFrame:
    """job and canonical of every job: those that share a claim, also through others, have one canonical job, the least by `first`, then by id.

    A claim links its jobs to its least one, so no pairs are made of a claim that many share. Null claims link
    nothing; claims of jobs that aren't there don't count (`known` says that there are none). Every job's canonical
    one is there and its own: one hop.
    """
    held = claims.where(F.col(claim).isNotNull()).select(job, claim)
    held = held if known else held.join(jobs.select(job), job, "left_semi")
    hubs = held.groupBy(claim).agg(F.min(job).alias("b"), F.max(job).alias("last")).where("b <> last").drop("last")
    edges = held.join(hubs, claim).where(F.col(job) != F.col("b"))
    found = components(edges.select(F.col(job).alias("a"), "b"))
    order = F.struct(*first, F.col(job)).alias("order")
    placed = written(jobs.select(job, order).join(found.select(F.col("id").alias(job), "component"), job, "left"), "placed")
    shared = placed.where(F.col("component").isNotNull())
    stays = shared.groupBy("component").agg(F.min_by(job, "order").alias("canonical"))
    alone = placed.where(F.col("component").isNull()).select(job, F.col(job).alias("canonical"))
    return shared.join(stays, "component").select(job, "canonical").union(alone)


def merge_jobs(jobs: DataFrame, placed: DataFrame, job: str) -> DataFrame:
    """One row per canonical job.

    The jobs have open, flag, first_seen, last_seen, pay, sent_at and pending. Open and flag hold if they do for any
    member, seen times are the earliest and latest, pay is the best, sent_at the latest; a message is pending only
    if one is and none was sent.
    """
    rows = jobs.join(placed, job)
    made = rows.groupBy("canonical").agg(
        F.count("*").alias("members"), F.bool_or("open").alias("open"), F.bool_or(F.coalesce("flag", F.lit(False))).alias("flag"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max("pay").alias("pay"), F.max("sent_at").alias("sent_at"), F.bool_or("pending").alias("pending"),
    )
    return made.withColumn("pending", F.col("pending") & F.col("sent_at").isNull())


def moved(rows: DataFrame, placed: DataFrame, job: str, owner: str, strength: Column, latest: list[Column]) -> DataFrame:
    """Rows of old jobs under the canonical one: of several of one owner the strongest stays, then the latest. Rows of unknown jobs stay as they are."""
    under = rows.join(placed.select(F.col(job).alias("__old"), "canonical"), F.col(job) == F.col("__old"), "left").withColumn("canonical", F.coalesce("canonical", F.col(job))).drop("__old")
    best = Window.partitionBy(owner, "canonical").orderBy(strength.desc(), *[c.desc() for c in latest])
    return under.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", job).withColumnRenamed("canonical", job)


def alias_rows(placed: DataFrame, job: str) -> DataFrame:
    """old and canonical of every job that is merged into another."""
    return placed.where(F.col(job) != F.col("canonical")).select(F.col(job).alias("old"), "canonical")
