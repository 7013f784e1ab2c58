"""Selections with parents, site decisions, delivery claims, title repair, contents without clocks, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Weights of kinds of evidence, the bonus where both providers agree, and the bounds of a decision.
URL, STRUCTURED, PROVIDER, METADATA, REVIEWED_BOARD, OFFICIAL_HOST = 0.45, 0.35, 0.30, 0.15, 0.35, 0.40
PROVIDERS_AGREE, RESOLVE, RESOLVE_REVIEWED, MARGIN, REVIEW = 0.25, 0.85, 0.6, 0.15, 0.55
_PLACES = 6


def closed_selection(ranked: DataFrame, group: str, item: str, parent: str, rank: str, most: int) -> DataFrame:
    """Of each group, items in order of `rank` (from 1, unique), each with its parent, as long as at most `most` are selected.

    An item enters with the first of itself and its children. What no longer fits is passed over; where one place is
    left, the first later item takes it that needs no other. Columns group and item are returned. `parent` is null or
    another item of the group; parents have no parents of their own.
    """
    by_child = ranked.where(F.col(parent).isNotNull()).groupBy(group, F.col(parent).alias(item)).agg(F.min(rank).alias("__child"))
    entering = ranked.join(by_child, [group, item], "left").withColumn("__entry", F.least(rank, F.coalesce("__child", rank)))
    upto = Window.partitionBy(group).orderBy("__entry").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = entering.withColumn("__count", F.count("*").over(upto))
    taken = counted.where(F.col("__count") <= most).select(group, item, "__count")
    short = taken.groupBy(group).agg(F.max("__count").alias("__full"))
    rest = counted.where(F.col("__count") > most).join(short, group, "left").where(F.coalesce("__full", F.lit(0)) == most - 1)
    # Left alone is what has no parent, or a parent that was taken already.
    has = taken.select(group, F.col(item).alias(parent), F.lit(True).alias("__has"))
    alone = rest.join(has, [group, parent], "left").where(F.col(parent).isNull() | F.col("__has"))
    last = alone.groupBy(group).agg(F.min_by(item, rank).alias(item))
    return taken.select(group, item).unionByName(last)


def site_score(signals: Column, agree: Column) -> Column:
    """The score of a site from the kinds of evidence for it, at most 1."""
    has = lambda *names: F.arrays_overlap(signals, F.array(*[F.lit(n) for n in names]))
    part = lambda condition, weight: F.when(condition, weight).otherwise(0.0)
    total = (
        part(has("reviewed-domain"), 1.0)
        + part(has("final-url", "redirect-host"), URL)
        + part(has("official-application-host"), OFFICIAL_HOST)
        + part(has("jsonld-url", "jsonld-name", "platform-website"), STRUCTURED)
        + part(has("logo-dev"), PROVIDER)
        + part(has("brandfetch"), PROVIDER)
        + part(has("logo-dev") & has("brandfetch") & agree, PROVIDERS_AGREE)
        + part(has("page-title", "opengraph", "ats-tenant", "platform-name"), METADATA)
        + part(has("reviewed-ats-domain"), REVIEWED_BOARD)
    )
    return F.least(F.round(total, _PLACES), F.lit(1.0))


def site_decision(candidates: DataFrame, key: str, site: str, signals: str, order: str) -> DataFrame:
    """One row per key: outcome (resolved, review, unresolved), site and score of the choice, and the runner-up's score.

    Candidates have one row per key and site, without those that are ruled out. Best score first, then `order`. What a reviewer
    or the employer itself declares wins; else the best needs its bound and a margin over the next, and no rival of a reviewed board.
    """
    has = lambda *names: F.arrays_overlap(signals, F.array(*[F.lit(n) for n in names]))
    scored = candidates.where(F.size(signals) > 0).withColumn("__score", site_score(F.col(signals), F.lit(True)))
    declared = F.when(has("reviewed-domain"), 2).when(has("platform-website", "jsonld-url"), 1).otherwise(0)
    scored = scored.withColumn("__declared", declared).withColumn("__board", has("reviewed-ats-domain")).withColumn("__sources", F.size(F.array_distinct(signals)))
    scored = scored.withColumn("__reviewed", F.col("__board") & has("logo-dev", "brandfetch"))
    place = F.struct(-F.col("__score"), F.col(order))
    one = F.struct(F.col(site).alias("site"), F.col("__score").alias("score"), F.col("__reviewed").alias("reviewed"), F.col("__sources").alias("sources"), F.col("__board").alias("board"))
    # Two of a kind are enough: the best, and the next where the best is left out.
    summed = scored.groupBy(key).agg(
        F.min_by(one, place).alias("best"), F.min_by(one, F.when(F.col("__declared") > 0, F.struct(-F.col("__declared"), -F.col("__score"), F.col(order)))).alias("said"),
        F.max("__declared").alias("declared"), F.sum(F.col("__board").cast("int")).alias("boards"),
    )
    chosen = summed.withColumn("choice", F.when(F.col("declared") > 0, F.col("said")).otherwise(F.col("best")))
    others = scored.join(chosen.select(key, F.col("choice.site").alias("__chosen")), key).where(F.col(site) != F.col("__chosen")).groupBy(key).agg(F.max("__score").alias("runner_up"))
    c = lambda name: F.col(f"choice.{name}")
    joined = chosen.join(others, key, "left").withColumn("margin", F.round(F.coalesce(c("score") - F.col("runner_up"), F.lit(1.0)), _PLACES))
    rival = F.col("boards") > F.when(c("board"), 1).otherwise(0)
    clear = (c("score") >= F.when(c("reviewed"), RESOLVE_REVIEWED).otherwise(RESOLVE)) & (F.col("margin") >= MARGIN) & ~rival
    close = F.col("runner_up").isNotNull() & (F.col("margin") < MARGIN)
    outcome = F.when((F.col("declared") > 0) | clear, "resolved").when((c("score") >= REVIEW) | close | (c("sources") >= 2), "review").otherwise("unresolved")
    return joined.select(key, outcome.alias("outcome"), c("site").alias("site"), c("score").alias("score"), "runner_up")


def delivery_claims(events: DataFrame, claim: str, order: str, state: str) -> DataFrame:
    """One row per claim: the state after its events, how many of them were taken and how many were not allowed.

    A claim starts as claimed; accepted leads on to delivered, definitive-failure and unknown lead nowhere. At most two
    events are ever taken, so two aggregates say it and a claim's events are never gathered.
    """
    first = F.col(state).isin("accepted", "definitive-failure", "unknown")
    one = events.groupBy(claim).agg(F.min_by(state, F.when(first, F.col(order))).alias("__state"), F.min(F.when(first, F.col(order))).alias("__at"), F.count("*").alias("__n"))
    second = F.col(state).isin("delivered", "definitive-failure", "unknown") & (F.col(order) > F.col("__at"))
    accepted = one.where("__state = 'accepted'").select(claim, "__at")
    two = events.join(accepted, claim).where(second).groupBy(claim).agg(F.min_by(state, order).alias("__then"))
    taken = F.col("__state").isNotNull().cast("int") + F.col("__then").isNotNull().cast("int")
    done = one.join(two, claim, "left")
    return done.select(claim, F.coalesce("__then", "__state", F.lit("claimed")).alias("state"), taken.alias("taken"), (F.col("__n") - taken).alias("refused"))


def repaired_titles(cut: DataFrame, known: DataFrame, company: str, title: str) -> DataFrame:
    """`cut` with `repaired`: for a title that ends in an ellipsis, the shortest known title of the company that goes on from it, else its readable part.

    Known titles meet by equality on their beginnings; only beginnings that some cut title has are looked up.
    """
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9+#/ ]+", " "), " +", " "))
    end = r"(?:\.{3}|…)\s*$"
    head = F.regexp_replace(F.trim(title), end, "")
    marked = cut.withColumn("__prefix", F.when(F.trim(title).rlike(end), plain(head)))
    wanted = marked.where("__prefix <> ''").select(company, "__prefix").distinct()
    names = known.select(company, F.col(title).alias("__known"), plain(F.col(title)).alias("__plain")).distinct()
    starts = names.withColumn("__n", F.explode(F.sequence(F.lit(1), F.greatest(F.char_length("__plain"), F.lit(1))))).withColumn("__prefix", F.left("__plain", F.col("__n")))
    best = starts.join(wanted, [company, "__prefix"], "left_semi").groupBy(company, "__prefix").agg(F.min_by("__known", F.struct(F.char_length("__known"), "__known")).alias("__known"))
    readable = F.trim(F.regexp_replace(F.trim(head), r"[\s(\[{,\-–—/]+\S*$", ""))
    fallback = F.when(readable != "", readable).otherwise(F.trim(head))
    repaired = F.when(F.coalesce(F.col("__prefix"), F.lit("")) == "", F.trim(title)).otherwise(F.coalesce("__known", fallback))
    return marked.join(best, [company, "__prefix"], "left").withColumn("repaired", repaired).drop("__prefix", "__known")


def without_fields(value: Column, kind: T.DataType, names: frozenset[str]) -> Column:
    """A value of that type without the fields named, at every depth of structs and arrays."""
    if isinstance(kind, T.StructType):
        kept = [without_fields(value[f.name], f.dataType, names).alias(f.name) for f in kind.fields if f.name not in names]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_fields(x, kind.elementType, names))
    return value


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values equally often, in any order; null is an empty array."""
    some = lambda x: F.array_sort(F.coalesce(x, F.slice(F.coalesce(a, b), 1, 0)))
    return F.coalesce(some(a) == some(b), F.lit(True))


def verified_selection(rows: DataFrame, key: str, wanted: DataFrame, content: list[str]) -> DataFrame:
    """The rows wanted, with the number of rows and an order-free digest of all of them, so that a reader can tell a broken snapshot."""
    part = F.conv(F.left(F.md5(F.concat_ws(",", *content)), F.lit(12)), 16, 10).cast("decimal(18,0)")
    whole = rows.agg(F.struct(F.count("*").alias("all_rows"), F.sum(part).cast("string").alias("all_digest")).alias("w")).scalar()
    chosen = rows.join(wanted.select(key).distinct(), key, "left_semi").withColumn("__w", whole)
    return chosen.withColumns({"all_rows": F.col("__w.all_rows"), "all_digest": F.col("__w.all_digest")}).drop("__w")


def first_destinations(rows: DataFrame, document: str, place: str, destination: str) -> DataFrame:
    """One row per document: raw_count of its rows, and kept, those whose destination no earlier row of any document has."""
    at = F.struct(document, place)
    firsts = rows.groupBy(destination).agg(F.min(at).alias("f")).groupBy(F.col(f"f.{document}").alias(document)).agg(F.count("*").alias("kept"))
    return rows.groupBy(document).agg(F.count("*").alias("raw_count")).join(firsts, document, "left").na.fill(0, ["kept"])
