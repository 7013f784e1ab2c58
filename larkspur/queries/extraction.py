"""Ids, destinations, digests and searches of what was extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.functions import extract, time
from larkspur.session import table


@query(
    "posting_ids",
    """SELECT o_orderkey, left(sha256('posting-v1:' || CASE WHEN o_orderkey % 4 <> 0 THEN 'provider:' || o_orderstatus || ':' || CASE WHEN o_custkey % 3 = 0 THEN '-' ELSE o_custkey::VARCHAR END || ':' || o_orderkey::VARCHAR ELSE 'url:https://jobs.test/' || o_orderkey::VARCHAR END), 32) AS id FROM orders""",
)
def posting_ids(spark: SparkSession, sf: str) -> DataFrame:
    provider = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).otherwise("unknown")
    tenant = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string"))
    number = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", extract.stable_id(provider, tenant, number, F.concat(F.lit("https://jobs.test/"), number)).alias("id"))


@query(
    "destination_classes",
    """WITH e AS (SELECT l_orderkey, l_linenumber, ['live', 'live', 'blocked', 'unreachable', 'implied', 'gone'][CAST(l_orderkey % 6 AS INT) + 1] AS reach, CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN 'aggregate-board' WHEN 1 THEN 'browser-required' END AS rule,
      CAST(l_suppkey % 3 AS INT) AS postings, CAST(l_quantity AS INT) % 12 AS links, l_tax > 0.06 AS id_present, l_returnflag = 'R' AS form, l_linenumber % 4 = 0 AS truncated, l_discount > 0.04 AS matches, l_suppkey % 7 = 0 AS generic, l_partkey % 11 = 0 AS on_route, l_linestatus = 'O' AS visible FROM lineitem),
    f AS (SELECT *, NOT truncated AND postings = 1 AS single FROM e), g AS (SELECT *, id_present OR single OR form AS exact FROM f),
    c AS (SELECT CASE WHEN reach = 'gone' THEN 'gone' WHEN coalesce(rule, '') = 'aggregate-board' OR generic OR postings > 1 THEN 'aggregate-board'
      WHEN (links >= 8 AND NOT (single AND matches)) OR (links > 1 AND NOT exact) THEN CASE WHEN truncated AND postings = 1 AND matches THEN 'unresolved' ELSE 'aggregate-board' END
      WHEN reach = 'unreachable' THEN 'unresolved' WHEN on_route AND coalesce(rule, '') <> 'browser-required' THEN CASE WHEN form THEN 'application-form' ELSE 'posting-detail' END WHEN reach = 'blocked' THEN 'blocked-uninspectable'
      WHEN (coalesce(rule, '') = 'browser-required' AND NOT visible) OR reach <> 'live' THEN 'unresolved' WHEN CASE WHEN visible THEN matches AND exact ELSE exact OR matches END THEN CASE WHEN form THEN 'application-form' ELSE 'posting-detail' END ELSE 'unresolved' END AS class, reach FROM g)
    SELECT class, reach, count(*) AS n FROM c GROUP BY ALL""",
)
def destination_classes(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    reach = F.element_at(F.array(*[F.lit(v) for v in ("live", "live", "blocked", "unreachable", "implied", "gone")]), (c("l_orderkey") % 6).cast("int") + 1)
    rule = F.when(c("l_partkey") % 5 == 0, "aggregate-board").when(c("l_partkey") % 5 == 1, "browser-required")
    said = F.struct(
        reach.alias("reachability"), F.lit(None).cast("boolean").alias("evidence_gone"), rule.alias("rule"), (c("l_suppkey") % 3).alias("postings"), (c("l_quantity").cast("int") % 12).alias("links"), (c("l_tax") > 0.06).alias("id_present"),
        (c("l_returnflag") == "R").alias("form"), (c("l_linenumber") % 4 == 0).alias("truncated"), (c("l_discount") > 0.04).alias("role_matches"), (c("l_suppkey") % 7 == 0).alias("generic"), (c("l_partkey") % 11 == 0).alias("on_route"), (c("l_linestatus") == "O").alias("visible"),
    )
    return table(spark, sf, "lineitem").select(extract.destination_class(said).alias("class"), reach.alias("reach")).groupBy("class", "reach").agg(F.count("*").alias("n"))


@query(
    "daily_digest",
    """WITH l AS (SELECT event_id, date_trunc('second', ts) AS ts, timezone('America/New_York', timezone('UTC', date_trunc('second', ts))) AS t FROM events)
    SELECT event_id, epoch(timezone('UTC', timezone('America/New_York', (t::DATE + CASE WHEN hour(t) * 60 + minute(t) >= 540 THEN 1 ELSE 0 END)::TIMESTAMP + INTERVAL 9 HOUR + to_seconds(second(t)))))::BIGINT AS next_at FROM l""",
)
def daily_digest(spark: SparkSession, sf: str) -> DataFrame:
    at = time.next_daily(F.date_trunc("second", F.col("ts")), "America/New_York", 540)
    return table(spark, sf, "events").select("event_id", F.unix_timestamp(at).alias("next_at"))


@query(
    "substring_search",
    """WITH p AS (SELECT p_partkey, p_name, [p_type, p_brand, p_size::VARCHAR || '% off_'] AS places FROM part) SELECT p_partkey, contains(lower(p_name), 'widget') AS by_name, contains(lower(array_to_string(places, ' ')), 'brand#1') AS by_place FROM p WHERE contains(lower(p_name), 'widget') OR contains(lower(array_to_string(places, ' ')), '5% off_')""",
)
def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    """Signs that LIKE treats as wildcards are searched as they stand."""
    part = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower(F.concat_ws(" ", "p_type", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("% off_")))).alias("places"))
    found = part.where(F.col("name").contains("widget") | F.col("places").contains("5% off_"))
    return found.select("p_partkey", F.col("name").contains("widget").alias("by_name"), F.col("places").contains("brand#1").alias("by_place"))
