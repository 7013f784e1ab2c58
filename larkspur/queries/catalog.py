"""Cards, chunks, ranking, publication and vectors over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.functions import scores
from larkspur.operators import relational
from larkspur.plans import grouping, nearest
from larkspur.session import table

PAY = [(0.0, 0.0), (50_000.0, 30.0), (150_000.0, 70.0), (300_000.0, 100.0)]


@query(
    "best_ranked_page",
    """WITH o AS (SELECT o_custkey, o_orderdate::DATE AS day, o_orderkey, c_acctbal, n_regionkey, CASE WHEN o_totalprice <= 0 THEN 0 WHEN o_totalprice <= 50000 THEN o_totalprice * 30 / 50000 WHEN o_totalprice <= 150000 THEN 30 + (o_totalprice - 50000) * 0.0004 WHEN o_totalprice <= 300000 THEN 70 + (o_totalprice - 150000) * 0.0002 ELSE 100 END AS pay
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus IN ('O', 'P')),
    s AS (SELECT *, floor((0.45 * pay + 0.30 * CASE WHEN c_acctbal > 0 THEN 80.0 ELSE 0.0 END + 0.25 * (n_regionkey * 20.0)) / CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.7 END * 10 + 0.5) / 10 AS score FROM o),
    g AS (SELECT o_custkey, max(score) AS score, count(*) AS n, max(day)::VARCHAR AS newest FROM s GROUP BY 1 HAVING count(*) >= 4)
    SELECT o_custkey, round(score, 1) AS score, n, newest, row_number() OVER (ORDER BY score DESC, o_custkey) AS place FROM g QUALIFY place BETWEEN 26 AND 50""",
)
def best_ranked_page(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders, scored on price, customer and region; the best order of each customer with four or more; the second page."""
    orders = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "n_regionkey")
    joined = orders.join(customer, F.col("c_custkey") == F.col("o_custkey"))
    score = scores.opportunity(scores.piecewise(F.col("o_totalprice"), PAY), F.when(F.col("c_acctbal") > 0, 80.0), F.col("n_regionkey") * 20.0)
    cards = joined.groupBy("o_custkey").agg(F.round(F.max(score), 1).alias("score"), F.count("*").alias("n"), F.max(F.to_date("o_orderdate")).cast("string").alias("newest")).where(F.col("n") >= grouping.RELEASE)
    return relational.page(cards, [F.desc("score"), F.asc("o_custkey")], 25, 25)


@query(
    "release_cards",
    """WITH d AS (SELECT user_id, ts::DATE AS day, event_type, event_id, count(*) OVER (PARTITION BY user_id, ts::DATE) AS n FROM events),
    g AS (SELECT user_id, day, CASE WHEN n >= 4 THEN 'release' ELSE 'individual' END AS card, CASE WHEN n >= 4 THEN 0 ELSE event_id END AS one, count(*) AS roles, min(event_id) AS first_id, list(event_type ORDER BY event_id) AS t FROM d GROUP BY ALL)
    SELECT user_id, day::VARCHAR AS day, card, roles, first_id, array_to_string(list_slice(list_transform(list_sort(list_distinct(list_transform(t, lambda x: row(list_position(t, x), x)))), lambda z: z[2]), 1, 3), ',') AS titles, replace(replace(left(to_base64(unhex(sha256(concat_ws(chr(31), user_id::VARCHAR, day::VARCHAR, first_id::VARCHAR)))), 20), '+', '-'), '/', '_') AS id FROM g""",
)
def release_cards(spark: SparkSession, sf: str) -> DataFrame:
    """A user's day with four events or more is one card, others are cards of their own; the first three types are its titles."""
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id")
    marked = grouping.release_cards(e, ["user_id", "day"])
    cards = marked.groupBy("user_id", "day", "card", F.when(F.col("card") == "release", 0).otherwise(F.col("event_id")).alias("one"))
    made = cards.agg(F.count("*").alias("roles"), F.min("event_id").alias("first_id"), grouping.first_distinct(F.col("event_id"), F.col("event_type"), 3).alias("t"))
    day = F.col("day").cast("string")
    return made.select("user_id", day.alias("day"), "card", "roles", "first_id", F.array_join("t", ",").alias("titles"), grouping.stable_id(F.col("user_id").cast("string"), day, F.col("first_id").cast("string")).alias("id"))


@query(
    "bounded_chunks",
    """WITH p AS (SELECT event_type, ts::DATE AS day, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type, ts::DATE) AS n FROM events), k AS (SELECT *, ceil(n / 20)::BIGINT AS k FROM p),
    d AS (SELECT *, CASE WHEN k > 1 THEN greatest(0, 4 - (n - 20 * (k - 1))) ELSE 0 END AS d FROM k) SELECT event_type, day::VARCHAR AS day, CASE WHEN rn - 1 >= 20 * (k - 1) - d THEN k - 1 ELSE (rn - 1) // 20 END AS chunk, count(*) AS size FROM d GROUP BY ALL""",
)
def bounded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return grouping.bounded_chunks(e, ["event_type", "day"], ["ts", "event_id"]).groupBy("event_type", F.col("day").cast("string").alias("day"), "chunk").agg(F.count("*").alias("size"))


@query(
    "program_groups",
    """SELECT coalesce(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN o_orderstatus || '|' || o_orderpriority || '|' || year(o_orderdate)::VARCHAR END, 'single:' || o_orderkey::VARCHAR) AS group_key, count(*) AS n, min(o_orderkey) AS first_order FROM orders GROUP BY 1""",
)
def program_groups(spark: SparkSession, sf: str) -> DataFrame:
    urgent = F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")
    key = F.when(urgent, F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("string")))
    return grouping.program_groups(table(spark, sf, "orders"), key, "o_orderkey").groupBy("group_key").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query(
    "incremental_publish",
    """WITH d AS (SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS g FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1), s AS (SELECT o_custkey, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS g FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1)
    SELECT coalesce(d.o_custkey, s.o_custkey) AS o_custkey, CASE WHEN s.o_custkey IS NULL THEN 'write' WHEN d.o_custkey IS NULL THEN 'retire' WHEN d.g <> s.g THEN 'write' ELSE 'keep' END AS action FROM d FULL JOIN s ON d.o_custkey = s.o_custkey""",
)
def incremental_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of a customer's orders, now against before, by digest."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    cards = lambda rows: rows.groupBy("o_custkey").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ","), 256).alias("digest"))
    return grouping.publish(cards(orders.where("o_orderkey % 11 <> 0")), cards(orders.where("o_orderkey % 7 <> 0")), "o_custkey", "digest")


@query(
    "parent_best_fill",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS tie, floor(l_extendedprice * (1 - l_discount) * 10 + 0.5) / 10 AS score FROM lineitem), p AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, tie) <= 2) SELECT l_orderkey, l_linenumber, score FROM p ORDER BY score DESC, tie LIMIT 80""",
)
def parent_best_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The best two lines of each order, and of those the best eighty."""
    lines = table(spark, sf, "lineitem").withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    best = grouping.best_per_parent(lines, "l_orderkey", scores.half_up(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "tie", 2, 80)
    return best.select("l_orderkey", "l_linenumber", "score")


@query("size_packing")
def size_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation packed, in order, into messages of at most 1,200 characters."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.char_length("text").alias("size"))
    return grouping.pack(turns, "conv_id", "turn", "size", 1200)


@query(
    "vector_topk",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(greatest(0, least(1, list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]))), 6) AS score FROM q JOIN embeddings ON vec_id <> query_id AND label <> 3)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s QUALIFY place <= 5""",
)
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Exact top five by cosine among allowed labels, for a stated set of query vectors against all rows."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("e"))
    return nearest.cosine_topk(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "e"), v.where("label <> 3").select("vec_id", "e"), 5)
