"""Dispatch, queues, exports, audits and source metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.functions import scores, text
from larkspur.operators import relational
from larkspur.session import table


@query("export_bundle", """SELECT o_custkey, '{"customer":' || o_custkey::VARCHAR || ',"orders":[' || string_agg('{"key":' || o_orderkey::VARCHAR || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS bundle FROM orders GROUP BY 1""")
def export_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """All that belongs to a customer, as one document."""
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    return g.select("o_custkey", F.to_json(F.struct(F.col("o_custkey").alias("customer"), "orders")).alias("bundle"))


@query("dispatch_batches", "WITH r AS (SELECT o_orderpriority, o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 25 AS batch FROM orders WHERE o_orderstatus = 'P') SELECT o_orderpriority, batch, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM r GROUP BY 1, 2")
def dispatch_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Due work of each group in batches of at most 25 ids."""
    due = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    placed = relational.numbered(due, ["o_orderpriority"], "o_orderkey").withColumn("batch", F.floor((F.col("place") - 1) / 25))
    g = placed.groupBy("o_orderpriority", "batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return g.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query(
    "source_metrics",
    """SELECT source, count(*) AS raw, count(l.doc_id) AS labelled, round(count(l.doc_id) / count(*), 6) AS coverage, round(coalesce(sum(toxic) / nullif(count(l.doc_id), 0), 0), 6) AS failure_rate,
    array_to_string(list_filter([CASE WHEN count(l.doc_id) / count(*) < 0.35 THEN 'coverage' END, CASE WHEN coalesce(sum(toxic) / nullif(count(l.doc_id), 0), 0) > 0.15 THEN 'failures' END], lambda x: x IS NOT NULL), ',') AS breaches FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def source_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage and failure rate of each source, and the thresholds that it breaks."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic")
    g = table(spark, sf, "documents").select("doc_id", "source").join(labels, F.col("doc_id") == F.col("id"), "left").groupBy("source").agg(F.count("*").alias("raw"), F.count("id").alias("labelled"), F.sum("toxic").alias("bad"))
    cover, fail = F.col("labelled") / F.col("raw"), F.coalesce(F.try_divide("bad", "labelled"), F.lit(0.0))
    breaches = F.array_compact(F.array(F.when(cover < 0.35, "coverage"), F.when(fail > 0.15, "failures")))
    return g.select("source", "raw", "labelled", F.round(cover, 6).alias("coverage"), F.round(fail, 6).alias("failure_rate"), F.array_join(breaches, ",").alias("breaches"))


@query(
    "identity_audit",
    """WITH f AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT 'duplicates' AS fact, count(*) AS n FROM f WHERE n > 1 UNION ALL SELECT 'dangling', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
    UNION ALL SELECT 'unreferenced', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT 'families', count(DISTINCT l_orderkey) FROM lineitem""",
)
def identity_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicate, dangling and unreferenced identities, and the families there are."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    families = lines.groupBy("l_orderkey", "l_linenumber").count()
    fact = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fact"), "n")
    dangling = lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    unreferenced = orders.join(lines.select("l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return fact("duplicates", families.where("count > 1")).unionByName(fact("dangling", dangling)).unionByName(fact("unreferenced", unreferenced)).unionByName(fact("families", lines.select("l_orderkey").distinct()))


@query(
    "coverage_rollup",
    "SELECT o_custkey, arg_max(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS state, count(*) AS n FROM orders GROUP BY 1",
)
def coverage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's state of highest precedence."""
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", rank).alias("state"), F.count("*").alias("n"))


@query("inbox_range", "SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12' GROUP BY 1")
def inbox_range(spark: SparkSession, sf: str) -> DataFrame:
    """What is new since the last opening, up to this one."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return table(spark, sf, "events").where((F.col("ts") > at("2024-01-05")) & (F.col("ts") <= at("2024-01-12"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "evidence_match",
    """WITH p AS (SELECT p_partkey, p_brand, p_type, split_part(lower(p_name), ' ', 1) AS f, string_split(lower(p_name), ' ') AS w FROM part), s AS (SELECT a.p_partkey AS a, b.p_partkey AS b, 4 * (a.p_type = b.p_type)::INT + 3 * (a.f = b.f)::INT + 2 * (len(list_intersect(a.w, b.w)) >= 1)::INT AS score FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey)
    SELECT a, b, score, score >= 7 AS automatic FROM s WHERE score >= 7""",
)
def evidence_match(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a brand matched by weighted evidence. Only an equal type and an equal first word together reach the bar, so both are the block; that first word is one that both names have."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)).alias("first"))
    side = lambda s: p.select("p_brand", "p_type", "first", F.col("p_partkey").alias(s))
    met = side("a").join(side("b"), ["p_brand", "p_type", "first"]).where("a < b")
    score = scores.weighted((F.lit(True), 4), (F.lit(True), 3), (F.lit(True), 2))
    return met.select("a", "b", score.alias("score"), (score >= 7).alias("automatic"))


@query(
    "link_extraction",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html || ' see ' || url || '. ' || url, 'https?://[^\s<>"'')\]]+')) AS u FROM pages) SELECT page_id, count(DISTINCT regexp_replace(u, '[.,;:!?]+$', '')) AS links FROM l GROUP BY 1""",
)
def link_extraction(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat("html", F.lit(" see "), "url", F.lit(". "), "url")
    return table(spark, sf, "pages").select("page_id", F.size(text.links(body)).cast("long").alias("links"))


@query("queue_halves", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'O') SELECT o_custkey, o_orderkey, place FROM r WHERE place <= ceil(n / 2)")
def queue_halves(spark: SparkSession, sf: str) -> DataFrame:
    """The older half, rounded up, of each customer's open orders."""
    w = Window.partitionBy("o_custkey")
    q = table(spark, sf, "orders").where("o_orderstatus = 'O'").withColumn("place", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey"))).withColumn("n", F.count("*").over(w))
    return q.where(F.col("place") <= F.ceil(F.col("n") / 2)).select("o_custkey", "o_orderkey", "place")
