"""Published tables: two versions after each other, read back through the pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.session import table
from larkspur.sinks import publication
from larkspur.storage import scratch


@query(
    "paged_publication",
    """WITH a AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
    b AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)
    SELECT b.o_custkey, b.n AS n_orders, b.latest, a.n IS NULL OR a.n <> b.n OR a.latest <> b.latest AS fresh FROM b LEFT JOIN a USING (o_custkey)""",
)
def paged_publication(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as cards, published before and after two years of orders and a segment's leave; which cards the second publication wrote."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    cards = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_orderdate").alias("latest"))
    root = scratch(spark, "publication")
    publication.publish(cards(orders.where("o_orderdate < timestamp'1999-01-01'")), root, "o_custkey", 1_000, page_rows=1_000)
    before = publication.pointer(spark, root)
    publication.publish(cards(orders.join(customers.where("c_mktsegment <> 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")), root, "o_custkey", 2_000, page_rows=1_000)
    publication.retire(spark, root, 200_000)
    now = publication.pointer(spark, root)
    rows = publication.current(spark, root, "o_custkey")
    wrote = spark.read.parquet(f"{root}/manifests/{now['token']}").select(F.col("key").alias("o_custkey"), (F.col("pages") != before["token"]).alias("fresh"))
    return rows.join(wrote, "o_custkey").select("o_custkey", "n_orders", "latest", "fresh")
