"""List documents written from tables and read through the data source, twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.session import table
from larkspur.storage import scratch
from larkspur.sources import lists
from larkspur.streaming import flows


def _written(rows: DataFrame, path: str) -> None:
    """A document for each nation: a heading, a table's head, and a line for each customer."""
    line = F.concat_ws(" | ", F.concat(F.lit("| "), F.when(F.col("c_custkey") % 3 == 0, F.lit("↳")).otherwise(F.concat(F.lit("**"), F.col("c_name"), F.lit("**")))), F.col("c_mktsegment"), F.concat(F.lit("Town "), F.col("c_custkey").cast("string")), F.concat(F.lit("[Apply](https://jobs.test/"), F.col("c_custkey").cast("string"), F.lit(") |")))
    head = rows.select("c_nationkey").distinct().withColumn("said", F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("n"), F.lit("| Company | Role | Location | Apply |").alias("value")), F.struct(F.lit(-1).cast("long").alias("n"), F.lit("| --- | --- | --- | --- |").alias("value")))))
    lines = rows.select("c_nationkey", F.col("c_custkey").alias("n"), line.alias("value")).unionByName(head.select("c_nationkey", "said.n", "said.value"))
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "n").select("c_nationkey", "value").write.partitionBy("c_nationkey").mode("append").text(path)


@query(
    "list_source",
    """WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_name, 1 AS run FROM customer WHERE c_nationkey < 20 UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment, c_name, 2 FROM customer WHERE c_nationkey >= 20)
    SELECT run, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 2 AS line, last_value(CASE WHEN c_custkey % 3 <> 0 THEN c_name END IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS company,
    c_mktsegment AS title, 'Town ' || c_custkey AS location, 'https://jobs.test/' || c_custkey AS url FROM c""",
)
def list_source(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty nations' lists are read as a stream; then the others come, and the second run reads those only."""
    lists.register(spark)
    folder, out, checkpoint = scratch(spark, "lists"), scratch(spark, "listings"), scratch(spark, "checkpoint")
    customers = table(spark, sf, "customer")
    for run, part in ((1, customers.where("c_nationkey < 20")), (2, customers.where("c_nationkey >= 20"))):
        _written(part, folder)
        flows.drain(spark.readStream.format("list_documents").option("suffix", ".txt").load(folder).withColumn("run", F.lit(run)), out, checkpoint)
    nation = F.regexp_extract("document", r"c_nationkey=(\d+)", 1).cast("int").alias("c_nationkey")
    return spark.read.parquet(out).select("run", nation, F.col("line").cast("long").alias("line"), "company", "title", "location", "url")
