"""Board snapshots: typed reads of provider JSON, brought to one posting shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GREENHOUSE = "jobs array<struct<id:bigint,title:string,absolute_url:string,updated_at:string,location:struct<name:string>,content:string>>, meta struct<total:bigint>, _corrupt string"
LEVER = "id string, text string, applyUrl string, hostedUrl string, createdAt bigint, workplaceType string, categories struct<location:string,team:string,commitment:string,allLocations:array<string>>, salaryRange struct<currency:string,interval:string,min:double,max:double>, _corrupt string"
ASHBY = "jobs array<struct<id:string,title:string,location:string,isListed:boolean,isRemote:boolean,publishedAt:string,jobUrl:string,applyUrl:string,secondaryLocations:array<struct<location:string>>>>, _corrupt string"
POSTING = ("source_id", "external_id", "title", "locations", "apply_url", "provider_time", "semantics")


def _read(spark: SparkSession, path: str, schema: str, multiline: bool) -> DataFrame:
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multiline).json(path)


def _instant(text: Column) -> Column:
    """A timestamp from a text that has a full date; else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(text))


def _within(jobs: Column, most: int) -> Column:
    """The jobs as they are, or a failure where they are more than a board may hold, so that none goes unseen."""
    return F.when(F.size(jobs) > most, F.raise_error(F.lit(f"a board holds more than {most} jobs"))).otherwise(jobs)


def greenhouse(spark: SparkSession, path: str, source_id: str, most: int = 5000) -> DataFrame:
    """Postings of Greenhouse boards; one of more than `most` jobs fails the read. Updated times keep their meaning: they are never creation times."""
    j = _read(spark, path, GREENHOUSE, True).select(F.explode(_within(F.col("jobs"), most)).alias("j"))
    return j.select(F.lit(source_id).alias("source_id"), F.col("j.id").cast("string").alias("external_id"), F.col("j.title").alias("title"), F.array_compact(F.array("j.location.name")).alias("locations"), F.col("j.absolute_url").alias("apply_url"), _instant(F.col("j.updated_at")).alias("provider_time"), F.lit("updated").alias("semantics"))


def lever(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Postings of Lever boards, one JSON object a line."""
    d = _read(spark, path, LEVER, False).where("_corrupt is null")
    places = F.when(F.size("categories.allLocations") > 0, F.col("categories.allLocations")).otherwise(F.array_compact(F.array("categories.location")))
    return d.select(F.lit(source_id).alias("source_id"), F.col("id").alias("external_id"), F.col("text").alias("title"), places.alias("locations"), F.coalesce("applyUrl", "hostedUrl").alias("apply_url"), F.timestamp_millis("createdAt").alias("provider_time"), F.lit("published").alias("semantics"))


def ashby(spark: SparkSession, path: str, source_id: str, most: int = 1000) -> DataFrame:
    """Listed postings of Ashby boards; one of more than `most` jobs fails the read."""
    j = _read(spark, path, ASHBY, True).select(F.explode(_within(F.col("jobs"), most)).alias("j")).where("j.isListed")
    places = F.array_distinct(F.array_compact(F.concat(F.array("j.location"), F.coalesce(F.transform("j.secondaryLocations", lambda s: s["location"]), F.array().cast("array<string>")))))
    return j.select(F.lit(source_id).alias("source_id"), F.col("j.id").alias("external_id"), F.col("j.title").alias("title"), places.alias("locations"), F.coalesce("j.applyUrl", "j.jobUrl").alias("apply_url"), _instant(F.col("j.publishedAt")).alias("provider_time"), F.lit("published").alias("semantics"))


def job_postings(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """JSON-LD job postings in pages: script bodies as variants, whose arrays and graphs are walked one level deep."""
    bodies = pages.select(page_id, F.explode(F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))).alias("body"))
    v = bodies.select(page_id, F.try_parse_json("body").alias("v")).where("v is not null")
    roots = v.select(page_id, F.explode(F.expr("coalesce(try_variant_get(v, '$[\\'@graph\\']', 'array<variant>'), try_variant_get(v, '$', 'array<variant>'), array(v))")).alias("n"))
    get = lambda path: F.try_variant_get("n", path, "string")
    return roots.where(get("$['@type']") == "JobPosting").select(page_id, get("$.title").alias("title"), get("$.hiringOrganization.name").alias("employer"), get("$.datePosted").alias("date_posted"), get("$.url").alias("url"))


def sitemap(files: DataFrame, text: str) -> DataFrame:
    """Locations of a URL set."""
    return files.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")).select(F.replace("url", F.lit("&amp;"), F.lit("&")).alias("url"))


def within_cap(files: DataFrame, body: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Bodies within a byte cap, and those beyond it."""
    size = F.octet_length(body)
    return files.where(size <= most), files.where(size > most)


def write_snapshot(rows: DataFrame, root: str, source_id: str, snapshot_hash: str) -> bool:
    """Write a content-addressed snapshot; one that is there already is reused. Whether anything was written."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/source_id={source_id}/snapshot_hash={snapshot_hash}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        return False
    rows.write.mode("overwrite").parquet(path.toString())
    return True
