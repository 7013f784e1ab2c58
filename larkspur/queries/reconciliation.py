"""Snapshot diffs and merges over the driver's tables: prior, current and changed rows are told by key arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.operators.filters import reasons
from larkspur.plans import reconcile
from larkspur.session import table


@query(
    "snapshot_diff",
    """WITH c AS (SELECT o_orderkey AS k, sha256(o_orderstatus || o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END) AS m FROM orders WHERE o_orderkey % 11 <> 0),
    l AS (SELECT o_orderkey AS k, sha256(o_orderstatus || o_orderpriority) AS h, CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 2 END AS policy, CASE WHEN o_orderkey % 17 = 0 THEN 'absent' WHEN o_orderkey % 19 = 0 THEN 'retry' ELSE 'done' END AS state, CASE WHEN o_orderkey % 22 = 0 THEN 1 ELSE 0 END AS o FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT coalesce(c.k, l.k) AS o_orderkey, CASE WHEN l.k IS NULL THEN 'new' WHEN c.k IS NULL AND l.o + 1 >= 2 THEN 'absent' WHEN c.k IS NULL THEN 'omitted' WHEN l.policy <> 2 THEN 'stale-policy' WHEN l.state = 'absent' OR l.o > 0 THEN 'reappeared' WHEN c.m <> l.h THEN 'changed' WHEN l.state = 'retry' THEN 'retryable' ELSE 'unchanged' END AS kind,
    CASE WHEN c.k IS NULL THEN l.o + 1 ELSE 0 END AS omissions FROM c FULL JOIN l ON c.k = l.k""",
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    base = F.concat("o_orderstatus", "o_orderpriority")
    current = orders.where("o_orderkey % 11 <> 0").select("o_orderkey", F.sha2(F.concat(base, F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("")), 256).alias("material"))
    state = F.when(F.col("o_orderkey") % 17 == 0, "absent").when(F.col("o_orderkey") % 19 == 0, "retry").otherwise("done")
    now = F.lit("2000-01-01").cast("timestamp")
    ledger = orders.where("o_orderkey % 7 <> 0").select(
        "o_orderkey", F.sha2(base, 256).alias("material_hash"), F.when(F.col("o_orderkey") % 13 == 0, 1).otherwise(2).alias("policy"), state.alias("state"),
        F.when(F.col("o_orderkey") % 22 == 0, 1).otherwise(0).alias("omissions"), now.alias("retry_at"),
    )
    return reconcile.diff(current, ledger, "o_orderkey", 2, now)


@query(
    "omission_streak",
    """WITH s AS (SELECT o_orderkey, unnest([1, 2, 3]) AS seq FROM orders), p AS (SELECT *, CASE seq WHEN 1 THEN true WHEN 2 THEN o_orderkey % 3 <> 0 ELSE o_orderkey % 4 <> 0 AND o_orderkey % 9 <> 0 END AS present FROM s)
    SELECT o_orderkey, 3 - max(seq) FILTER (WHERE present) AS streak, 3 - max(seq) FILTER (WHERE present) >= 2 AS absent FROM p GROUP BY 1""",
)
def omission_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Three complete snapshots; two misses in a row close a key."""
    s = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq"))
    k = F.col("o_orderkey")
    present = F.when(F.col("seq") == 1, True).when(F.col("seq") == 2, k % 3 != 0).otherwise((k % 4 != 0) & (k % 9 != 0))
    return reconcile.omission_streaks(s.withColumn("present", present), ["o_orderkey"], "seq", "present", 3)


@query("snapshot_dedupe", "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies, min(source) <> max(source) AS conflict FROM documents GROUP BY 1")
def snapshot_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.dedupe_rows(table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source"), "digest", "source", "doc_id")


@query(
    "snapshot_hash",
    """WITH r AS (SELECT o_orderstatus, o_orderkey, o_orderkey % 256 AS b, sha256(o_orderpriority) AS h FROM orders), p AS (SELECT o_orderstatus, b, count(*) AS n, sha256(string_agg(o_orderkey::VARCHAR || ':' || h, chr(10) ORDER BY o_orderkey::VARCHAR || ':' || h)) AS d FROM r GROUP BY 1, 2)
    SELECT o_orderstatus, sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS snapshot_hash FROM p GROUP BY 1""",
)
def snapshot_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.sha2("o_orderpriority", 256).alias("h"))
    return reconcile.snapshot_hash(rows, ["o_orderstatus"], "o_orderkey", "h", F.col("o_orderkey") % 256)


@query(
    "authority_merge",
    """WITH p AS (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS priority, min(l_tax) AS lo, max(l_tax) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2),
    b AS (SELECT l_partkey, min(priority) AS priority, arg_min(lo, priority) AS lo, arg_min(hi, priority) AS hi, sum(n)::BIGINT AS evidence FROM p GROUP BY 1) SELECT l_partkey, priority, CASE WHEN lo = hi THEN lo END AS value, lo <> hi AS conflict, evidence FROM b""",
)
def authority_merge(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    return reconcile.by_authority(table(spark, sf, "lineitem").withColumn("priority", rank), "l_partkey", "priority", "l_tax")


@query(
    "range_reconcile",
    """SELECT l_partkey, l_returnflag, bool_or(l_linestatus = 'F') AS official, coalesce(min(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), min(l_extendedprice)) AS low, coalesce(max(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), max(l_extendedprice)) AS high FROM lineitem GROUP BY 1, 2""",
)
def range_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.suppressed_ranges(table(spark, sf, "lineitem"), ["l_partkey", "l_returnflag"], F.col("l_linestatus") == "F", "l_extendedprice", "l_extendedprice")


@query(
    "window_hull",
    """SELECT o_custkey, min(o_orderdate)::DATE::VARCHAR AS start, max(o_orderdate + INTERVAL 200 DAY)::DATE::VARCHAR AS "end", max(o_orderdate) > min(o_orderdate + INTERVAL 200 DAY) AS conflict FROM orders GROUP BY 1""",
)
def window_hull(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "orders").withColumn("until", F.col("o_orderdate") + F.expr("interval 200 days"))
    day = lambda c: F.to_date(c).cast("string").alias(c)
    return reconcile.window_hull(w, "o_custkey", "o_orderdate", "until").select("o_custkey", day("start"), day("end"), "conflict")


@query(
    "alias_resolution",
    """WITH a AS (SELECT doc_id, unnest([sha256(text), source]) AS alias FROM documents), c AS (SELECT DISTINCT alias, doc_id // 100 AS canonical FROM (SELECT doc_id, sha256(text) AS alias FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id = 7)),
    g AS (SELECT a.doc_id, min(canonical) AS lo, max(canonical) AS hi FROM a LEFT JOIN c USING (alias) GROUP BY 1) SELECT doc_id, CASE WHEN lo IS NULL THEN 'create' WHEN lo = hi THEN 'merge' ELSE 'quarantine' END AS decision, CASE WHEN lo = hi THEN lo END AS canonical FROM g""",
)
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    aliases = docs.select("doc_id", F.explode(F.array("digest", "source")).alias("alias"))
    canonical = F.floor(F.col("doc_id") / 100).alias("canonical")
    claims = docs.where("doc_id % 3 = 0").select(F.col("digest").alias("alias"), canonical).unionByName(docs.where("doc_id = 7").select(F.col("source").alias("alias"), canonical))
    return reconcile.resolve_aliases(aliases, claims, "doc_id", "alias", "canonical")


@query(
    "identity_status",
    "SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'F') THEN 'confirmed' WHEN bool_or(l_returnflag <> 'N') THEN 'unconfirmed' END AS status FROM lineitem GROUP BY 1",
)
def identity_status(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "F", "confirmed").when(F.col("l_returnflag") != "N", "unconfirmed")
    return reconcile.roll_up(table(spark, sf, "lineitem").withColumn("status", status), "l_orderkey", "status", ["confirmed", "unconfirmed"])


@query(
    "canonical_admission",
    """SELECT l_orderkey, l_linenumber, l_suppkey, min(l_suppkey) OVER (PARTITION BY l_orderkey) <> max(l_suppkey) OVER (PARTITION BY l_orderkey) AS conflict FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus, l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) = 1""",
)
def canonical_admission(spark: SparkSession, sf: str) -> DataFrame:
    best = reconcile.canonical_reference(table(spark, sf, "lineitem"), "l_orderkey", [F.asc("l_linestatus"), F.desc("l_shipdate"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], "l_suppkey")
    return best.select("l_orderkey", "l_linenumber", "l_suppkey", "conflict")


@query(
    "admission_reasons",
    """WITH r AS (SELECT doc_id, list_sort(list_filter([CASE WHEN l.doc_id IS NULL THEN 'unlabelled' END, CASE WHEN coalesce(toxic, 0) = 1 THEN 'toxic' END, CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS reasons FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, array_to_string(reasons, ',') AS reasons, NOT list_has_any(reasons, ['toxic', 'short']) OR doc_id % 10 = 0 AS eligible, len(reasons) = 0 AS alert FROM r""",
)
def admission_reasons(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic")
    both = table(spark, sf, "documents").select("doc_id", "n_chars", "lang").join(labels, F.col("doc_id") == F.col("id"), "left")
    why = reasons(unlabelled=F.col("id").isNull(), toxic=F.coalesce("toxic", F.lit(0)) == 1, short=F.col("n_chars") < 500, foreign=F.col("lang") != "en")
    return reconcile.admission(both, why, ["toxic", "short"], F.col("doc_id") % 10 == 0).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "eligible", "alert")


@query(
    "provenance_union",
    """WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_filter(['R', 'A', 'N'], lambda x: list_contains(v, x)), ',') AS provenance FROM s""",
)
def provenance_union(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of two states joined into one list by authority."""
    of = lambda s: F.collect_set(F.when(F.col("l_linestatus") == s, F.col("l_returnflag")))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(of("F").alias("a"), of("O").alias("b"))
    return g.select("l_orderkey", F.array_join(reconcile.merge_provenance(F.col("a"), F.col("b"), ["R", "A", "N"]), ",").alias("provenance"))


@query(
    "live_overlay",
    """WITH c AS (SELECT o_custkey, list(o_orderkey) AS roles FROM orders GROUP BY 1) SELECT o_custkey, len(roles)::INT AS n FROM c WHERE NOT list_bool_and(list_transform(roles, lambda x: x % 3 <> 0))""",
)
def live_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of orders that live rows don't cover wholly."""
    orders = table(spark, sf, "orders")
    cards = orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("roles"))
    return reconcile.overlay(cards, orders.where("o_orderkey % 3 <> 0"), "o_custkey", "roles", "o_orderkey").select("o_custkey", F.size("roles").alias("n"))
