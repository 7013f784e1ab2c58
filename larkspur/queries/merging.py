"""Merges of roles, fields, occurrences, identities and labels, and what is shown of them, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.plans import merging
from larkspur.session import table

#: When a row was written: numbers of an order's lines repeat, so part and supplier tell them apart.
_SEQ = "(l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey"


@query(
    "catalog_reconcile",
    """WITH o AS (SELECT l_orderkey AS k, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS seq, l_returnflag = 'R' AS official, l_discount < 0.09 AS eligible, l_linestatus = 'O' AS open, l_suppkey % 29 = 0 AS gone, l_tax > 0.07 AS flag, l_partkey % 50 AS title FROM lineitem WHERE l_orderkey % 5 <> 0),
    g AS (SELECT k, arg_max(title, seq) FILTER (WHERE official AND eligible) AS ot, arg_min(title, seq) AS ft, bool_or(official AND eligible) AS revive, bool_or(open) AS anyopen, bool_or(gone) AS gone, bool_or(flag) AS flag, count(*) AS n FROM o GROUP BY k),
    s AS (SELECT o_orderkey AS k, o_orderstatus <> 'F' AS was_open, o_custkey % 7 = 0 AS was_flag, o_custkey % 50 AS kept, true AS known FROM orders WHERE o_orderkey % 3 <> 0),
    j AS (SELECT coalesce(s.k, g.k) AS k, known IS NOT NULL AS known, coalesce(was_open, false) AS wo, coalesce(was_flag, false) AS wf, kept, coalesce(ot, kept, ft) AS title, coalesce(anyopen AND NOT gone AND (known IS NULL OR was_open OR revive), false) AS open, coalesce(flag, false) OR coalesce(was_flag, false) AS flag, coalesce(n, 0) AS n FROM s FULL JOIN g ON s.k = g.k)
    SELECT k AS l_orderkey, CASE WHEN NOT known THEN 'create' WHEN wo AND NOT open THEN 'close' WHEN title IS DISTINCT FROM kept OR flag <> wf OR open <> wo THEN 'merge' ELSE 'unchanged' END AS action, title, open, flag, n AS "references" FROM j""",
)
def catalog_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "lineitem").where("l_orderkey % 5 <> 0").select(
        "l_orderkey", F.expr(_SEQ).alias("seq"), (F.col("l_returnflag") == "R").alias("official"), (F.col("l_discount") < 0.09).alias("eligible"), (F.col("l_linestatus") == "O").alias("open"),
        (F.col("l_suppkey") % 29 == 0).alias("gone"), (F.col("l_tax") > 0.07).alias("flag"), (F.col("l_partkey") % 50).alias("title"),
    )
    stored = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") != "F").alias("was_open"), (F.col("o_custkey") % 7 == 0).alias("was_flag"), (F.col("o_custkey") % 50).alias("title"))
    return merging.reconcile_catalog(stored, seen, "l_orderkey", "title")


@query(
    "metadata_reconcile",
    """WITH e AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS p, l_suppkey % 3 AS src, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS seq, CASE WHEN l_partkey % 4 > 0 THEN l_linestatus END AS state, CAST(l_partkey % 5 AS VARCHAR) AS kind, CAST(CAST(l_quantity AS INT) % 2 AS VARCHAR) AS mode FROM lineitem),
    s AS (SELECT k, p, src, arg_max(row(state, kind, mode), seq) AS r FROM e GROUP BY ALL),
    u AS (SELECT k, p, 'state' AS field, r[1] AS v FROM s UNION ALL SELECT k, p, 'kind', r[2] FROM s UNION ALL SELECT k, p, 'mode', r[3] FROM s),
    b AS (SELECT k, field, p, list_sort(list_distinct(list(v))) AS vs FROM u WHERE v IS NOT NULL GROUP BY ALL),
    m AS (SELECT k, field, arg_min(vs, p) AS vs FROM b GROUP BY ALL),
    o AS (SELECT o_orderkey AS k, 'state' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'kind', left(o_orderpriority, 1) FROM orders UNION ALL SELECT o_orderkey, 'mode', CASE WHEN o_custkey % 2 = 0 THEN 'x' END FROM orders)
    SELECT m.k AS l_orderkey, m.field, CASE WHEN len(vs) > 1 THEN o.v ELSE vs[1] END AS value, len(vs) > 1 AS conflict, CASE WHEN len(vs) > 1 THEN array_to_string(vs, '|') END AS candidates FROM m LEFT JOIN o ON m.k = o.k AND m.field = o.field""",
)
def metadata_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Last write of each (order, authority, source), then every field by authority, with the stored value on conflicts."""
    evidence = table(spark, sf, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("priority"), (F.col("l_suppkey") % 3).alias("source"), F.expr(_SEQ).alias("seq"),
        F.when(F.col("l_partkey") % 4 > 0, F.col("l_linestatus")).alias("state"), (F.col("l_partkey") % 5).cast("string").alias("kind"), (F.col("l_quantity").cast("int") % 2).cast("string").alias("mode"),
    )
    slots = merging.latest_slots(evidence, ["l_orderkey", "priority", "source"], "seq", ["state", "kind", "mode"]).drop("source")
    stored = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("state"), F.left("o_orderpriority", F.lit(1)).alias("kind"), F.when(F.col("o_custkey") % 2 == 0, "x").alias("mode"))
    return merging.reconcile_fields(slots, stored, "l_orderkey", "priority", ["state", "kind", "mode"])


@query(
    "occurrence_merge",
    """SELECT l_orderkey, l_suppkey % 2 AS source, CAST(min(l_shipdate) AS DATE) AS attached, arg_max(l_returnflag, row(l_shipdate, l_linenumber, l_partkey)) AS admission, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS urls, bool_or(l_tax = 0) AS exact FROM lineitem GROUP BY 1, 2""",
)
def occurrence_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").withColumn("source", F.col("l_suppkey") % 2).withColumn("day", F.to_date("l_shipdate")).withColumn("exact_day", F.col("l_tax") == 0)
    return merging.merge_occurrences(rows, ["l_orderkey", "source"], "day", F.struct("l_shipdate", "l_linenumber", "l_partkey"), "l_returnflag", "l_partkey", "exact_day")


@query(
    "assessment_selection",
    """WITH r AS (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC) AS r FROM events), g AS (SELECT user_id, coalesce(min(event_type) FILTER (WHERE event_type <> 'view'), min(event_type)) AS lo, coalesce(max(event_type) FILTER (WHERE event_type <> 'view'), max(event_type)) AS hi FROM r WHERE r = 1 GROUP BY 1)
    SELECT user_id, CASE WHEN lo = hi THEN lo ELSE 'unknown' END AS outcome, lo <> hi AS conflict FROM g""",
)
def assessment_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome of a user's last day; views say nothing where anything else was said."""
    return merging.select_assessment(table(spark, sf, "events").withColumn("day", F.to_date("ts")), "user_id", "day", "event_type", F.col("event_type") != "view")


@query(
    "identity_decision",
    """WITH g AS (SELECT l_orderkey, count(DISTINCT l_suppkey % 2) FILTER (WHERE l_discount > 0.05) AS scopes, count(DISTINCT l_partkey % 2) FILTER (WHERE l_discount > 0.05) AS ids, bool_or(l_tax = 0) AS b FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN scopes > 1 OR ids > 1 THEN 'quarantined' WHEN scopes = 1 AND ids = 1 OR b THEN 'confirmed' ELSE 'unconfirmed' END AS status, scopes, ids FROM g""",
)
def identity_decision(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 2).alias("scope"), (F.col("l_partkey") % 2).alias("posting"), (F.col("l_discount") > 0.05).alias("fresh"), (F.col("l_tax") == 0).alias("before"))
    return merging.decide_identity(refs, "l_orderkey", "scope", "posting", "fresh", "before")


@query(
    "consensus_promotion",
    """WITH r AS (SELECT l_suppkey, l_partkey, l_returnflag, l_shipdate, dense_rank() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC) AS r FROM lineitem), g AS (SELECT l_suppkey, l_partkey, min(l_returnflag) AS lo, max(l_returnflag) AS hi, count(DISTINCT l_shipdate) AS snapshots FROM r WHERE r <= 3 GROUP BY 1, 2)
    SELECT l_suppkey || ':' || l_partkey AS tenant, CASE WHEN lo = hi THEN 'promoted' ELSE 'superseded' END AS decision, CASE WHEN lo = hi THEN lo END AS label, snapshots FROM g""",
)
def consensus_promotion(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_returnflag")
    tenant = F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"))
    return merging.promote_labels(rows, ["l_suppkey", "l_partkey"], "l_shipdate", "l_returnflag").select(tenant.alias("tenant"), "decision", "label", "snapshots")


@query(
    "personalized_releases",
    """WITH m AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, l_orderkey * 10 + l_linenumber AS role, l_returnflag || '|' || l_linestatus AS c FROM lineitem WHERE l_quantity > 25), k AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY l_suppkey, month) >= 4 THEN '*' ELSE c END AS cohort FROM m)
    SELECT l_suppkey, month, cohort, CASE WHEN cohort = '*' THEN 'employer-release' WHEN count(*) = 1 THEN 'individual' ELSE 'program-group' END AS presentation, count(*) AS roles, min(role) AS first_role FROM k GROUP BY 1, 2, 3""",
)
def personalized_releases(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered before grouping, so counts never show what didn't match."""
    matching = table(spark, sf, "lineitem").where("l_quantity > 25").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("role"), "l_returnflag", "l_linestatus")
    return merging.personalized_releases(matching, ["l_suppkey", "month"], ["l_returnflag", "l_linestatus"], "role")


@query(
    "rotating_scopes",
    """WITH d AS (SELECT DISTINCT l_partkey FROM lineitem), n AS (SELECT l_partkey, row_number() OVER (ORDER BY md5(l_partkey::VARCHAR)) - 1 AS place, count(*) OVER () AS k FROM d)
    SELECT l_partkey, place FROM n WHERE k <= 40 OR (place - (6 * 40) % k + k) % k < 40""",
)
def rotating_scopes(spark: SparkSession, sf: str) -> DataFrame:
    return merging.rotating_scopes(table(spark, sf, "lineitem"), "l_partkey", 7, 40)


@query(
    "observation_groups",
    """SELECT p_brand, p_type, p_size, array_to_string(list_sort(list_distinct(list(p_partkey))), ',') AS ids FROM part GROUP BY 1, 2, 3""",
)
def observation_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "part").groupBy("p_brand", "p_type", "p_size").agg(F.array_sort(F.collect_set("p_partkey")).alias("ids"))
    return g.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(
    "catalog_rows",
    """WITH v AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'baseline' ELSE 'normal' END END AS recency, CASE WHEN o_custkey % 3 > 0 THEN o_orderdate END AS visible, o_orderdate - INTERVAL 2 DAY AS seen, CASE WHEN o_custkey % 5 > 0 THEN o_orderstatus <> 'P' END AS technical, CASE WHEN o_custkey % 7 > 0 THEN o_totalprice > 50000 END AS eligible, CAST(year(o_orderdate) AS INT) AS season FROM orders),
    c AS (SELECT o_orderkey, coalesce(recency, 'normal') AS recency, CAST(coalesce(visible, seen) AS DATE) AS day FROM v WHERE technical IS DISTINCT FROM false AND coalesce(eligible, true) AND season >= 1998)
    SELECT o_orderkey, recency, day, CASE recency WHEN 'normal' THEN '3' ELSE '1' END || '#' || day || '#' || o_orderkey AS sort_key FROM c WHERE day >= DATE '1999-01-01' AND day < DATE '1999-07-01'""",
)
def catalog_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Publishable rows of a half-open window of days, with the defaults of legacy rows and the composite sort key."""
    c = F.col("o_custkey")
    recency = F.coalesce(F.when(c % 4 > 0, F.when(F.col("o_orderpriority").startswith("1"), "baseline").otherwise("normal")), F.lit("normal"))
    day = F.to_date(F.coalesce(F.when(c % 3 > 0, F.col("o_orderdate")), F.col("o_orderdate") - F.expr("INTERVAL 2 DAYS")))
    technical, eligible = F.when(c % 5 > 0, F.col("o_orderstatus") != "P"), F.when(c % 7 > 0, F.col("o_totalprice") > 50000)
    publishable = F.coalesce(technical, F.lit(True)) & F.coalesce(eligible, F.lit(True)) & (F.year("o_orderdate") >= 1998)
    rows = table(spark, sf, "orders").where(publishable).select("o_orderkey", recency.alias("recency"), day.alias("day"))
    key = F.concat_ws("#", F.when(F.col("recency") == "normal", "3").otherwise("1"), F.col("day").cast("string"), F.col("o_orderkey").cast("string"))
    return rows.where((F.col("day") >= "1999-01-01") & (F.col("day") < "1999-07-01")).withColumn("sort_key", key)


@query(
    "source_classes",
    """SELECT l_orderkey, array_to_string(list_concat(['all'], CASE WHEN bool_or(l_returnflag = 'R') THEN ['direct'] ELSE [] END, CASE WHEN bool_or(l_returnflag = 'A') THEN ['community'] ELSE [] END, CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') THEN ['corroborated'] ELSE [] END), ',') AS classes FROM lineitem GROUP BY 1""",
)
def source_classes(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(flag == "R").alias("d"), F.bool_or(flag == "A").alias("c"))
    return g.select("l_orderkey", F.concat_ws(",", F.lit("all"), F.when(F.col("d"), "direct"), F.when(F.col("c"), "community"), F.when(F.col("d") & F.col("c"), "corroborated")).alias("classes"))


@query(
    "posting_timing",
    """WITH t AS (SELECT l_orderkey, min(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS official, min(l_shipdate) FILTER (WHERE l_returnflag = 'A') AS said FROM lineitem GROUP BY 1)
    SELECT o_orderkey, CASE WHEN official IS NOT NULL THEN 'employer-posted' WHEN said IS NOT NULL THEN 'source-reported' WHEN o_custkey % 6 > 0 THEN 'found' ELSE 'unknown' END AS kind, CAST(coalesce(official, said, CASE WHEN o_custkey % 6 > 0 THEN o_orderdate END) AS DATE) AS day FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""",
)
def posting_timing(spark: SparkSession, sf: str) -> DataFrame:
    """The earliest official time, else the earliest reported one, else when the role was found."""
    flag = F.col("l_returnflag")
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(flag == "R", F.col("l_shipdate"))).alias("official"), F.min(F.when(flag == "A", F.col("l_shipdate"))).alias("said"))
    found = F.when(F.col("o_custkey") % 6 > 0, F.col("o_orderdate"))
    kind = F.when(F.col("official").isNotNull(), "employer-posted").when(F.col("said").isNotNull(), "source-reported").when(found.isNotNull(), "found").otherwise("unknown")
    joined = table(spark, sf, "orders").join(t, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", kind.alias("kind"), F.to_date(F.coalesce("official", "said", found)).alias("day"))
