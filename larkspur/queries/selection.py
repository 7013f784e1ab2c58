"""Selections, decisions and repairs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.plans import selection
from larkspur.session import table

SIGNALS = ("final-url", "official-application-host", "jsonld-url", "logo-dev", "brandfetch", "page-title", "reviewed-ats-domain", "platform-name", "ats-tenant", "reviewed-domain", "opengraph")


@query(
    "closed_selection",
    """WITH RECURSIVE d AS (SELECT l_orderkey AS g, l_linenumber AS i, max(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2),
    c AS (SELECT d.g, d.i, p.i AS p, x FROM d LEFT JOIN (SELECT g, i FROM d WHERE i <= 3) p ON p.g = d.g AND p.i = d.i - 3),
    r AS (SELECT g, i, list_filter([p, i], lambda y: y IS NOT NULL) AS need, row_number() OVER (PARTITION BY g ORDER BY x DESC, i) AS k FROM c),
    s AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS sel FROM d
      UNION ALL SELECT s.g, r.k, CASE WHEN len(list_distinct(list_concat(sel, need))) <= 4 THEN list_distinct(list_concat(sel, need)) ELSE sel END FROM s JOIN r ON r.g = s.g AND r.k = s.k + 1)
    SELECT l_orderkey, unnest(sel) AS l_linenumber FROM (SELECT g AS l_orderkey, arg_max(sel, k) AS sel FROM s GROUP BY g)""",
)
def closed_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The dearest lines of each order with the lines they hang on, four at most."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    parents = lines.where("l_linenumber <= 3").select("l_orderkey", (F.col("l_linenumber") + 3).alias("l_linenumber"), F.col("l_linenumber").alias("parent"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("price"), "l_linenumber"))
    return selection.closed_selection(lines.join(parents, ["l_orderkey", "l_linenumber"], "left").withColumn("rank", rank), "l_orderkey", "l_linenumber", "parent", "rank", 4)


@query(
    "site_decision",
    """WITH c AS (SELECT o_custkey AS k, o_orderkey % 4 AS site, list(DISTINCT ['final-url', 'official-application-host', 'jsonld-url', 'logo-dev', 'brandfetch', 'page-title', 'reviewed-ats-domain', 'platform-name', 'ats-tenant', 'reviewed-domain', 'opengraph'][CAST((o_orderkey // 4) % 11 AS INT) + 1]) AS s FROM orders WHERE (o_orderkey // 4) % 3 > 0 OR (o_orderkey // 4) % 11 NOT IN (2, 9) GROUP BY 1, 2),
    v AS (SELECT *, least(1.0, round(list_contains(s, 'reviewed-domain')::INT * 1.0 + list_contains(s, 'final-url')::INT * 0.45 + list_contains(s, 'official-application-host')::INT * 0.40 + list_contains(s, 'jsonld-url')::INT * 0.35 + list_contains(s, 'logo-dev')::INT * 0.30 + list_contains(s, 'brandfetch')::INT * 0.30
      + (list_contains(s, 'logo-dev') AND list_contains(s, 'brandfetch'))::INT * 0.25 + list_has_any(s, ['page-title', 'opengraph', 'ats-tenant', 'platform-name'])::INT * 0.15 + list_contains(s, 'reviewed-ats-domain')::INT * 0.35, 6))::DOUBLE AS score,
      CASE WHEN list_contains(s, 'reviewed-domain') THEN 2 WHEN list_contains(s, 'jsonld-url') THEN 1 ELSE 0 END AS said FROM c),
    o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY said DESC, score DESC, site) AS place FROM v),
    b AS (SELECT a.k, a.site, a.score, a.s, a.said, (SELECT max(score) FROM v z WHERE z.k = a.k AND z.site <> a.site) AS runner_up, (SELECT count(*) FROM v z WHERE z.k = a.k AND z.site <> a.site AND list_contains(z.s, 'reviewed-ats-domain')) AS rivals FROM o a WHERE place = 1),
    m AS (SELECT *, coalesce(round(score - runner_up, 6), 1.0) AS margin FROM b)
    SELECT k AS o_custkey, CASE WHEN said > 0 OR (rivals = 0 AND margin >= 0.15 AND score >= CASE WHEN list_contains(s, 'reviewed-ats-domain') AND list_has_any(s, ['logo-dev', 'brandfetch']) THEN 0.6 ELSE 0.85 END) THEN 'resolved'
      WHEN score >= 0.55 OR (runner_up IS NOT NULL AND margin < 0.15) OR len(s) >= 2 THEN 'review' ELSE 'unresolved' END AS outcome, site, score, runner_up FROM m""",
)
def site_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as evidence for one of four sites of their customer."""
    number = F.floor(F.col("o_orderkey") / 4)
    named = F.element_at(F.array(*[F.lit(s) for s in SIGNALS]), (number % len(SIGNALS)).cast("int") + 1)
    orders = table(spark, sf, "orders").where((number % 3 > 0) | ~(number % len(SIGNALS)).isin(2, 9))
    candidates = orders.groupBy("o_custkey", (F.col("o_orderkey") % 4).alias("site")).agg(F.collect_set(named).alias("signals"))
    return selection.site_decision(candidates, "o_custkey", "site", "signals", "site")


@query(
    "delivery_claims",
    """WITH RECURSIVE e AS (SELECT event_id % 1500 AS claim, CASE event_type WHEN 'view' THEN 'delivered' WHEN 'purchase' THEN 'definitive-failure' WHEN 'error' THEN 'unknown' ELSE 'accepted' END AS said, row_number() OVER (PARTITION BY event_id % 1500 ORDER BY event_id) AS k FROM events),
    s AS (SELECT DISTINCT claim, CAST(0 AS BIGINT) AS k, 'claimed' AS state, 0 AS taken FROM e
      UNION ALL SELECT s.claim, s.ek, CASE WHEN ok THEN said ELSE state END, taken + ok::INT FROM (SELECT s.*, e.k AS ek, e.said, (state = 'claimed' AND said <> 'delivered') OR (state = 'accepted' AND said <> 'accepted') AS ok FROM s JOIN e ON e.claim = s.claim AND e.k = s.k + 1) s)
    SELECT claim, arg_max(state, k) AS state, max(taken) AS taken, max(k) - max(taken) AS refused FROM s GROUP BY claim""",
)
def delivery_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Events as what providers report about claims."""
    kind = F.col("event_type")
    said = F.when(kind == "view", "delivered").when(kind == "purchase", "definitive-failure").when(kind == "error", "unknown").otherwise("accepted")
    events = table(spark, sf, "events").select((F.col("event_id") % 1500).alias("claim"), "event_id", said.alias("said"))
    return selection.delivery_claims(events, "claim", "event_id", "said")


@query(
    "repaired_titles",
    """WITH n AS (SELECT DISTINCT p_brand, p_name || ' (' || p_type || ')' AS title FROM part), t AS (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN p_name ELSE left(p_name || CASE WHEN p_partkey % 4 = 1 THEN ' Wholly unknown' ELSE ' (' || p_type END, 12 + CAST(p_partkey % 5 AS INT)) || CASE WHEN p_partkey % 4 = 2 THEN '...' ELSE '… ' END END AS title FROM part),
    h AS (SELECT *, regexp_matches(trim(title), '([.]{3}|…)\\s*$') AS cut, regexp_replace(trim(title), '([.]{3}|…)\\s*$', '') AS head FROM t),
    k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(head), '[^a-z0-9+#/ ]+', ' ', 'g'), ' +', ' ', 'g')) AS prefix FROM h),
    b AS (SELECT k.p_partkey, first(n.title ORDER BY length(n.title), n.title) AS known FROM k JOIN n ON n.p_brand = k.p_brand AND starts_with(trim(regexp_replace(regexp_replace(lower(n.title), '[^a-z0-9+#/ ]+', ' ', 'g'), ' +', ' ', 'g')), k.prefix) WHERE cut GROUP BY 1),
    f AS (SELECT k.*, known, trim(regexp_replace(trim(head), '[\\s(\\[{,\\-–—/]+\\S*$', '')) AS readable FROM k LEFT JOIN b USING (p_partkey))
    SELECT p_partkey, CASE WHEN NOT cut OR prefix = '' THEN trim(title) WHEN known IS NOT NULL THEN known WHEN readable <> '' THEN readable ELSE trim(head) END AS repaired FROM f""",
)
def repaired_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Part names, most of them cut short, repaired from the names of their brand."""
    parts, key = table(spark, sf, "part"), F.col("p_partkey")
    known = parts.select("p_brand", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("title"))
    longer = F.concat("p_name", F.when(key % 4 == 1, " Wholly unknown").otherwise(F.concat(F.lit(" ("), "p_type")))
    title = F.when(key % 4 == 0, F.col("p_name")).otherwise(F.concat(F.left(longer, (12 + key % 5).cast("int")), F.when(key % 4 == 2, "...").otherwise("… ")))
    return selection.repaired_titles(parts.select("p_partkey", "p_brand", title.alias("title")), known, "p_brand", "title").select("p_partkey", "repaired")


@query(
    "clock_free_content",
    """SELECT o_orderkey, sha256(to_json({'state': {'status': o_orderstatus}, 'lines': list({'line': l_linenumber, 'part': l_partkey} ORDER BY l_linenumber, l_partkey)})::VARCHAR) AS content FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""",
)
def clock_free_content(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of orders that don't change as long as only observation times do."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("observedAt"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    state = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("inspectedAt"))
    seen = table(spark, sf, "orders").join(lines, "o_orderkey").select("o_orderkey", F.struct(state.alias("state"), "lines").alias("seen"))
    plain = selection.without_fields(F.col("seen"), seen.schema["seen"].dataType, frozenset({"observedAt", "inspectedAt"}))
    return seen.select("o_orderkey", F.sha2(F.to_json(plain), 256).alias("content"))


@query(
    "same_bands",
    """SELECT l_orderkey % 3 AS bucket, count(*) AS pairs, sum((list_sort([l_partkey % 3, l_suppkey % 3, l_linenumber % 3]) = list_sort([l_suppkey % 3, l_linenumber % 2, l_partkey % 3]))::INT)::BIGINT AS same FROM lineitem GROUP BY 1""",
)
def same_bands(spark: SparkSession, sf: str) -> DataFrame:
    """How often two lists hold the same values equally often."""
    m = lambda name, by: (F.col(name) % by).cast("long")
    same = selection.same_members(F.array(m("l_partkey", 3), m("l_suppkey", 3), m("l_linenumber", 3)), F.array(m("l_suppkey", 3), m("l_linenumber", 2), m("l_partkey", 3)))
    return table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 3).alias("bucket")).agg(F.count("*").alias("pairs"), F.sum(same.cast("long")).alias("same"))


@query(
    "verified_selection",
    """WITH w AS (SELECT count(*) AS all_rows, CAST(sum(('0x' || left(md5(concat_ws(',', o_orderkey, o_custkey, o_orderstatus)), 12))::BIGINT) AS VARCHAR) AS all_digest FROM orders) SELECT o_orderkey, o_custkey, all_rows, all_digest FROM orders, w WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""",
)
def verified_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of large lines beside the count and digest of all orders."""
    wanted = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return selection.verified_selection(table(spark, sf, "orders"), "o_orderkey", wanted, ["o_orderkey", "o_custkey", "o_orderstatus"]).select("o_orderkey", "o_custkey", "all_rows", "all_digest")


@query(
    "first_destinations",
    """SELECT l_orderkey, count(*) AS raw_count, count(*) FILTER (place = 1) AS kept FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS place FROM lineitem) GROUP BY 1""",
)
def first_destinations(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents, parts as what they point to."""
    return selection.first_destinations(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
