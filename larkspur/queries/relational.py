"""Filters, joins, aggregates, windows and pages over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.functions.time import zone_day
from larkspur.operators import filters, relational
from larkspur.session import table


@query(
    "facet_filter",
    """SELECT p_partkey, p_brand, p_size, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM part JOIN lineitem ON l_partkey = p_partkey
    WHERE lower(p_brand) IN ('brand#11', 'brand#22', 'brand#33') AND p_size BETWEEN 5 AND 30 AND (l_returnflag = 'N' OR l_linestatus = 'O')
      AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '2000-01-01' GROUP BY ALL""",
)
def facet_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Facets over parts and their lines; flag N is the unspecified evidence that passes whatever is asked for."""
    status = F.when(F.col("l_returnflag") == "N", "unspecified").otherwise("stated")
    wanted = filters.all_of(filters.any_of("p_brand", ["Brand#11", "Brand#22", "Brand#33"]), F.col("p_size").between(5, 30))
    shipped = filters.in_half_open(F.col("l_shipdate"), F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("2000-01-01").cast("timestamp_ntz"))
    lines = table(spark, sf, "lineitem").where(shipped & filters.unless_stated(status, F.col("l_linestatus") == "O"))
    return table(spark, sf, "part").where(wanted).join(lines, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_partkey", "p_brand", "p_size").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("word_prefix_search", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(^|[^a-z0-9])re') AND regexp_matches(lower(p_name), '(^|[^a-z0-9])w')")
def word_prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(filters.prefixes_words(F.col("p_name"), ["re", "W"])).select("p_partkey", "p_name")


@query(
    "alert_reasons",
    """SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN text ILIKE '%token%' THEN 'keyword' END, CASE WHEN lang IN ('en', 'de') THEN 'category' END, CASE WHEN n_chars >= 1000 THEN 'size' END], lambda x: x IS NOT NULL)), ',') AS reasons
    FROM documents WHERE source <> 'src3' AND (text ILIKE '%token%' OR lang IN ('en', 'de')) AND n_chars >= 1000""",
)
def alert_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Exclusions win; (keyword or category) and size; the reasons that hold are named."""
    word, kind, size = F.contains(F.lower("text"), F.lit("token")), F.col("lang").isin("en", "de"), F.col("n_chars") >= 1000
    kept = table(spark, sf, "documents").where((F.col("source") != "src3") & (word | kind) & size)
    return kept.select("doc_id", F.array_join(filters.reasons(keyword=word, category=kind, size=size), ",").alias("reasons"))


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 33, 100, 999)")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Keys reach the Parquet scan as a pushed filter."""
    return table(spark, sf, "orders").where(F.col("o_orderkey").isin(1, 7, 33, 100, 999)).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "two_hop_alias_join",
    """SELECT l_orderkey, l_linenumber, coalesce(a.c, o_custkey) AS canonical, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN (SELECT c_custkey AS f, c_custkey - 1 AS c FROM customer WHERE c_custkey % 10 = 7) a ON o_custkey = a.f JOIN customer ON c_custkey = coalesce(a.c, o_custkey)
    WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = l_orderkey AND x.o_orderstatus = 'F')""",
)
def two_hop_alias_join(spark: SparkSession, sf: str) -> DataFrame:
    """Lines through order, alias and customer, without those that have a receipt already."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    alias = customer.where("c_custkey % 10 = 7").select(F.col("c_custkey").alias("f"), (F.col("c_custkey") - 1).alias("c"))
    events = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    met = relational.two_hop(events, alias, customer.select("c_custkey", "c_name"), "o_custkey", "f", "c", "c_custkey")
    return relational.without(met, (orders.where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")).select("l_orderkey", "l_linenumber", "canonical", "c_name")


@query(
    "registry_star_join",
    """SELECT coalesce(r_name, 'none') AS region, count(*) AS customers, count(s.n) AS with_supplier, round(count(s.n) / count(*), 6) AS coverage
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_acctbal > 5000) s ON s.n = c_nationkey GROUP BY 1""",
)
def registry_star_join(spark: SparkSession, sf: str) -> DataFrame:
    """Three dimensions of fixed size joined to customers; coverage guards a zero denominator."""
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n")).distinct()
    star = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    grouped = star.join(rich, F.col("n") == F.col("c_nationkey"), "left").groupBy(F.coalesce("r_name", F.lit("none")).alias("region")).agg(F.count("*").alias("customers"), F.count("n").alias("with_supplier"))
    return grouped.withColumn("coverage", F.round(F.coalesce(F.try_divide("with_supplier", "customers"), F.lit(0.0)), 6))


@query(
    "semi_anti",
    """SELECT c_mktsegment, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without_orders FROM customer GROUP BY 1""",
)
def semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders").select("o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    has = customer.join(orders, on, "left_semi").select("c_mktsegment", F.lit(1).alias("w"), F.lit(0).alias("wo"))
    hasnt = customer.join(orders, on, "left_anti").select("c_mktsegment", F.lit(0).alias("w"), F.lit(1).alias("wo"))
    return has.unionByName(hasnt).groupBy("c_mktsegment").agg(F.sum("w").alias("with_orders"), F.sum("wo").alias("without_orders"))


@query(
    "interval_join",
    """SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
)
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases within an hour of a click by the same user, as an equi join on user and hour."""
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("clicked"))
    bought = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    return relational.within_interval(clicks, bought, "user_id", "clicked", "bought", 3600).select("user_id", "click_id", "purchase_id")


@query("latest_per_key", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    kept = relational.latest_per_key(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return kept.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("collision_self_join", "SELECT sha256(text) AS digest, min(doc_id) AS first_doc, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING min(source) <> max(source)")
def collision_self_join(spark: SparkSession, sf: str) -> DataFrame:
    """Equal texts of different sources: an aggregate instead of a self join, so a large group makes no pairs."""
    g = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest"))
    return g.agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.count_distinct("source").alias("sources")).where("sources > 1")


@query(
    "dense_rank_recent",
    """SELECT user_id, count(DISTINCT event_type) AS types, count(*) AS n, min(day)::VARCHAR AS since FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY ts::DATE DESC) AS r, ts::DATE AS day FROM events) WHERE r <= 3 GROUP BY 1""",
)
def dense_rank_recent(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's last three active days."""
    days = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    recent = days.withColumn("r", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).where("r <= 3")
    return recent.groupBy("user_id").agg(F.count_distinct("event_type").alias("types"), F.count("*").alias("n"), F.min("day").cast("string").alias("since"))


@query("ordinal", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal FROM documents")
def ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return relational.ordinal(table(spark, sf, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "ordinal")


@query(
    "carry_forward",
    """SELECT conv_id, turn, sha256(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS question FROM conversations QUALIFY role = 'assistant'""",
)
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The last user turn before each assistant turn."""
    asked = relational.carry_forward(table(spark, sf, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "q")
    return asked.where("role = 'assistant'").select("conv_id", "turn", F.sha2("q", 256).alias("question"))


@query(
    "consecutive_streak",
    """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS g FROM d), r AS (SELECT user_id, g, count(*) AS run, max(day) AS fin FROM i GROUP BY 1, 2)
    SELECT user_id, max(run) AS longest, arg_max(run, fin) AS current FROM r GROUP BY 1""",
)
def consecutive_streak(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day")).distinct()
    return relational.streaks(days, "user_id", "day")


@query(
    "conditional_sums",
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS open, round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END), 2) AS discounted, round(avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 4) AS mean_final,
    count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01') AS expired, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01') AS due, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1998-01-01') AS fresh FROM lineitem GROUP BY 1""",
)
def conditional_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Several measures and age buckets in one scan."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    ship = F.col("l_shipdate")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open"), F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0)), 2).alias("discounted"),
        F.round(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))), 4).alias("mean_final"),
        F.count_if(ship < at("1996-01-01")).alias("expired"), F.count_if((ship >= at("1996-01-01")) & (ship < at("1998-01-01"))).alias("due"), F.count_if(ship >= at("1998-01-01")).alias("fresh"),
    )


@query("unnest_facets", "SELECT lang, word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2 HAVING count(*) >= 20")
def unnest_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Words and the documents that hold them: both are rows of one explode, so sums combine before the only shuffle."""
    said = lambda words, n, d: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(n).alias("n"), F.lit(d).alias("d")))
    both = F.concat(said(F.split("text", " "), 1, 0), said(F.array_distinct(F.split("text", " ")), 0, 1))
    rows = table(spark, sf, "documents").select("lang", F.inline(both)).where("word <> ''")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("d").alias("docs")).where("n >= 20")


@query("grouped_struct_list", "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1")
def grouped_struct_list(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_partkey"].cast("string"))), ",").alias("lines"))


@query("conflict_free_map", "SELECT user_id * 100 + day(ts) AS visit, min(event_type) AS event_type FROM events WHERE value > 90 GROUP BY 1 HAVING min(event_type) = max(event_type)")
def conflict_free_map(spark: SparkSession, sf: str) -> DataFrame:
    visits = table(spark, sf, "events").where("value > 90").select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("visit"), "event_type")
    return relational.conflict_free(visits, "visit", "event_type")


@query(
    "union_due",
    """SELECT user_id, min(due)::VARCHAR AS due FROM ((SELECT user_id, ts AS due FROM events WHERE event_type = 'click' ORDER BY ts, user_id LIMIT 500) UNION ALL (SELECT user_id, ts + INTERVAL 1 HOUR FROM events WHERE event_type = 'view' ORDER BY 2, user_id LIMIT 500)
    UNION ALL (SELECT user_id, ts + INTERVAL 1 DAY FROM events WHERE event_type = 'purchase' ORDER BY 2, user_id LIMIT 500)) GROUP BY 1""",
)
def union_due(spark: SparkSession, sf: str) -> DataFrame:
    """The least due time of each user over three limited branches."""
    e = table(spark, sf, "events")
    branch = lambda kind, wait: (e.where(F.col("event_type") == kind).withColumn("due_at", F.col("ts") + F.expr(f"interval {wait}")), "due_at")
    due = relational.least_due([branch("click", "0 hours"), branch("view", "1 hours"), branch("purchase", "1 days")], "user_id", 500)
    return due.select("user_id", F.regexp_replace(F.col("due").cast("string"), r"(\.\d*?)0+$", "$1").alias("due"))


@query(
    "cohort_compare",
    """SELECT CASE WHEN l.doc_id IS NULL THEN 'removed' WHEN l.toxic = 1 THEN 'flagged' WHEN l.quality = 1 THEN 'kept' ELSE 'low' END AS outcome, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def cohort_compare(spark: SparkSession, sf: str) -> DataFrame:
    after = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    both = table(spark, sf, "documents").select("doc_id").join(after, F.col("doc_id") == F.col("id"), "left")
    outcome = F.when(F.col("id").isNull(), "removed").when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "kept").otherwise("low")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("duplicate_groups", "SELECT min(doc_id) AS first_doc, count(*) AS n, min(lang) AS lang FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal texts; texts are shuffled as digests."""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.min("lang").alias("lang")).where("n > 1").select("first_doc", "n", "lang")


@query("host_concentration", "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM pages GROUP BY 1")
def host_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return relational.shares(table(spark, sf, "pages").select(F.expr("try_parse_url(url, 'HOST')").alias("host")), "host")


@query(
    "classifier_metrics",
    """WITH m AS (SELECT count(*) FILTER (WHERE quality = 1 AND n_chars >= 1500) AS tp, count(*) FILTER (WHERE quality <> 1 AND n_chars >= 1500) AS fp, count(*) FILTER (WHERE quality = 1 AND n_chars < 1500) AS fn FROM labels JOIN documents USING (doc_id))
    SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM m""",
)
def classifier_metrics(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return relational.classifier_metrics(both, F.col("quality") == 1, F.col("n_chars") >= 1500)


@query(
    "budget_ledger",
    "SELECT o_orderstatus AS state, count(*) AS n, round(sum(greatest(o_totalprice, 1.1 * coalesce(actual, 0))), 2) AS charged FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS actual FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1",
)
def budget_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Charged is the greater of the reserved and the actual amount."""
    actual = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("actual"))
    both = table(spark, sf, "orders").join(actual, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    charged = F.greatest("o_totalprice", 1.1 * F.coalesce("actual", F.lit(0.0)))
    return both.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.round(F.sum(charged), 2).alias("charged"))


@query(
    "ratchet",
    """WITH c AS (SELECT lang, count(l.doc_id) / count(*) AS now FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1) SELECT lang, round(greatest(0.39, now), 6) AS baseline, round(greatest(0.39, now) - 0.01, 6) AS floor, now < 0.39 - 0.01 AS failing FROM c""",
)
def ratchet(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline only rises; falling more than 0.01 below it fails."""
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct()
    now = table(spark, sf, "documents").join(labelled, F.col("doc_id") == F.col("id"), "left").groupBy("lang").agg((F.count("id") / F.count("*")).alias("now"))
    base = F.greatest(F.lit(0.39), "now")
    return now.select("lang", F.round(base, 6).alias("baseline"), F.round(base - 0.01, 6).alias("floor"), (F.col("now") < 0.39 - 0.01).alias("failing"))


@query("zone_day_index", "SELECT timezone('America/Los_Angeles', timezone('UTC', ts))::DATE::VARCHAR AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def zone_day_index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(zone_day(F.col("ts"), "America/Los_Angeles").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("newest_page", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place BETWEEN 51 AND 75")
def newest_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of 25, newest first."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return relational.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 25).select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"), "place")


@query("keyset_page", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE (o_custkey, o_orderkey) > (100, 500) ORDER BY o_custkey, o_orderkey LIMIT 25")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return relational.after_key(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"], [100, 500], 25).select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(
    "change_only_upsert",
    """SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS change, n.o_orderpriority FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0) n
    LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o USING (o_orderkey) WHERE o.o_orderkey IS NULL OR n.o_orderstatus IS DISTINCT FROM o.o_orderstatus OR n.o_orderpriority IS DISTINCT FROM o.o_orderpriority""",
)
def change_only_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows that are new or differ in some column, nulls compared safely."""
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    orders = table(spark, sf, "orders").select(*cols)
    new = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")))
    return relational.change_only(new, orders.where("o_orderkey % 7 <> 0"), "o_orderkey", cols[1:]).select("o_orderkey", "change", "o_orderpriority")


@query("retention_sweep", "SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01') OR (o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1995-03-01')")
def retention_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """What retention removes: each state has its own term. The whole set, for one rewrite of the table."""
    old = lambda d: F.col("o_orderdate") < F.lit(d).cast("timestamp_ntz")
    final = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").where((final & old("1996-01-01")) | (~final & old("1995-03-01"))).select("o_orderkey", "o_orderstatus")
