"""What postings state, over postings that orders write with their own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.plans import evidence, merging
from larkspur.session import table


@query(
    "role_evidence",
    r"""WITH o AS (SELECT o_orderkey AS n, o_orderkey % 6 AS k, year(o_orderdate) + 20 AS y, o_custkey % 40 + 20 AS a, o_custkey % 7 AS c, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS d FROM orders),
    t AS (SELECT *, CASE k WHEN 0 THEN 'Summer Intern ' || y WHEN 3 THEN 'PhD Intern (Remote), Fall ' || y ELSE 'Order ' || n END AS title,
      CASE k WHEN 0 THEN 'We build things.' || chr(10) || 'Compensation:' || chr(10) || 'USD ' || a || ' - ' || (a + 5) || ' per hour.' || chr(10) || 'Location: City ' || c || chr(10) || 'Requirements:' || chr(10) || 'You must have a Bachelor''s degree. Graduating between June ' || (y + 1) || ' and June ' || (y + 2) || '.' || chr(10) || '# How to apply' || chr(10) || 'Applications are reviewed on a rolling basis.'
        WHEN 1 THEN 'Pay is $' || a || ' - $' || (a + 5) || ' per hour.' || chr(10) || 'Base pay:' || chr(10) || 'USD ' || a || ' - ' || (a + 5) || ' per hour.' || chr(10) || 'Apply by ' || strftime(d, '%B %-d, %Y') || '.'
        WHEN 4 THEN 'This role is fully remote.' || chr(10) || 'Posted: ' || d || chr(10) || 'Last updated: ' || strftime(d, '%-d %B %Y') WHEN 5 THEN 'This role may be remote. The deadline is 30 February ' || y || '.' ELSE 'We build things ' || c || '.' END AS said FROM o)
    SELECT n AS o_orderkey, CASE k WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END AS n_sections, k NOT IN (2, 5) AS stated, CASE k WHEN 0 THEN 'Compensation ' || a || '-' || (a + 5) || ' USD hourly' WHEN 1 THEN 'Base pay ' || a || '-' || (a + 5) || ' USD hourly' END AS pay, CASE WHEN k = 0 THEN 'undergraduate' END AS levels, CASE WHEN k = 0 THEN 'bachelors' END AS minimum,
      CASE WHEN k = 0 THEN (y + 1) || '-06 ' || (y + 2) || '-06' END AS graduation, CASE k WHEN 0 THEN 'summer ' || y WHEN 3 THEN 'fall ' || y END AS season, CASE WHEN k = 0 THEN 'City ' || c END AS locations, CASE WHEN k = 4 THEN 'remote' END AS mode, CASE k WHEN 0 THEN 'rolling' WHEN 1 THEN 'date ' || d END AS deadline,
      CASE WHEN k = 4 THEN d || ' ' || d END AS posted_updated, CASE k WHEN 0 THEN 'summer ' || y WHEN 3 THEN 'doctoral fall ' || y || ' remote' END AS from_title, sha256('{"title":"' || title || '","description":"' || replace(said, chr(10), '\n') || '","completeness":"complete"}') AS hash FROM t""",
)
def role_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Sections, evidence and content hash of a posting for each order; two of six kinds state nothing. A few files of orders hold many postings, so the rows are dealt out before they are read; equal texts are read once."""
    e = F.expr
    orders = table(spark, sf, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("n"), e("o_orderkey % 6").alias("k"), e("year(o_orderdate) + 20").alias("y"), e("o_custkey % 40 + 20").alias("a"), e("o_custkey % 7").alias("c"), F.add_months("o_orderdate", 240).alias("d")
    ).repartition(merging.sorting_tasks(orders), "n")
    titles = {0: "'Summer Intern ' || y", 3: "'PhD Intern (Remote), Fall ' || y"}
    texts = {
        0: r"'We build things.\r\nCompensation:\r\nUSD ' || a || ' - ' || (a + 5) || ' per hour.\nLocation: City ' || c || '\nRequirements:\nYou must have a Bachelor\'s degree. Graduating between June ' || (y + 1) || ' and June ' || (y + 2) || '.\n# How to apply\nApplications are reviewed on a rolling basis.'",
        1: r"'Pay is $' || a || ' - $' || (a + 5) || ' per hour.\nBase pay:\nUSD ' || a || ' - ' || (a + 5) || ' per hour.\nApply by ' || date_format(d, 'MMMM d, yyyy') || '.'",
        4: r"'This role is fully remote.\nPosted: ' || d || '\nLast updated: ' || date_format(d, 'd MMMM yyyy')",
        5: "'This role may be remote. The deadline is 30 February ' || y || '.'",
    }
    case = lambda kinds, other: e("CASE k " + " ".join(f"WHEN {k} THEN {x}" for k, x in kinds.items()) + f" ELSE {other} END")
    rows = rows.select("n", case(titles, "'Order ' || n").alias("title"), case(texts, "'We build things ' || c || '.'").alias("description"))
    met = evidence.with_statements(rows, alike=True)
    text = lambda x: F.nullif(x, F.lit(""))
    season = lambda s: F.concat_ws(" ", s["term"], s["year"].cast("string"))
    v, alone = (lambda name: F.col(f"_{name}")), (lambda name: F.col(f"_title_{name}"))
    pay = F.transform(v("pay"), lambda p: F.concat_ws(" ", p["label"], F.concat_ws("-", p["low"].cast("int").cast("string"), p["high"].cast("int").cast("string")), p["currency"], p["period"]))
    return met.select(
        F.col("n").alias("o_orderkey"), v("sections").alias("n_sections"), v("stated").alias("stated"), text(F.array_join(pay, ";")).alias("pay"), text(F.array_join(v("levels"), ",")).alias("levels"), v("minimum_degree").alias("minimum"), text(F.concat_ws(" ", v("graduation")["start"], v("graduation")["end"])).alias("graduation"),
        text(season(v("season"))).alias("season"), text(F.array_join(v("locations"), ",")).alias("locations"), v("work_mode").alias("mode"), text(F.concat_ws(" ", v("deadline")["kind"], v("deadline")["date"].cast("string"))).alias("deadline"),
        text(F.concat_ws(" ", v("posted").cast("string"), v("updated").cast("string"))).alias("posted_updated"), text(F.concat_ws(" ", F.nullif(F.array_join(alone("levels"), ","), F.lit("")), F.nullif(season(alone("season")), F.lit("")), alone("work_mode"))).alias("from_title"),
        evidence.content_hash(F.col("title"), F.col("description"))["hash"].alias("hash"),
    )
