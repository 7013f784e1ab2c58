"""The catalog request over roles that orders state with their own values."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.plans.facets import CatalogRequest, filtered_groups, matches
from larkspur.session import table

REQUESTS = {
    "query": CatalogRequest(query="Clerk-1, not"), "status": CatalogRequest(status="closed"), "employer": CatalogRequest(employer_categories=["startup", "large"]), "citizenship": CatalogRequest(hide_citizenship_required=True),
    "reader": CatalogRequest(education_level="undergraduate"), "confirmed": CatalogRequest(confirmed_only=True), "source": CatalogRequest(source="direct"), "disciplines": CatalogRequest(disciplines=["ML"], discipline_keys={"ml": "ai-ml", "machine learning": "ai-ml"}),
    "seasons": CatalogRequest(seasons=["  summer   1998", "Fall 1999"]), "levels": CatalogRequest(education_levels=["MASTERS"]), "modes": CatalogRequest(work_modes=["hybrid"]), "pay": CatalogRequest(has_compensation=True),
    "day": CatalogRequest(day=date(1998, 6, 10), day_zone="America/New_York"), "since": CatalogRequest(added_since=datetime(1998, 6, 1, 5, tzinfo=UTC)), "before": CatalogRequest(added_before=datetime(1998, 6, 1, 5, tzinfo=UTC)), "places": CatalogRequest(locations=["austin,  tx", "REMOTE"]),
}
COMBINED = CatalogRequest(
    query="clerk", status="open", employer_categories=["startup", "large"], hide_citizenship_required=True, education_level="undergraduate", source="direct", education_levels=["undergraduate", "masters"],
    work_modes=["remote", "hybrid"], has_compensation=True, added_since=datetime(1996, 1, 1, tzinfo=UTC), added_before=datetime(2001, 1, 1, tzinfo=UTC),
)

_ROLES = """WITH b AS (SELECT o_orderkey AS role_id, o_custkey % 977 AS group_id, o_orderkey % 3 AS k, o_custkey % 4 AS e, year(o_orderdate) AS y, * FROM orders),
    r AS (SELECT role_id, group_id, k, e, 'Clerk-' || (o_custkey % 20) || ' & Sons' AS company, o_orderpriority || ' intern' AS title, o_orderstatus <> 'F' AS open, ['startup', 'large', 'public'][CAST(o_custkey % 3 AS INT) + 1] AS category, role_id % 11 = 0 AS citizen, role_id % 7 = 0 AS advanced,
      role_id % 5 = 0 AS unconfirmed, CASE k WHEN 0 THEN ['Data', 'Machine  Learning'] WHEN 1 THEN ['security'] ELSE ['AI-ML', 'data'] END AS disciplines, CASE WHEN role_id % 2 = 0 THEN 'Summer ' ELSE 'Fall ' END || y AS season, CASE e WHEN 0 THEN ['Remote'] WHEN 1 THEN ['Onsite', 'Hybrid'] ELSE ['Onsite'] END AS modes,
      CASE k WHEN 0 THEN ['Austin,', 'TX'] WHEN 1 THEN ['Oslo', 'Remote (EU)'] ELSE ['Oslo'] END AS places, o_totalprice > 100000 AS paid, o_orderdate + to_hours(CAST(role_id % 24 AS INT)) AS seen, role_id % 6 AS d FROM b)"""


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    """One role for each order; every sixth has no release day, every other observed it."""
    e = F.expr
    rows = table(spark, sf, "orders").withColumn("seen", e("CAST(o_orderdate AS TIMESTAMP) + make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS INT))"))
    return rows.select(
        F.col("o_orderkey").alias("role_id"), e("o_custkey % 977").alias("group_id"), e("'Clerk-' || (o_custkey % 20) || ' & Sons'").alias("company"), e("o_orderpriority || ' intern'").alias("title"), e("o_orderstatus <> 'F'").alias("open"),
        e("element_at(array('startup', 'large', 'public'), CAST(o_custkey % 3 AS INT) + 1)").alias("employer_category"), e("o_orderkey % 11 = 0").alias("requires_citizenship"), e("o_orderkey % 7 = 0").alias("advanced_degree"),
        e("element_at(array(array(), array('undergraduate'), array('masters', 'doctoral'), array('Masters', 'undergraduate')), CAST(o_custkey % 4 AS INT) + 1)").alias("education_levels"),
        e("element_at(array('explicit', 'unspecified', 'conflicting'), CAST(o_orderkey % 3 AS INT) + 1)").alias("education_evidence"), e("CASE WHEN o_orderkey % 5 = 0 THEN 'unconfirmed' END").alias("identity_status"),
        e("element_at(array('official', 'community', 'corroborated'), CAST(o_orderkey % 3 AS INT) + 1)").alias("credibility"), e("element_at(array(array('Data', 'Machine  Learning'), array('security'), array('AI-ML', 'data')), CAST(o_orderkey % 3 AS INT) + 1)").alias("disciplines"),
        e("CASE WHEN o_orderkey % 2 = 0 THEN 'Summer ' ELSE 'Fall ' END || year(o_orderdate)").alias("season"), e("CASE o_custkey % 4 WHEN 0 THEN array('Remote') WHEN 1 THEN array('Onsite', 'Hybrid') ELSE array('Onsite') END").alias("work_modes"),
        e("CASE o_orderkey % 3 WHEN 0 THEN array('Austin,', 'TX') WHEN 1 THEN array('Oslo', 'Remote (EU)') ELSE array('Oslo') END").alias("locations"), e("CASE WHEN o_totalprice > 100000 THEN '30/h' ELSE ' \t' END").alias("pay"),
        F.col("seen").alias("visible_at"), e("CASE WHEN o_orderkey % 6 <> 0 THEN to_date(seen) END").alias("release_day"), e("o_orderkey % 2 = 1").alias("release_day_observed"),
    )


@query(
    "catalog_requests",
    _ROLES
    + """ SELECT role_id, array_to_string(list_sort(list_filter([CASE WHEN (starts_with(company, 'Clerk-1 ') OR company LIKE 'Clerk-1_ %') AND title LIKE '%NOT SPECIFIED%' THEN 'query' END, CASE WHEN NOT open THEN 'status' END, CASE WHEN category <> 'public' THEN 'employer' END, CASE WHEN NOT citizen THEN 'citizenship' END,
      CASE WHEN k = 0 AND e <> 0 AND e <> 2 OR (k <> 0 OR e = 0) AND NOT advanced THEN 'reader' END, CASE WHEN NOT unconfirmed THEN 'confirmed' END, CASE WHEN k <> 1 THEN 'source' END, CASE WHEN k <> 1 THEN 'disciplines' END, CASE WHEN season IN ('Summer 1998', 'Fall 1999') THEN 'seasons' END,
      CASE WHEN k = 1 OR e >= 2 THEN 'levels' END, CASE WHEN e = 1 THEN 'modes' END, CASE WHEN paid THEN 'pay' END, CASE WHEN d <> 0 AND CASE WHEN d % 2 = 1 THEN CAST(timezone('America/New_York', timezone('UTC', seen)) AS DATE) ELSE CAST(seen AS DATE) END = DATE '1998-06-10' THEN 'day' END,
      CASE WHEN seen >= TIMESTAMP '1998-06-01 05:00:00' THEN 'since' END, CASE WHEN seen < TIMESTAMP '1998-06-01 05:00:00' THEN 'before' END, CASE WHEN k <= 1 THEN 'places' END], lambda x: x IS NOT NULL)), ',') AS matched FROM r""",
)
def catalog_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Which of sixteen requests, one for each facet, every role answers, in one pass."""
    met = F.array_sort(F.array_compact(F.array(*[F.when(matches(r), F.lit(name)) for name, r in REQUESTS.items()])))
    return _roles(spark, sf).select("role_id", F.array_join(met, ",").alias("matched"))


@query(
    "catalog_groups_filtered",
    _ROLES
    + """, m AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY seen DESC, role_id) AS n FROM r WHERE open AND category <> 'public' AND NOT citizen AND (k = 0 AND e <> 0 AND e <> 2 OR (k <> 0 OR e = 0) AND NOT advanced) AND k <> 1 AND e IN (1, 3)
        AND e < 2 AND paid AND seen >= TIMESTAMP '1996-01-01' AND seen < TIMESTAMP '2001-01-01'),
    s AS (SELECT group_id, count(*) AS role_count, count(*) FILTER (unconfirmed) AS unconfirmed_count, min(seen) AS created_at, max(seen) AS updated_at, max(role_id) FILTER (n = 1) AS featured_role, min(seen) <> max(seen) AS has_new_roles FROM m GROUP BY group_id),
    x AS (SELECT group_id, n, 'titles' AS kind, title AS value FROM m UNION ALL SELECT group_id, n, 'disciplines', unnest(disciplines) FROM m UNION ALL SELECT group_id, n, 'locations', unnest(places) FROM m UNION ALL SELECT group_id, n, 'work_modes', unnest(modes) FROM m UNION ALL SELECT group_id, n, 'seasons', season FROM m),
    f AS (SELECT group_id, kind, value, row_number() OVER (PARTITION BY group_id, kind ORDER BY min(n), value) AS i FROM x GROUP BY group_id, kind, value),
    l AS (SELECT group_id, string_agg(value, ';' ORDER BY i) FILTER (kind = 'titles' AND i <= 3) AS titles, string_agg(value, ';' ORDER BY i) FILTER (kind = 'disciplines' AND i <= 6) AS disciplines, string_agg(value, ';' ORDER BY i) FILTER (kind = 'locations') AS locations,
      string_agg(value, ';' ORDER BY i) FILTER (kind = 'work_modes') AS work_modes, string_agg(value, ';' ORDER BY i) FILTER (kind = 'seasons') AS seasons FROM f GROUP BY group_id)
    SELECT group_id, role_count, unconfirmed_count, strftime(created_at, '%Y-%m-%d %H') AS created_at, strftime(updated_at, '%Y-%m-%d %H') AS updated_at, featured_role, has_new_roles, titles, disciplines, locations, work_modes, seasons FROM s JOIN l USING (group_id)""",
)
def catalog_groups_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Groups under a request of eleven facets, summed up over the roles that match."""
    groups = filtered_groups(_roles(spark, sf), COMBINED)
    for at in ("created_at", "updated_at"):
        groups = groups.withColumn(at, F.date_format(at, "yyyy-MM-dd HH"))
    for shown in ("titles", "disciplines", "locations", "work_modes", "seasons"):
        groups = groups.withColumn(shown, F.array_join(shown, ";"))
    return groups
