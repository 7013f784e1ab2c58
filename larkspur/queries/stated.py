"""What texts say, over sentences that rows write with their own values.

Each twin works out the results from the rows' values and the kind of sentence, never from a pattern; the
patterns themselves are held against worked cases in the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.functions import assess, classify, extract, money, patterns
from larkspur.session import table


def _kind(number: str, *texts: str) -> Column:
    """The text of a row's kind (its number's remainder), with {expressions} of the row's columns in it; doubled quotes stand for one."""

    def told(text: str) -> str:
        out = []
        for k, part in enumerate(text.replace("\\", "\\\\").replace("'", "\\'").replace("{", "\u0000").replace("}", "\u0000").split("\u0000")):
            out.append(f"CAST({part} AS STRING)" if k % 2 else f"'{part}'")
        return f"concat({', '.join(out)})"

    return F.expr(f"CASE pmod({number}, {len(texts)}) " + " ".join(f"WHEN {k} THEN {told(t)}" for k, t in enumerate(texts)) + " END")


@query(
    "graduation_windows",
    """WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS k, year(o_orderdate) + 20 AS y, strftime(o_orderdate, '%m') AS m FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN y || '-' || m WHEN 1 THEN y || '-01' WHEN 3 THEN y || '-' || m WHEN 4 THEN y || '-01' WHEN 5 THEN (y + 1) || '-' || m END AS first_month,
    CASE k WHEN 0 THEN (y + 1) || '-05' WHEN 1 THEN (y + 2) || '-12' WHEN 3 THEN y || '-' || m WHEN 4 THEN y || '-12' WHEN 5 THEN (y + 1) || '-' || m END AS last_month FROM d""",
)
def graduation_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", (F.year("o_orderdate") + 20).alias("y"), F.date_format("o_orderdate", "MMMM").alias("m"))
    said = _kind(
        "o_orderkey", "Graduating between {m} {y} and Spring {y + 1}.", "Class of {y} or {y + 2}", "Graduate students may apply by {m} {y}.", "Expected graduation {m} {y}. Applications close May 2099",
        "Graduating in {y} for the role in Summer {y - 1}", "The internship begins in Fall {y} for those who graduate in {m} {y + 1}",
    )
    window = extract.graduation_window(F.col("said"))
    return rows.withColumn("said", said).select("o_orderkey", window["start"].alias("first_month"), window["end"].alias("last_month"))


@query(
    "education",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 3) THEN ['undergraduate', 'masters', 'doctoral'][CAST(o_custkey % 3 AS INT) + 1] ELSE '' END AS levels, CASE WHEN o_orderkey % 5 = 0 THEN ['bachelors', 'masters', 'doctoral'][CAST(o_custkey % 3 AS INT) + 1] END AS minimum FROM orders""",
)
def education(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("degree", _kind("o_custkey", "Bachelor's", "Master's", "PhD"))
    said = _kind("o_orderkey", "You must have a {degree} degree.", "{degree} degree preferred.", "No {degree} degree is required.", "Open to {degree} students of group {o_orderkey}.", "Please select your degree: {degree}")
    return rows.withColumn("said", said).select("o_orderkey", F.array_join(extract.education_levels(F.col("said")), ",").alias("levels"), extract.minimum_degree(F.col("said")).alias("minimum"))


@query(
    "housing",
    """WITH k AS (SELECT o_orderkey, list_filter([['stipend', 'employer-paid', '', 'employee-cost', 'available', ''][CAST(x % 6 AS INT) + 1] for x in [o_orderkey, o_custkey]], lambda x: x <> '') AS kinds FROM orders)
    SELECT o_orderkey, CASE WHEN len(kinds) = 2 AND kinds[1] = kinds[2] THEN kinds[1] ELSE array_to_string(kinds, ',') END AS kinds FROM k""",
)
def housing(spark: SparkSession, sf: str) -> DataFrame:
    """Two clauses a row, which may speak of one kind of housing."""
    clause = lambda number: _kind(number, "Interns of team {o_custkey} receive a housing stipend.", "We provide free housing near office {o_custkey}.", "Housing is not provided.", "You pay for rent at site {o_custkey}.", "Company accommodation is available for {o_orderkey} interns.", "Reasonable accommodation for interviews.")
    said = F.concat_ws(" ", clause("o_orderkey"), clause("o_custkey"))
    return table(spark, sf, "orders").withColumn("said", said).select("o_orderkey", F.array_join(extract.housing_kinds(F.col("said")), ",").alias("kinds"))


@query("closure_phrases", "SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 5) AS closed FROM orders")
def closure_phrases(spark: SparkSession, sf: str) -> DataFrame:
    said = _kind(
        "o_orderkey", "Posting {o_orderkey}. This position has been filled.", "Posting {o_orderkey}: we are no longer accepting applications for this role", "Posting {o_orderkey}: sorry, no longer accepting applications",
        "The job expired in test suite {o_orderkey}", "Applications for job {o_orderkey} open", "This opening was closed on day {o_orderkey}",
    )
    return table(spark, sf, "orders").withColumn("said", said).select("o_orderkey", extract.closed(F.col("said")).alias("closed"))


@query("badges", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN p_name || '; Size ' || p_size ELSE p_name END AS shown FROM part")
def badges(spark: SparkSession, sf: str) -> DataFrame:
    said = _kind("p_partkey", "{p_name} \U0001f1fa\U0001f1f8 | \U0001f393", "{p_name} - US citizenship required", "{p_name}; Master's degree required ; Size {p_size}", "{p_name}")
    return table(spark, sf, "part").withColumn("said", said).select("p_partkey", extract.without_badges(F.col("said")).alias("shown"))


FIELDS = (("Machine Learning", "ai-ml"), ("Data Analytics", "data"), ("Cloud Platform", "infrastructure-cloud"), ("Cybersecurity", "security"), ("Trading", "quant"), ("UX", "technical-design"), ("Backend", "software"), ("Bäckerei", ""))
KINDS = (("Internship", "intern", "internship"), ("New Grad", "new grad", "new-grad"), ("Co-op", "co op", "co-op"), ("Apprentice", "apprentice", "apprenticeship"), ("Entry-level Role", "entry level role", "entry-level"), ("Lead", "lead", "unknown"), ("Campus Recruiting", "campus recruiting", "unknown"))


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(
    "role_titles",
    f"""SELECT o_orderkey, {_listed([f.lower().replace("ä", "a") for f, _ in FIELDS])}[CAST(o_orderkey % 8 AS INT) + 1] || ' ' || {_listed([k[1] for k in KINDS])}[CAST(o_custkey % 7 AS INT) + 1] || ' ' || o_orderkey AS search,
    {_listed([d for _, d in FIELDS])}[CAST(o_orderkey % 8 AS INT) + 1] AS disciplines, {_listed([k[2] for k in KINDS])}[CAST(o_custkey % 7 AS INT) + 1] AS programme FROM orders""",
)
def role_titles(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat_ws(" ", _kind("o_orderkey", *[f for f, _ in FIELDS]), _kind("o_custkey", *[k[0] for k in KINDS]), F.col("o_orderkey").cast("string"))
    title = F.col("said")
    return table(spark, sf, "orders").withColumn("said", said).select("o_orderkey", extract.search_title(extract.display_title(title)).alias("search"), F.array_join(extract.disciplines(title), ",").alias("disciplines"), extract.programme(title).alias("programme"))


TRADES = (("Software", "swe"), ("Mechanical Design", "design,mechanical"), ("Medical Devices", "biomedical"), ("Battery Materials", "chemical-materials"), ("Renewable Energy", "environmental-energy"), ("Quantitative Trading", "quant"), ("Product Manager", "product"), ("HVAC", "mechanical"))
ROLES = (("Intern", True), ("Graduate Programme", True), ("Accountant", False), ("Working Student", True))


@query(
    "job_categories",
    f"""SELECT title, count(*) AS n, any_value(categories) AS categories, any_value(early) AS early FROM (SELECT {_listed([t for t, _ in TRADES])}[CAST(o_orderkey % 8 AS INT) + 1] || ' ' || {_listed([r for r, _ in ROLES])}[CAST(o_custkey % 4 AS INT) + 1] || ', ' || o_orderstatus || o_custkey % 50 AS title,
    CASE WHEN o_custkey % 4 = 1 THEN 'grad,' ELSE '' END || {_listed([c for _, c in TRADES])}[CAST(o_orderkey % 8 AS INT) + 1] AS categories, o_custkey % 4 <> 2 AS early FROM orders) GROUP BY 1""",
)
def job_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Counted by title first, so patterns are tried once for each different title."""
    title = F.concat(_kind("o_orderkey", *[t for t, _ in TRADES]), F.lit(" "), _kind("o_custkey", *[r for r, _ in ROLES]), F.lit(", "), F.col("o_orderstatus"), (F.col("o_custkey") % 50).cast("string"))
    titles = table(spark, sf, "orders").groupBy(title.alias("title")).agg(F.count("*").alias("n"))
    return titles.withColumn("categories", F.array_join(patterns.categories(F.col("title")), ",")).withColumn("early", patterns.early_career(F.col("title")))


@query("stated_requirements", "SELECT o_orderkey, o_orderkey % 8 IN (0, 1, 2, 6) AS citizen, o_orderkey % 8 IN (4, 6) AS degree FROM orders")
def stated_requirements(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumn("land", _kind("o_custkey", "US", "U.S.", "United States"))
    said = _kind(
        "o_orderkey", "{land} citizens only, for team {o_orderkey}", "Only {land} citizens may apply to {o_orderkey}", "You must be a {land} citizen", "{land} citizens welcome in group {o_orderkey}", "A PhD is required; any citizen may apply",
        "Nice to have: Master's", "Requires an advanced degree or {land} citizenship", "Only graduates with an MBA, {o_orderkey} of them",
    )
    return rows.withColumn("said", said).select("o_orderkey", patterns.requires_citizenship(F.col("said")).alias("citizen"), patterns.requires(F.col("said"), patterns.DEGREE).alias("degree"))


CAUSES = ("transport", "link", "json", "quality", "capacity", "transport", "persistence", "transport", "capacity")


@query("failure_categories", f"SELECT o_orderkey, {_listed(list(CAUSES))}[CAST(o_orderkey % 9 AS INT) + 1] AS category FROM orders")
def failure_categories(spark: SparkSession, sf: str) -> DataFrame:
    said = _kind(
        "o_orderkey", "Application link timed out after {o_custkey} s", "application host {o_custkey} rejected", "Malformed JSON at byte {o_custkey}", "suspicious zero-row snapshot {o_custkey}", "Worker {o_custkey} exceeded CPU",
        "socket {o_custkey} hang up", "constraint {o_custkey} failed", "D1 statement did not settle within {o_custkey} ms", "response body too large: {o_custkey}",
    )
    return table(spark, sf, "orders").withColumn("said", said).select("o_orderkey", patterns.failure_category(F.col("said")).alias("category"))


@query(
    "location_keys",
    "SELECT CASE o_custkey % 6 WHEN 0 THEN 'town ' || o_custkey || ' xy' WHEN 1 THEN 'town ' || o_custkey || ' xy' WHEN 2 THEN 'new york ny' WHEN 3 THEN 'remote' WHEN 4 THEN 'new york ny' ELSE 'remote area ' || o_custkey END AS place, count(*) AS n FROM orders GROUP BY 1",
)
def location_keys(spark: SparkSession, sf: str) -> DataFrame:
    said = _kind("o_custkey", "Town {o_custkey}, XY", "  TOWN-{o_custkey} (xy)! ", "NYC", "Remote - US", "New York, NY", "Remote area {o_custkey}")
    return table(spark, sf, "orders").groupBy(assess.location_key(said).alias("place")).agg(F.count("*").alias("n"))


@query(
    "public_links",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'https://a' || o_custkey || '.test/x?id=' || o_orderkey || '#top' WHEN 1 THEN 'https://a.test/x?id=' || o_orderkey || '&b=%20' WHEN 2 THEN 'HTTP://a.test/' || o_custkey WHEN 3 THEN 'ftp://a.test/?utm_x=' || o_orderkey ELSE 'https://a.test/' || o_orderkey END AS public FROM orders""",
)
def public_links(spark: SparkSession, sf: str) -> DataFrame:
    said = _kind("o_orderkey", "https://a{o_custkey}.test/x?utm_source=q&id={o_orderkey}#top", "https://a.test/x?id={o_orderkey}&b=%20", "HTTP://a.test/{o_custkey}?gclid={o_orderkey}", "ftp://a.test/?utm_x={o_orderkey}", "https://a.test/{o_orderkey}")
    return table(spark, sf, "orders").withColumn("said", said).select("o_orderkey", assess.public_url(F.col("said")).alias("public"))


@query(
    "pay_ranges",
    """WITH p AS (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 9 AS k, 10 + CAST(l_quantity AS INT) AS low, 15 + CAST(l_quantity AS INT) + l_linenumber AS high FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN low || '-' || high || ' XXX hourly' WHEN 1 THEN low || '000-' || high || '000 USD annual' WHEN 2 THEN low || '000-' || high || '000 XXX annual' WHEN 3 THEN low || '0-' || high || '0 EUR monthly' WHEN 4 THEN low || '-' || high || ' USD hourly'
    WHEN 5 THEN low || '-' || high || ' USD hourly' WHEN 7 THEN low || '-' || high || ' USD other' WHEN 8 THEN low || '-' || low || ' GBP weekly' ELSE '' END AS told FROM p""",
)
def pay_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + F.col("l_linenumber")).alias("k"), (10 + F.col("l_quantity").cast("int")).alias("low"), (15 + F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("high")).repartition("l_orderkey", "l_linenumber")
    said = _kind(
        "k", "Pay: ${low} - ${high} per hour.", "USD {low},000 to {high},000 per year", "The range is ${low}k - ${high}k/yr", "€{low}0 - €{high}0 monthly in Berlin", "US${low} - US${high} per hour", "Hourly pay range: ${low} - ${high} (USD)",
        "A signing bonus of USD {low},000 per year", "USD {low} - {high} bimonthly", "Weekly salary in London: £{low}",
    )
    told = F.transform(money.pay_ranges(F.col("said")), lambda x: F.concat(x["low"].cast("long").cast("string"), F.lit("-"), x["high"].cast("long").cast("string"), F.lit(" "), x["currency"], F.lit(" "), x["period"]))
    return rows.withColumn("said", said).select("l_orderkey", "l_linenumber", F.array_join(told, ", ").alias("told"))


@query("employer_categories", "SELECT o_orderkey, ['faang', 'faang', 'startup', 'startup', 'normal', 'normal'][CAST(o_orderkey % 6 AS INT) + 1] AS category FROM orders")
def employer_categories(spark: SparkSession, sf: str) -> DataFrame:
    name = _kind("o_orderkey", "Google LLC", "  META, Inc. ", "Notion Company, Inc.", "Sentry.io", "Googleplex {o_custkey}", "Customer {o_custkey} Inc.")
    return table(spark, sf, "orders").withColumn("name", name).select("o_orderkey", classify.employer_category(F.col("name")).alias("category"))
