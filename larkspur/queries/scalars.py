"""Column functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.functions import classify, money, scores, text, time, url
from larkspur.session import table

RULES = [("mobile", r"^m\.", r"^/([a-z]+)/([0-9]+)"), ("web", r"^www\.", r"^/([a-z]+)/([0-9]+)"), ("plain", r"\.example\.", r"^/([a-z]+)/([0-9]+)")]


@query(
    "url_canonical",
    r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
    k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains(['fbclid', 'gclid', 'gh_src', 'mc_cid', 'mc_eid', 'ref', 'source'], lower(split_part(x, '=', 1))) AND NOT starts_with(lower(x), 'utm_'))), '&') AS k FROM p)
    SELECT page_id, scheme || '://' || host || path || CASE WHEN k <> '' THEN '?' || k ELSE '' END AS canonical, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, scheme = 'https' AND (host = 'example.com' OR host LIKE '%.example.com') AND NOT host LIKE 'm.%' AS admissible FROM k""",
)
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    allowed = url.admissible(u, ["example.com"], ["none.invalid"]) & ~url.host(u).startswith("m.")
    return table(spark, sf, "pages").select("page_id", url.canonical(u).alias("canonical"), url.registrable(url.host(u)).alias("domain"), allowed.alias("admissible"))


@query(
    "provider_rules",
    r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN NOT regexp_matches(path, '^/[a-z]+/[0-9]+') THEN 'unknown' WHEN starts_with(h, 'm.') THEN 'mobile' WHEN starts_with(h, 'www.') THEN 'web' WHEN h LIKE '%.example.%' THEN 'plain' ELSE 'unknown' END AS provider, CASE WHEN regexp_matches(path, '^/[a-z]+/[0-9]+') AND (starts_with(h, 'm.') OR starts_with(h, 'www.') OR h LIKE '%.example.%') THEN regexp_extract(path, '^/([a-z]+)/([0-9]+)', 2) END AS posting FROM p""",
)
def provider_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", url.provider(F.col("url"), RULES).alias("x")).select("page_id", "x.provider", "x.posting")


@query(
    "html_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS x FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)<(?:/p|/div|/li|/h[1-6]|br\s*/?|/tr)\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS x FROM b),
    d AS (SELECT page_id, trim(regexp_replace(regexp_replace(x, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS x FROM c) SELECT page_id, length(x) AS n, sha256(x) AS digest FROM d""",
)
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    x = text.html_to_text(F.col("html"))
    return table(spark, sf, "pages").select("page_id", x.alias("x")).select("page_id", F.char_length("x").alias("n"), F.sha2("x", 256).alias("digest"))


@query(
    "technical_score",
    """WITH h AS (SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), 'th[a-z]*'))) AS d, len(list_distinct(regexp_extract_all(lower(text), 'er[a-z]*on'))) AS s, len(list_distinct(regexp_extract_all(lower(text), 'token|licen[sc]e|copyright'))) AS b FROM documents)
    SELECT doc_id, (least(d, 3) * 3 + least(s, 6) - 2 * b)::INT AS score, least(d, 3) * 3 + least(s, 6) - 2 * b >= 4 AND s >= 2 AS technical FROM h""",
)
def technical_score(spark: SparkSession, sf: str) -> DataFrame:
    x = classify.technical(F.col("text"), "th[a-z]*", "er[a-z]*on", "token|licen[sc]e|copyright")
    return table(spark, sf, "documents").select("doc_id", x.alias("x")).select("doc_id", "x.score", "x.technical")


@query(
    "money_parse",
    """WITH p AS (SELECT p_partkey, p_size, p_retailprice FROM part), t AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size + 10.0 WHEN 1 THEN (p_size + 60) * 1000.0 WHEN 2 THEN p_size + 20.5 ELSE p_size * 1.0 END AS lo, CASE p_size % 4 WHEN 0 THEN p_size + 20.0 WHEN 1 THEN (p_size + 60) * 1000.0 WHEN 2 THEN p_size + 20.5 ELSE p_size * 1.0 END AS hi, CASE WHEN p_size % 4 = 1 THEN 'year' ELSE 'hour' END AS period, p_size FROM p)
    SELECT p_partkey, CASE WHEN lo >= 5 THEN lo END AS low, CASE WHEN lo >= 5 THEN hi END AS high, CASE WHEN lo >= 5 THEN period END AS period, CASE WHEN lo >= 5 THEN CASE period WHEN 'year' THEN round(hi / 2080, 4) ELSE hi END END AS hourly FROM t""",
)
def money_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Pay texts made of part sizes in four shapes, parsed back."""
    n = F.col("p_size")
    s = lambda x: x.cast("string")
    shown = (
        F.when(n % 4 == 0, F.concat(F.lit("pays $"), s(n + 10), F.lit(" - $"), s(n + 20), F.lit("/hr plus")))
        .when(n % 4 == 1, F.concat(F.lit("salary $"), s(n + 60), F.lit("k per year")))
        .when(n % 4 == 2, F.concat(F.lit("$"), s(n + 20), F.lit(".50 an hour")))
        .otherwise(F.concat(F.lit("from $"), s(n), F.lit(" on")))
    )
    return table(spark, sf, "part").select("p_partkey", money.pay(shown).alias("x")).select("p_partkey", "x.*")


@query(
    "company_keys",
    """WITH k AS (SELECT c_custkey, regexp_replace(array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(c_name || CASE c_custkey % 3 WHEN 0 THEN ' Inc. Ltd' WHEN 1 THEN ', GmbH' ELSE ' Co Works' END)), '[^a-z0-9]+'), lambda x: x <> ''), ' '), '( (inc|incorporated|llc|ltd|limited|corp|corporation|co|company|plc|gmbh))+$', '') AS k FROM customer) SELECT c_custkey, k AS company_key, sha256(k || '|x') AS fingerprint FROM k""",
)
def company_keys(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.when(F.col("c_custkey") % 3 == 0, " Inc. Ltd").when(F.col("c_custkey") % 3 == 1, ", GmbH").otherwise(" Co Works")
    keys = table(spark, sf, "customer").select("c_custkey", text.company_key(F.concat("c_name", suffix)).alias("company_key"))
    return keys.withColumn("fingerprint", text.fingerprint(F.col("company_key"), F.lit("x")))


@query(
    "redaction",
    r"""SELECT doc_id, sha256(left(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '[url]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[email]', 'g'), '(?i)\b(token|secret|key|password)\s*[=:]\s*"?[A-Za-z0-9_-]{8,}"?', '\1=[secret]', 'g'), 500)) AS digest FROM documents""",
)
def redaction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("digest"))


@query(
    "bounded_text",
    """WITH h AS (SELECT doc_id, text, left(text, 80) AS h FROM documents), a AS (SELECT *, length(h) - instr(reverse(h), ' ') AS at_blank FROM h) SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN instr(h, ' ') > 0 AND at_blank >= 52 THEN left(h, at_blank) ELSE h END AS cut FROM a""",
)
def bounded_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.bounded(F.col("text"), 80).alias("cut"))


@query(
    "title_similarity",
    """WITH p AS (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part) SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS similarity FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.5""",
)
def title_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similar names within a block of brand and size. Equal sets of terms count as one while they are compared; the pairs that pass are then opened up to their parts."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", text.title_terms(F.col("p_name")).alias("w"))
    kinds = p.groupBy("p_brand", "p_size", "w").agg(F.sort_array(F.collect_list("p_partkey")).alias("keys"))
    a, b = (kinds.select("p_brand", "p_size", F.col("w").alias(f"w{s}"), F.col("keys").alias(f"keys_{s}")) for s in "ab")
    met = a.join(b, ["p_brand", "p_size"]).where("wa <= wb").withColumn("similarity", F.round(scores.overlap(F.col("wa"), F.col("wb")), 6)).where("similarity >= 0.5")
    opened = met.select("wa", "wb", "keys_b", "similarity", F.explode("keys_a").alias("x")).select("wa", "wb", "similarity", "x", F.explode("keys_b").alias("y"))
    return opened.where("wa < wb OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


@query(
    "role_agreement",
    """WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM benchmark), r AS (SELECT b.item_id, count(DISTINCT t.w) / any_value(len(b.w)) AS ratio FROM b LEFT JOIN (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents WHERE lang = 'en') t ON list_contains(b.w, t.w) GROUP BY 1)
    SELECT item_id, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.75 THEN 'strong' WHEN ratio >= 0.4 THEN 'partial' ELSE 'weak' END AS agreement FROM r""",
)
def role_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each item's vocabulary English documents use. Documents are cut into tokens, and each distinct token is folded once."""
    item = table(spark, sf, "benchmark").select("item_id", text.title_terms(F.col("text")).alias("w"))
    tokens = table(spark, sf, "documents").where("lang = 'en'").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    used = tokens.select(F.explode(text.terms(F.col("token"))).alias("word")).distinct()
    found = item.select("item_id", F.size("w").alias("n"), F.explode("w").alias("t")).join(used, F.col("t") == F.col("word"), "left")
    ratio = found.groupBy("item_id").agg((F.count("word") / F.max("n")).alias("ratio"))
    return ratio.select("item_id", F.round("ratio", 6).alias("ratio"), scores.agreement(F.col("ratio"), F.lit(False)).alias("agreement"))


@query(
    "quiet_hours_next",
    """WITH l AS (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS t FROM events), m AS (SELECT *, hour(t) * 60 + minute(t) AS m FROM l)
    SELECT event_id, m >= 1320 OR m < 420 AS quiet, epoch(CASE WHEN m >= 1320 OR m < 420 THEN timezone('UTC', timezone('America/New_York', (t::DATE + CASE WHEN m >= 420 THEN 1 ELSE 0 END)::TIMESTAMP + INTERVAL 7 HOUR)) ELSE ts END)::BIGINT AS next_at FROM m""",
)
def quiet_hours_next(spark: SparkSession, sf: str) -> DataFrame:
    ts, zone = F.col("ts"), "America/New_York"
    quiet = time.is_quiet(time.minute_of_day(F.from_utc_timestamp(ts.cast("timestamp"), zone)), 1320, 420)
    rounded = F.bround(F.unix_micros(time.next_eligible(ts, zone, 1320, 420)) / 1_000_000).cast("long")  # half a second goes to the even one
    return table(spark, sf, "events").select("event_id", quiet.alias("quiet"), rounded.alias("next_at"))


@query("seasons", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CASE WHEN 2026 + user_id % 5 BETWEEN 2026 AND 2029 THEN 'summer-' || (2026 + user_id % 5)::VARCHAR END WHEN user_id % 3 = 1 THEN CASE WHEN 2026 + user_id % 5 BETWEEN 2026 AND 2029 THEN 'offseason-' || (2026 + user_id % 5)::VARCHAR END END AS season FROM events")
def seasons(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("user_id")
    year = (u % 5 + 2026).cast("string")
    shown = F.when(u % 3 == 0, F.concat(F.lit("Summer "), year, F.lit(" intern"))).when(u % 3 == 1, F.concat(F.lit("Fall or Winter "), year)).otherwise("Engineer")
    return table(spark, sf, "events").select("event_id", classify.season(shown, 2026).alias("season"))


@query("backoff", "SELECT event_id, least(1800, 60 * pow(2, user_id % 9))::BIGINT AS wait, epoch_ms(ts) // 1800000 AS slot FROM events")
def backoff(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", time.backoff_seconds(F.col("user_id") % 9 + 1).alias("wait"), time.due_slot(F.col("ts")).alias("slot"))
