"""Posting addresses of many providers, which pages write with their own hosts, paths and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalogue import query
from larkspur.functions import extract, providers, url
from larkspur.session import table

#: A reviewed employer's own host, on which a posting's number stands in the path and in a parameter.
REVIEWED = (("greenhouse", ".example.org", "/[a-z]{2}/(?<id>[0-9]+)", (("gh_jid*", r"\k<id>"),), "${host}"),)


@query(
    "provider_postings",
    r"""WITH p AS (SELECT page_id, url, page_id % 14 AS k, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/]+/([a-z]+)', 1) AS w, regexp_extract(url, '/([0-9]+)', 1) AS n, md5(url) AS m FROM pages),
    q AS (SELECT *, replace(h, '.', '-') AS t, left(m, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS u,
      lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || h || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS bare, regexp_extract(url, '\?([^#]*)', 1) AS s FROM p),
    v AS (SELECT *, h LIKE '%.example.org' AS reviewed, array_to_string(list_sort(list_filter(string_split(s, '&'), lambda x: x <> '' AND NOT list_contains(['fbclid', 'gclid', 'gh_src', 'mc_cid', 'mc_eid', 'ref', 'source'], lower(split_part(x, '=', 1))) AND NOT starts_with(lower(x), 'utm_'))), '&') AS kept FROM q),
    r AS (SELECT page_id, CASE WHEN k <= 1 THEN 'greenhouse' WHEN k = 2 THEN 'lever' WHEN k = 3 THEN 'ashby' WHEN k = 4 THEN 'workday' WHEN k = 5 THEN 'icims' WHEN k = 6 THEN 'oracle' WHEN k = 7 THEN 'taleo' WHEN k = 8 THEN 'successfactors'
        WHEN k = 9 AND reviewed THEN 'greenhouse' WHEN k = 12 THEN 'brassring' ELSE 'unknown' END AS provider,
      CASE WHEN k IN (0, 1, 2, 3, 4, 8) THEN t WHEN k = 5 THEN 'careers-' || t WHEN k = 6 THEN t || '.fa.oraclecloud.com/' || w WHEN k = 7 THEN t || '.taleo.net/' || w WHEN k = 9 AND reviewed THEN CASE WHEN starts_with(h, 'www.') THEN substr(h, 5) ELSE h END WHEN k = 12 THEN n || '-7' END AS tenant,
      CASE WHEN k IN (0, 1, 5, 6, 7, 8, 12) OR k = 9 AND reviewed THEN n WHEN k IN (2, 3) THEN u WHEN k = 4 THEN 'r' || n END AS posting,
      CASE k WHEN 0 THEN 'https://job-boards.greenhouse.io/' || t || '/jobs/' || n WHEN 1 THEN 'https://job-boards.greenhouse.io/' || t || '/jobs/' || n WHEN 2 THEN 'https://jobs.lever.co/' || upper(t) || '/' || upper(u) || '/apply' WHEN 3 THEN 'https://jobs.ashbyhq.com/' || t || '/' || u
        WHEN 4 THEN 'https://' || t || '.wd5.myworkdayjobs.com/' || w || '/careers/job/x_R' || n WHEN 5 THEN 'https://careers-' || t || '.icims.com/jobs/' || n || '/intern/job' WHEN 6 THEN 'https://' || t || '.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/' || w || '/job/' || n
        WHEN 7 THEN 'https://' || t || '.taleo.net/careersection/' || w || '/jobdetail.ftl?job=' || n WHEN 8 THEN 'https://career4.successfactors.com/careers?career_job_req_id=' || n || '&career_ns=JOB_LISTING&company=' || t WHEN 9 THEN 'https://' || h || '/' || w || '/' || n || '?gh_jid=' || n
        WHEN 10 THEN 'https://jobs.lever.co/' || t || '/' || n WHEN 11 THEN 'https://' || h || '/' || w || '/' || n || '?gh_jid=' || n || '0' WHEN 12 THEN 'https://sjobs.brassring.com/TGnewUI/search/home/HomeWithPreLoad?jobid=' || n || '&partnerid=' || n || '&siteid=7' ELSE bare || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM v)
    SELECT *, left(sha256('posting-v1:' || CASE WHEN provider = 'unknown' THEN 'url:' || canonical ELSE 'provider:' || provider || ':' || tenant || ':' || posting END), 32) AS id FROM r""",
)
def provider_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Provider, tenant, posting, canonical address and stable id of the address that a page's kind writes."""
    u = F.col("url")
    number, digest = F.regexp_extract(url.path(u), "/([0-9]+)", 1), F.md5(u)
    uuid = F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    rows = table(spark, sf, "pages").select("page_id", "url", url.host(u).alias("h"), F.regexp_extract(url.path(u), "^/([a-z]+)", 1).alias("w"), number.alias("n"), uuid.alias("u"))
    rows = rows.withColumn("t", F.replace("h", F.lit("."), F.lit("-")))
    written = {
        0: "'https://boards.greenhouse.io/' || upper(t) || '/jobs/' || n || '?gh_jid=' || n || '&utm_source=feed'", 1: "'https://Job-Boards.greenhouse.io/' || t || '?gh_jid=' || n || '&gh_src=x#app'", 2: "'https://jobs.lever.co/' || upper(t) || '/' || upper(u) || '/apply/'",
        3: "'https://jobs.ashbyhq.com/' || t || '/' || upper(u) || '/Application?embed=1'", 4: "'https://' || t || '.wd5.myworkdayjobs.com/' || w || '/careers/job/x_R' || n", 5: "'https://careers-' || t || '.icims.com/jobs/' || n || '/intern/job'",
        6: "'https://' || t || '.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/' || w || '/job/' || n", 7: "'https://' || t || '.taleo.net/careersection/' || w || '/jobdetail.ftl?job=' || n || '&ref=x'", 8: "'https://career4.successfactors.com/careers?company=' || t || '&career_ns=JOB_LISTING&career_job_req_id=' || n",
        9: "'https://' || h || '/' || w || '/' || n || '?gh_jid=' || n", 10: "'https://jobs.lever.co/' || t || '/' || n", 11: "'https://' || h || '/' || w || '/' || n || '?gh_jid=' || n || '0'", 12: "'https://sjobs.brassring.com/TGnewUI/search/home/HomeWithPreLoad?partnerid=' || n || '&siteid=7&jobid=' || n",
    }
    address = F.expr("CASE pmod(page_id, 14) " + " ".join(f"WHEN {k} THEN {x}" for k, x in written.items()) + " ELSE url END")
    met = providers.with_references(rows.select("page_id", address.alias("address")), "address", (*REVIEWED, *providers.ROUTES)).select("page_id", "reference.*")
    return met.withColumn("id", extract.stable_id(F.col("provider"), F.col("tenant"), F.col("posting"), F.col("canonical")))
