"""Posting addresses: their provider, tenant and posting id by a table of routes.

A route is (provider, hosts, path, needs, tenant). Hosts are separated by spaces; one that begins with a dot
stands for every host below it. The path is a pattern without regard to case, in which the group `id` is the
posting and the group `t` may be the tenant. `needs` are (parameter, pattern) pairs whose patterns must fit too and
may hold those groups or refer to them; an absent parameter counts as empty. Of a repeated parameter the first
value counts; of one written with a star all must agree. The tenant is a text with ${t}, ${host}, ${sub} (what
stands before the route's host) or ${label} (the first label) in it.

Rows meet their routes by joins on the host and on its last labels, so that no pattern is tried on an address
whose host has no route.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import url as addresses

Route = tuple[str, str, str, Sequence[tuple[str, str]], str]
#: Routes are broadcast; more of them than this raise.
MOST_ROUTES = 20_000

_UUID = "[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
_LISTED = (("career_ns", "job_listing"), ("company", "(?<t>[a-z0-9-]+)"), ("career_job_req_id", "(?<id>[0-9]+)"))

# Hosts, paths and scopes of the reviewed providers.
ROUTES: tuple[Route, ...] = (
    ("greenhouse", "job-boards.greenhouse.io boards.greenhouse.io job-boards.eu.greenhouse.io", "/(?<t>[^/]+)/jobs/(?<id>[0-9]+)", (), "${t}"),
    ("greenhouse", "job-boards.greenhouse.io boards.greenhouse.io", "/(?<t>[^/]+)", (("gh_jid", "(?<id>[0-9]+)"),), "${t}"),
    ("lever", "jobs.lever.co jobs.eu.lever.co", f"/(?<t>[^/]+)/(?<id>{_UUID})(?:/apply)?", (), "${t}"),
    ("ashby", "jobs.ashbyhq.com", f"/(?<t>[^/]+)/(?<id>{_UUID})(?:/application)?", (), "${t}"),
    ("ashby", "shopify.com", f"/careers/[^/]*_(?<id>{_UUID})", (("ashby_jid", r"(?:\k<id>)?"),), "shopify"),
    ("bytedance", "lifeattiktok.com joinbytedance.com", "/(?:search|position)/(?<id>[0-9]+)(?:/detail)?", (), "bytedance"),
    ("bytedance", "jobs.bytedance.com", "/[a-z-]+/position/(?<id>[0-9]+)(?:/detail)?", (), "bytedance"),
    ("bytedance", "lifeattiktok.com", "/referral/[^/]+/campus/position/(?<id>[0-9]+)/detail", (), "bytedance"),
    ("workday", ".myworkdayjobs.com", ".*_(?<id>[^/_]+)", (), "${label}"),
    ("workday", ".myworkdaysite.com", "(?:/[a-z]{2}-[a-z]{2})?/recruiting/(?<t>[^/]+/[^/]+)/job/.+_(?<id>[^/_]+)", (), "${host}/${t}"),
    ("workday", ".myworkdaysite.com", "/(?<t>[^/]+)/job/.+_(?<id>[^/_]+)", (), "${host}/${t}"),
    ("tesla", "tesla.com", "(?:/[a-z]{2}(?:_[a-z]{2})?)?/careers/search/job/(?:[^/]*-)?(?<id>[0-9]+)", (), "tesla"),
    ("meta", "metacareers.com", "/(?:jobs|profile/job_details)/(?<id>[0-9]+)", (), "meta"),
    ("janestreet", "janestreet.com", "/join-jane-street/(?:position|apply)/(?<id>[0-9]+)", (), "janestreet"),
    ("goldman-sachs", "higher.gs.com", "/roles/(?<id>[0-9]+)", (), "goldman-sachs"),
    ("imc", "imc.com", "/[a-z]{2}/careers/jobs/(?<id>[0-9]+)", (), "imc"),
    ("smartrecruiters", "jobs.smartrecruiters.com", "/(?<t>[^/]+)/(?<id>[0-9]+)(?:-[^/]+)?", (), "${t}"),
    ("icims", ".icims.com", "/jobs/(?<id>[0-9]+)(?:/[^/]*)?/(?:job|login)", (), "${sub}"),
    ("oracle", ".oraclecloud.com", "/hcmUI/CandidateExperience/[a-z]{2}/sites/(?<t>[^/]+)/job/(?<id>[0-9]+)", (), "${host}/${t}"),
    ("successfactors", "jobs.successfactors.com", "/job/[^/]+/[^/]+/(?<id>[0-9]+)", (), "${host}"),
    ("successfactors", ".successfactors.com", "/careers", _LISTED, "${t}"),
    ("successfactors", ".sapsf.com", "/career", _LISTED, "${t}"),
    ("workable", "apply.workable.com", "/(?<t>[a-z0-9-]+)/j/(?<id>[a-f0-9]{10})(?:/apply)?", (), "${t}"),
    ("microsoft", "jobs.careers.microsoft.com careers.microsoft.com", "/(?:v2/)?(?:global/)?[a-z]{2}(?:-[a-z]{2})?/job/(?<id>[0-9]+)", (), "microsoft"),
    ("microsoft", "apply.careers.microsoft.com", "/careers/job/(?<id>[0-9]+)", (), "microsoft"),
    ("rippling", "ats.rippling.com", f"/(?:[a-z]{{2}}-[a-z]{{2}}/)?(?<t>[a-z0-9-]+)/jobs/(?<id>{_UUID})", (), "${t}"),
    ("eightfold", ".eightfold.ai", "/careers/job/(?<id>[a-z0-9-]+)", (), "${host}"),
    ("paylocity", "recruiting.paylocity.com", "/recruiting/jobs/Details/(?<id>[0-9]+)(?:/[a-z0-9-]+)?", (), "${host}"),
    ("jobvite", "jobs.jobvite.com", "/(?<t>[a-z0-9-]+)/job/(?<id>[a-z0-9]+)", (), "${t}"),
    ("amazon", "amazon.jobs", "/(?:[a-z]{2}(?:-[a-z]{2})?/)?jobs/(?<id>[0-9]+)(?:/[^/]+)?", (), "amazon"),
    ("google", "google.com", "/about/careers/applications/jobs/results/(?<id>[0-9]+)(?:-[^/]*)?", (), "google"),
    ("taleo", ".taleo.net", "/careersection/(?<t>[a-z0-9_-]+)/jobdetail[.]ftl", (("job", "(?<id>[a-z0-9_-]+)"),), "${host}/${t}"),
    ("united", "careers.united.com", "/us/en/job/(?<id>[a-z0-9_-]+)", (), "united"),
    ("sig", "careers.sig.com", "(?:/[^/]+)?/jobs/(?<id>[0-9]+)", (), "sig"),
    ("icims", "careers.rivianvw.tech", "/(?<t>[a-z0-9-]+)/jobs/(?<id>[0-9]+)/job", (), "${t}"),
    ("intuit", "jobs.intuit.com", "/job/[^/]+/[^/]+/[0-9]+/(?<id>[0-9]+)", (), "intuit"),
    ("apple", "jobs.apple.com", "/[a-z]{2}-[a-z]{2}/details/(?<id>[0-9]+)(?:-[0-9]+)?(?:/[^/]+)?", (), "apple"),
    ("bamboohr", ".bamboohr.com", "/careers/(?<id>[0-9]+)", (), "${sub}"),
    ("adp", "workforcenow.adp.com", "/mascsr/default/mdf/recruitment/recruitment[.]html", (("cid", "(?<t>[a-f0-9-]{36})"), ("jobId", "(?<id>[0-9]+)")), "${t}"),
    ("recsolu", "db.recsolu.com", "/external/requisitions/(?<id>[a-z0-9_-]+)", (), "deutsche-bank"),
    ("deshaw", "deshaw.com", "/careers/(?:[^/]*-)?(?<id>[0-9]+)", (), "deshaw"),
    ("yello", ".yello.co", "/jobs/(?<id>[a-z0-9_-]+)", (), "${host}"),
    ("avature", ".avature.net", "/[a-z]{2}_[a-z]{2}/jobs/jobdetail/(?<id>[0-9]+)", (), "${host}"),
    ("avature", ".avature.net", "(?:/[a-z]{2}_[a-z]{2})?/careers/jobdetail/(?<id>[0-9]+)", (), "${host}"),
    ("avature", "apply.deloitte.com", "/[a-z]{2}_[a-z]{2}/careers/jobdetail/[^/]+/(?<id>[0-9]+)", (), "deloitte"),
    ("avature", "jobs.ea.com", "/[a-z]{2}_[a-z]{2}/careers/jobdetail/[^/]+/(?<id>[0-9]+)", (), "electronic-arts"),
    ("employer-career", "career.mlp.com", "/careers/job/(?<id>[0-9]+)", (), "${host}"),
    ("employer-career", "careers.itw.com", "/global/en/job/(?<id>[a-z0-9-]+)", (), "${host}"),
    ("employer-career", "careers.tranetechnologies.com", "/global/en/job/(?<id>[a-z0-9-]+)(?:/[^/]+)?", (), "${host}"),
    ("employer-career", "careers.snowflake.com", "/[a-z]{2}/en/job/(?<id>[a-z0-9]+)(?:/[^/]+)?", (), "${host}"),
    ("employer-career", "explore.jobs.netflix.net", "/careers/job/(?<id>[0-9]+)", (), "${host}"),
    ("employer-career", "careers.appian.com", "/jobs/(?<id>[0-9]+)(?:-[^/]+)?", (), "${host}"),
    ("employer-career", "careers.fiserv.com", "/[a-z]{2}/en/job/(?<id>[a-z0-9]+)(?:/[^/]+)?", (), "${host}"),
    ("employer-career", "careers.cisco.com", "/global/en/job/(?<id>[0-9]+)", (), "${host}"),
    ("employer-career", "careers.conehealth.com", "/[a-z]{2}/en/job/(?<id>[a-z0-9-]+)", (), "${host}"),
    ("employer-career", "careers.qualcomm.com", "/careers/job/(?<id>[0-9]+)", (), "${host}"),
    ("employer-career", "capitalonecareers.com", "/job/[^/]+/[^/]+/[0-9]+/(?<id>[0-9]+)", (), "${host}"),
    ("employer-career", "jobs.ascension.org", "/[a-z]{2}/en/job/(?<id>[0-9]+)", (), "${host}"),
    ("employer-career", "flowtraders.com", "/careers/job-description/(?<id>[0-9]+)", (), "${host}"),
    ("employer-career", "careers.point72.com", "/CSJobDetail", (("jobCode", "(?<id>[a-z]+-[0-9]+)"),), "point72"),
    ("pinpoint", ".pinpointhq.com", f"/[a-z]{{2}}/postings/(?<id>{_UUID})", (), "${sub}"),
    ("applytojob", ".applytojob.com", "/apply/(?<id>[a-z0-9]+)(?:/[^/]+)?", (), "${sub}"),
    ("breezy", ".breezy.hr", "/p/(?<id>[a-f0-9]{12})(?:-[^/]+)?", (), "${sub}"),
    ("gusto", "jobs.gusto.com", f"/postings/[^/]*-(?<id>{_UUID})", (), "gusto"),
    ("hrmdirect", ".hrmdirect.com", "/employment/job-opening[.]php", (("req", "(?<id>[0-9]+)"),), "${sub}"),
    ("brassring", "sjobs.brassring.com", ".*/search/home/homewithpreload", (("partnerid", "(?<t>[0-9]+)"), ("siteid", "(?<u>[0-9]+)"), ("jobid", "(?<id>[0-9]+)")), "${t}-${u}"),
    ("hiringthing", ".hiringthing.com", "/job/(?<id>[0-9]+)(?:/[^/]+)?", (), "${sub}"),
)

_RULE = "array<struct<provider:string,pattern:string,needs:array<string>,tenant:string>>"


def presentation(host: str, tenant: str, path: str, form: str, provider: str = "greenhouse", also: str | None = None) -> Route:
    """The route of a posting shown on an employer's own host.

    The id stands in the parameter gh_jid (form `query`), in the path with an equal or absent parameter (`path`),
    or in both (`both`); `also` names another parameter that must hold it.
    """
    needs = {"query": [("gh_jid*", "(?<id>[0-9]+)")], "path": [("gh_jid", r"(?:\k<id>)?")], "both": [("gh_jid*", r"\k<id>")]}[form]
    return provider, host, path, (*needs, *([(also, r"\k<id>")] if also else ())), tenant


def _by_host(routes: Sequence[Route]) -> dict[str, list[tuple[str, str, list[str], str]]]:
    """Each host's rules in order; a rule's pattern is of the host, the path and one line for each needed parameter."""
    if len(routes) > MOST_ROUTES:
        raise ValueError(f"{len(routes)} routes, more than {MOST_ROUTES} that may be broadcast")
    found: dict[str, list[tuple[str, str, list[str], str]]] = {}
    for provider, hosts, path, needs, tenant in routes:
        for host in hosts.split():
            quoted = re.escape(host)
            at = rf"(?<host>(?<sub>(?<label>[^./]+)[^/]*){quoted})" if host.startswith(".") else rf"(?<host>{quoted})"
            lines = "".join(f"\n(?:{pattern})" for _, pattern in needs)
            found.setdefault(host, []).append((provider, f"(?i)^{at}{path}{lines}$", [name for name, _ in needs], tenant))
    return found


def _subject(host: Column, path: Column, parameters: Column, needs: Column) -> Column:
    def value(need: Column) -> Column:
        name = F.rtrim(need, F.lit("*"))
        values = F.transform(F.filter(parameters, lambda p: p["name"] == name), lambda p: p["value"])
        return F.coalesce(F.when(need.endswith("*"), F.array_join(F.array_distinct(values), ",")).otherwise(F.get(values, 0)), F.lit(""))

    return F.concat(host, path, F.array_join(F.transform(needs, lambda n: F.concat(F.lit("\n"), value(n))), ""))


def with_references(rows: DataFrame, address: str = "url", routes: Sequence[Route] = ROUTES, into: str = "reference") -> DataFrame:
    """Rows with struct<provider, tenant, posting, canonical>, lower case; provider `unknown` and no ids where no route fits.

    A host's own routes come before those of the hosts above it, the nearest first, and of several the first that
    fits. Put an employer's own presentations in front of ROUTES. What isn't an address has a null canonical form.
    """
    spark, by_host = rows.sparkSession, _by_host(routes)
    canon = addresses.posting_canonical(F.col(address))
    out = rows.withColumn("_canonical", canon).withColumn("_host", F.regexp_replace(addresses.host(F.col("_canonical")), r"^www\.", ""))
    own = {h: r for h, r in by_host.items() if not h.startswith(".")}
    depths = sorted({h.count(".") for h in by_host if h.startswith(".")}, reverse=True)
    levels = [(F.col("_host"), own, "_rules")]
    for depth in depths:
        # A host below one of n labels has more than n itself.
        end = F.when(F.size(F.split("_host", r"\.")) > depth, F.substring_index("_host", ".", -depth))
        levels.append((end, {h[1:]: r for h, r in by_host.items() if h.startswith(".") and h.count(".") == depth}, f"_rules{depth}"))
    for key, rules, column in levels:
        known = spark.createDataFrame(list(rules.items()), f"_of string, {column} {_RULE}")
        out = out.join(F.broadcast(known), key == F.col("_of"), "left").drop("_of")
    rules = F.concat(*[F.coalesce(F.col(column), F.array().cast(_RULE)) for _, _, column in levels])
    path, parameters = F.coalesce(addresses.path(F.col("_canonical")), F.lit("")), addresses.parameters(F.col("_canonical"))
    said = lambda rule: _subject(F.col("_host"), path, parameters, rule["needs"])
    rule = F.get(F.filter(rules, lambda r: F.regexp_like(said(r), r["pattern"])), F.lit(0))
    out = out.withColumn("_rule", F.when(F.size(rules) > 0, rule))
    part = lambda template: F.lower(F.regexp_replace(said(F.col("_rule")), F.col("_rule.pattern"), template))
    met = F.struct(
        F.coalesce("_rule.provider", F.lit("unknown")).alias("provider"), part(F.col("_rule.tenant")).alias("tenant"), part(F.lit("${id}")).alias("posting"), F.col("_canonical").alias("canonical")
    )
    return out.withColumn(into, met).drop("_canonical", "_host", "_rule", *[column for _, _, column in levels])
