"""Canonical addresses, hosts, registrable domains, provider rules, admissibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and second-level labels under which domains are registered.
TRACKING = ("fbclid", "gclid", "gh_src", "mc_cid", "mc_eid", "ref", "source")
SECOND_LEVEL = (
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk nhs.uk org.uk plc.uk sch.uk com.au edu.au gov.au net.au org.au "
    "co.nz govt.nz net.nz org.nz co.za net.za org.za ac.jp co.jp go.jp ne.jp or.jp co.kr or.kr "
    "co.in firm.in gen.in net.in org.in com.br net.br org.br com.mx com.sg com.cn com.tr com.hk com.tw "
    "co.il org.il ac.il co.id or.id ac.id go.id co.th or.th ac.th go.th com.my com.ph com.vn com.pk com.eg com.sa "
    "com.ua com.ar com.co com.pe com.ec com.uy com.ve com.ng com.gh co.ke co.ug co.zw"
).split()


def _part(url: Column, part: str) -> Column:
    return F.call_function("try_parse_url", url, F.lit(part))


def host(url: Column) -> Column:
    return F.lower(_part(url, "HOST"))


def path(url: Column) -> Column:
    return _part(url, "PATH")


def _pairs(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(_part(url, "QUERY"), F.lit("")), "&"), lambda p: p != "")


def _name(pair: Column) -> Column:
    return F.split_part(pair, F.lit("="), F.lit(1))


def parameters(url: Column) -> Column:
    """The query's parameters in order, decoded: an array of struct<name, value>."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(_pairs(url), lambda p: F.struct(decoded(_name(p)).alias("name"), decoded(F.substring(p, F.length(_name(p)) + 2, F.length(p))).alias("value")))


def _selecting(url: Column) -> Column:
    """The parameters that don't only track, sorted by name; those of one name keep their order."""
    kept = F.filter(_pairs(url), lambda p: ~F.lower(_name(p)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    return F.transform(F.array_sort(F.transform(kept, lambda p, i: F.struct(_name(p).alias("name"), i.alias("i"), p.alias("p")))), lambda x: x["p"])


def _written(scheme: Column, name: Column, path: Column, pairs: Column) -> Column:
    return F.concat(scheme, F.lit("://"), name, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))


def _scheme_and_host(url: Column) -> tuple[Column, Column]:
    """Both in lower case, the host with its port unless it is the scheme's own."""
    scheme, port = F.lower(_part(url, "PROTOCOL")), F.regexp_extract(_part(url, "AUTHORITY"), r":([0-9]+)$", 1)
    own = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return scheme, F.concat(host(url), F.when(own, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, the others sorted, no slash at the end; null if it isn't an address."""
    scheme, name = _scheme_and_host(url)
    return F.when(host(url).isNotNull(), _written(scheme, name, F.regexp_replace(F.coalesce(path(url), F.lit("")), "/+$", ""), _selecting(url)))


def posting_canonical(url: Column) -> Column:
    """As `canonical`, only for http and https, and with one form for the ways in which two providers present a posting.

    A posting of a Greenhouse board, in its path or as a parameter, is /board/jobs/id on one host; one of an Ashby
    board is /board/id, without the step of its application form and the mark of embedding.
    """
    scheme, name = _scheme_and_host(url)
    bare, steps = F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(F.coalesce(path(url), F.lit("")), "/+$", "")
    pairs, ids = _selecting(url), F.transform(F.filter(parameters(url), lambda p: p["name"] == "gh_jid"), lambda p: p["value"])
    first, board = F.get(ids, 0), F.lower(F.regexp_extract(steps, "^/([^/]+)", 1))
    without = lambda parameter: F.filter(pairs, lambda p: _name(p) != parameter)
    greenhouse = F.lit("job-boards.greenhouse.io")
    listed = bare.isin("boards.greenhouse.io", "job-boards.greenhouse.io", "job-boards.eu.greenhouse.io") & F.regexp_like(steps, F.lit("(?i)^/[^/]+/jobs/[0-9]+$"))
    asked = bare.isin("boards.greenhouse.io", "job-boards.greenhouse.io") & F.coalesce(F.regexp_like(first, F.lit("^[0-9]+$")), F.lit(False)) & F.regexp_like(steps, F.lit("^/[^/]+$"))
    applied = (bare == "jobs.ashbyhq.com") & F.regexp_like(steps, F.lit("(?i)^/[^/]+/[^/]+(?:/application)?$"))
    number = F.substring_index(steps, "/", -1)
    form = (
        F.when(applied, _written(scheme, name, F.lower(F.regexp_extract(steps, "^/[^/]+/[^/]+", 0)), without("embed")))
        .when(listed, _written(scheme, greenhouse, F.concat(F.lit("/"), board, F.lit("/jobs/"), number), F.when(first == number, without("gh_jid")).otherwise(pairs)))
        .when(asked, _written(scheme, greenhouse, F.concat(F.lit("/"), board, F.lit("/jobs/"), first), without("gh_jid")))
        .otherwise(_written(scheme, name, steps, pairs))
    )
    return F.when(host(url).isNotNull() & scheme.isin("http", "https"), form)


def registrable(name: Column) -> Column:
    """The last two labels of a host, three under a second-level registry; numbers of machines and single labels stay as they are."""
    whole = F.regexp_replace(F.lower(F.trim(name)), r"\.$", "")
    last = F.when(F.substring_index(whole, ".", -2).isin(*SECOND_LEVEL), F.substring_index(whole, ".", -3)).otherwise(F.substring_index(whole, ".", -2))
    return F.when(F.contains(whole, F.lit(":")) | F.regexp_like(whole, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")), whole).otherwise(last)


def same_registrable(a: Column, b: Column) -> Column:
    """Whether two hosts belong to one registered domain; single labels and nulls never do."""
    return F.coalesce(F.contains(registrable(a), F.lit(".")) & (registrable(a) == registrable(b)), F.lit(False))


def admissible(url: Column, allowed: list[str], denied: list[str]) -> Column:
    """https only; a denied host or a host under it never; an allowed host or a host under one."""
    under = lambda hosts: reduce(lambda a, b: a | b, [(host(url) == h) | F.endswith(host(url), F.lit("." + h)) for h in hosts], F.lit(False))
    return F.coalesce((F.lower(_part(url, "PROTOCOL")) == "https") & under(allowed) & ~under(denied), F.lit(False))


def provider(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<provider, tenant, posting> by the first rule (name, host pattern, path pattern with two groups) that fits; else `unknown`."""
    path = F.coalesce(_part(url, "PATH"), F.lit(""))
    found = F.when(F.lit(False), F.lit(None).cast("struct<provider:string,tenant:string,posting:string>"))
    for name, hosts, paths in rules:
        fits = host(url).rlike(hosts) & path.rlike(paths)
        found = found.when(fits, F.struct(F.lit(name).alias("provider"), F.regexp_extract(path, paths, 1).alias("tenant"), F.regexp_extract(path, paths, 2).alias("posting")))
    return found.otherwise(F.struct(F.lit("unknown").alias("provider"), F.lit(None).cast("string").alias("tenant"), F.lit(None).cast("string").alias("posting")))
