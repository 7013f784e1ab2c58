"""Merging of duplicates against a union-find."""

import random

import parity
import pytest
from pyspark.sql import functions as F

from larkspur import catalogue
from larkspur.plans import delivery, repair


@pytest.mark.parametrize("name", ["merged_jobs", "moved_receipts"])
def test_queries(spark, name):
    assert parity.compare(spark, catalogue.QUERIES[name], catalogue.ORACLE[name], "/root/testdata/sf0.001") == ""


def union_find(pairs, ids):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    chain, hub = [(i, i + 1) for i in range(1000, 1200)], [(5000, 5000 + i) for i in range(1, 800)]
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + chain + hub + [(7, 7)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    want = union_find(edges, {i for e in edges for i in e})
    got = {r.id: r.component for r in repair.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and all(c == i for i, c in want.items() if i not in got)
    assert repair.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_members_are_one_hop(spark):
    rng = random.Random(6)
    jobs = [(i, rng.randrange(5)) for i in range(300)]
    claims = [(rng.randrange(310), f"c{rng.randrange(250)}") for _ in range(300)] + [(i, None) for i in range(300)] + [(i, "shared by many") for i in range(40)]
    by_claim = {}
    for j, c in claims:
        if c and j < 300:
            by_claim.setdefault(c, []).append(j)
    roots = union_find([(js[0], j) for js in by_claim.values() for j in js], range(300))
    groups = {}
    for j, seen in jobs:
        groups.setdefault(roots[j], []).append((seen, j))
    want = {j: min(groups[roots[j]])[1] for j, _ in jobs}
    table = spark.createDataFrame(jobs, "job long, seen int")
    placed = repair.members(table, spark.createDataFrame(claims, "job long, claim string"), "job", "claim", [F.col("seen")])
    assert {r.job: r.canonical for r in placed.collect()} == want
    aliases = repair.alias_rows(placed, "job")
    stays = placed.select("canonical").distinct()
    assert {r.verdict for r in delivery.alias_verdict(aliases, stays, "old", "canonical", "canonical").collect()} == {"ok"}


def test_ranks_and_ties(spark):
    placed = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "job long, canonical long")
    apps = [(1, "u", "applied", 5), (2, "u", "offer", 1), (1, "v", "rejected", 1), (2, "v", "withdrawn", 9), (3, "u", None, 1), (77, "u", "saved", 1), (2, "w", "unheard", 1)]
    got = repair.moved(spark.createDataFrame(apps, "job long, user string, status string, at int"), placed, "job", "user", repair.rank(F.col("status"), repair.APPLICATIONS, -1), [F.col("at")])
    assert sorted((r.job, r.user, r.status) for r in got.collect() if r.status) == [(1, "u", "offer"), (1, "v", "withdrawn"), (1, "w", "unheard"), (77, "u", "saved")]
    jobs = spark.createDataFrame([(1, False, None, 1, 2, None, None, True), (2, True, True, 0, 9, 5.0, 4, True), (3, False, False, 1, 1, None, None, True)], "job long, open boolean, flag boolean, first_seen int, last_seen int, pay double, sent_at int, pending boolean")
    assert sorted(map(tuple, repair.merge_jobs(jobs, placed, "job").collect())) == [(1, 2, True, True, 0, 9, 5.0, 4, False), (3, 1, False, False, 1, 1, None, None, True)]
