"""Runs of words against a brute force over all stretches, and tables with odd rows."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import periodic

SF = "/root/testdata/sf0.001"


def plain_runs(words, exponent=4, least=6):
    """Every maximal stretch of each period, word by word; those whose smallest period is less are left out."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[k] == words[k + s] for k in range(i, i + length - s)) for s in range(1, q)) if length >= max(least, exponent * q) else True
            if not smaller:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha(b" ".join(kept)))


def test_scan_equals_brute_force():
    rng, met = random.Random(2), 0
    for turn in range(400):
        alphabet = rng.choice(("a", "ab", "abc", "abcdefgh"))
        words = [rng.choice(alphabet) for _ in range(rng.randrange(0, 60))]
        if turn % 2:
            unit = [rng.choice(alphabet) for _ in range(rng.randrange(1, 12))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 9)[: rng.randrange(1, 8 * len(unit) + 1)]
        ids, exponent, least = periodic.word_ids([w.encode() for w in words]), rng.choice((2, 3, 4, 5)), rng.choice((2, 6))
        want = plain_runs(words, exponent, least)
        met += len(want)
        assert periodic.smallest_periods(periodic.scan(ids, 1, len(ids) // exponent + 1, exponent, least)) == want
        for parts in (2, 3, 7):
            ranges = [periodic.lag_range(len(ids), k, parts, exponent) for k in range(parts)]
            assert ranges[0][0] == 1 and ranges[-1][1] == len(ids) // exponent + 1 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
            assert periodic.smallest_periods([x for r in ranges for x in periodic.scan(ids, *r, exponent, least)]) == want
    assert met > 500


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.size(F.split("text", " ")) < 900)
    odd = spark.createDataFrame(
        [(None, "x " * 7), (None, None), (-7, None), (9_000_001, ""), (9_000_002, " \t\n\x0b\x0c\r "), (9_000_003, "a b " * 5), (9_000_003, "a b " * 5), (9_000_003, "é é é é é é"), (9_000_004, "a a " * 6), *((9_100_000 + i, "one two three " * (i % 9)) for i in range(60))],
        "doc_id long, text string",
    )
    rows = docs.select("doc_id", "text").unionByName(odd)
    want = sorted((plain_row(*r) for r in rows.collect()), key=repr)
    assert sorted(map(tuple, periodic.run_digest(rows.withColumn("runs", F.lit(1)).withColumn("part", F.lit(2))).collect()), key=repr) == want
    assert sum(r[1] > 0 for r in want) > 20


def test_ranges_of_lags_give_equal_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(5))
    once = sorted(map(tuple, periodic.run_digest(docs).collect()))
    monkeypatch.setattr(periodic, "RANGE_BYTES", 300)
    assert sorted(map(tuple, periodic.run_digest(docs).collect())) == once


def test_own_columns_stay(spark):
    docs = spark.createDataFrame([(1, "go go go go go go now", "kept", 5)], "id long, body string, note string, runs int")
    got = periodic.find_runs(docs, text="body").first()
    assert (got.id, got.note, [tuple(r) for r in got.runs], got.collapsed) == (1, "kept", [(0, 6, 1)], "go now")
    assert periodic.find_runs(docs.limit(0), text="body").count() == 0


def test_very_long_text():
    rng = np.random.default_rng(1)
    ids = np.r_[rng.integers(0, 5000, 150_000), np.tile(rng.integers(0, 5000, 30_011), 5), rng.integers(0, 5000, 100_000)].astype(np.int32)
    runs = periodic.smallest_periods(periodic.scan(ids, 1, len(ids) // 4 + 1))
    assert [(q, k >= 5 * 30_011) for _, k, q in runs if q > 1] == [(30_011, True)]
