"""Periodic runs of words: stretches that repeat with a fixed period, found by an all-lag scan.

A text's words become numbers, and the array of numbers is compared with itself shifted by every lag up to
n / min_exponent; true stretches of a comparison, by run length, are the runs of that lag. Lags beyond the
square root of n are compared at every lag-th word first, all lags of a range at once: a run holds
min_exponent - 1 such places in a row, so a lag that has none can't have a run, and only the others are
compared in full. Long texts are dealt out over the machines as ranges of lags.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, hinted, materialize, text_digest, text_or_empty

#: A run has at least so many words, and so many times its period.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Bytes of a text that one task scans for all lags; a text of k times as many is dealt out as sqrt(k) ranges of lags.
RANGE_BYTES = 64 << 10
_SPACES = "[\\x20\\x09-\\x0D]+"


def words_of(text: str) -> list[bytes]:
    """Words are split at the six ASCII spaces, which is how bytes split."""
    return text.encode("utf-8", "surrogatepass").split()


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))


def lag_range(n: int, part: int, parts: int, exponent: int = MIN_EXPONENT) -> tuple[int, int]:
    """The lags from..before of one of `parts` ranges; lower ones are narrower, as their lags take longer."""
    most = n // exponent
    return 1 + most * part**2 // parts**2, 1 + most * (part + 1) ** 2 // parts**2


def _in_full(ids: np.ndarray, lag: int, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """start, length and lag of the stretches that keep this lag and are long enough."""
    same = ids[lag:] == ids[:-lag]
    need = max(least, exponent * lag) - lag
    if np.count_nonzero(same) < need:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    return [(int(s), int(k) + lag, lag) for s, k in zip(starts[lengths >= need], lengths[lengths >= need], strict=True)]


def _possible(ids: np.ndarray, lags: np.ndarray, exponent: int) -> np.ndarray:
    """Those of the lags (rising) of which exponent - 1 places in a row, a lag apart, are equal a lag further on."""
    streak, passed = np.zeros(len(lags), np.int32), np.zeros(len(lags), bool)
    before = np.full(len(lags), ids[0] if len(ids) else 0)
    for k in range(1, (len(ids) - 1) // int(lags[0]) + 1 if len(lags) else 1):
        m = int(np.searchsorted(lags, (len(ids) - 1) // k, "right"))
        now = ids[k * lags[:m]]
        streak[:m] = (streak[:m] + 1) * (now == before[:m])
        passed[:m] |= streak[:m] >= exponent - 1
        before = now
    return lags[passed]


def scan(ids: np.ndarray, lo: int, hi: int, exponent: int = MIN_EXPONENT, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, lag) of every long enough stretch of the lags from lo up to hi; also of multiples of a run's period."""
    root = isqrt(len(ids))
    lags = [*range(lo, min(hi, root + 1)), *_possible(ids, np.arange(max(lo, root + 1), hi), exponent).tolist()]
    return [x for lag in lags for x in _in_full(ids, lag, exponent, least)]


def smallest_periods(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs by start, then period. A stretch found with several lags has the least of them as its period: the others are multiples of it."""
    least: dict[tuple[int, int], int] = {}
    for start, length, lag in found:
        least[start, length] = min(lag, least.get((start, length), lag))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by one space, without those that a run holds after its first period."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _stretches(docs: DataFrame, exponent: int, least: int) -> DataFrame:
    """t1, t2, found: the stretches of each distinct text, of which every range of lags is a row of its own in another task."""

    @F.pandas_udf("starts array<long>, lengths array<long>, lags array<long>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, part, parts in batches:
            got = []
            for t, k, n in zip(texts, part, parts, strict=True):
                ids = word_ids(words_of(t))
                got.append(np.array(scan(ids, *lag_range(len(ids), k, n, exponent), exponent, least), np.int64).reshape(-1, 3))
            yield pd.DataFrame({c: [g[:, i] for g in got] for i, c in enumerate(("starts", "lengths", "lags"))})

    dealt = docs.select(*text_digest("__run_text"), "__run_text", "__run_parts").dropDuplicates(["t1", "t2"])
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("__run_parts") - 1))).repartition("t1", "t2", "part")
    found = dealt.select("t1", "t2", run("__run_text", "part", "__run_parts").alias("x"))
    return found.groupBy("t1", "t2").agg(F.flatten(F.collect_list(F.arrays_zip("x.starts", "x.lengths", "x.lags"))).alias("found"))


def find_runs(docs: DataFrame, text: str = "text", min_exponent: int = MIN_EXPONENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Add `runs` and `collapsed` (replacing columns of these names) to every row.

    runs: structs of start (word number), length and period of every run, by start, then period. A run is a
    stretch with that smallest period, of min_words words and min_exponent periods at least, that no
    neighbouring word extends. collapsed: the text's words, joined by one space, without those that a run holds
    after its first period. Null and empty texts have no runs and an empty `collapsed`; texts may be of any
    length; equal texts have equal results, repeated rows stay; other columns pass through, but for names
    beginning with `__run_`, which are used inside.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _told([(words, smallest_periods(scan(ids, 1, len(ids) // min_exponent + 1, min_exponent, min_words))) for words in map(words_of, texts) for ids in (word_ids(words),)])

    @F.pandas_udf("starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    def gathered(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, *found in batches:
            yield _told([(words_of(t), smallest_periods(list(zip(*(map(int, x) for x in xs), strict=True)))) for t, *xs in zip(texts, *found, strict=True)])

    base = docs.withColumn("__run_text", text_or_empty(text))
    base = base.withColumn("__run_parts", F.greatest(F.ceil(F.sqrt(F.octet_length("__run_text") / RANGE_BYTES)), F.lit(1)).cast("int"))
    short, long = base.where("__run_parts = 1"), base.where("__run_parts > 1")
    found = materialize(_stretches(long, min_exponent, min_words), "stretches").select(F.col("t1").alias("__run_t1"), F.col("t2").alias("__run_t2"), F.col("found").alias("__run_found"))
    t1, t2 = text_digest("__run_text")
    long = long.join(hinted(found), (t1 == F.col("__run_t1")) & (t2 == F.col("__run_t2")))
    short = short.withColumn("__run", whole("__run_text"))
    long = long.withColumn("__run", gathered("__run_text", *[F.col(f"__run_found.{c}") for c in ("starts", "lengths", "lags")]))
    keep = [F.col(c) for c in docs.columns if c not in ("runs", "collapsed")]
    runs = F.transform(F.arrays_zip("__run.starts", "__run.lengths", "__run.periods"), lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")))
    return short.select(*keep, "__run").unionByName(long.select(*keep, "__run")).select(*keep, runs.alias("runs"), F.col("__run.collapsed").alias("collapsed"))


def _told(results: list[tuple[list[bytes], list[tuple[int, int, int]]]]) -> pd.DataFrame:
    arrays = [np.array(runs, np.int64).reshape(-1, 3) for _, runs in results]
    return pd.DataFrame({c: [a[:, i] for a in arrays] for i, c in enumerate(("starts", "lengths", "periods"))} | {"collapsed": [collapsed(w, r) for w, r in results]})


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them (by crc32 of the id) with a tail that repeats itself; built-in functions only.

    With h = crc32(decimal doc_id), g = h / 10 and n > 0 words, where h % 10 = 0 each word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) / (3 + g % 8). Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(text_or_empty(), _SPACES), lambda w: w != "")
    split = docs.withColumn("__run_words", F.when(h % 10 == 0, words)).withColumn("__run_g", F.floor(h / 10).cast("long"))
    n = F.size("__run_words")
    a = F.when(n > 0, F.col("__run_g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("__run_g") % 8))).cast("int")
    split = split.withColumns({"__run_n": n, "__run_a": a, "__run_p": p})
    unit, left = F.slice("__run_words", F.col("__run_a") + 1, F.col("__run_p")), F.col("__run_n") - F.col("__run_a")
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(left / F.col("__run_p")).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("__run_words", F.lit(1), F.col("__run_a")), tail), " ")
    return split.withColumn("text", F.when(F.col("__run_a").isNotNull(), planted).otherwise(F.col("text"))).select(*docs.columns)


def _longest(runs: Column) -> Column:
    """length, -start and -period of the longest run; of equal ones the first, then that of the smallest period."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def run_digest(docs: DataFrame) -> DataFrame:
    """One row per document, with tails repeated as above: doc_id, n_runs, the longest run (nulls without one), digests of all runs and of the collapsed text."""
    found = find_runs(with_repeated_tails(docs.select("doc_id", "text"))).withColumn("longest", _longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    length, period = F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
