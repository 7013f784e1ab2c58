"""Benchmark decontamination: an inverted BM25 index of test items, searched by every training passage.

Impacts are normalised by an item's score for its own text, so one threshold fits items of all lengths.
Passages are windows of words, so wide and so close that every item lies whole in one. The search is
block-max WAND with a fixed threshold: all items above it are retrieved, and lists and blocks that can't
lead there are skipped. Before it, a bound is evaluated for all passages of a batch at once, from the rarer
terms' short lists alone: common terms can't lift an item by more than a known share, so without enough
weight on an item's rarer terms no search is made. What is retrieved is verified on the
overlap of the item's question and answer with the passage: shingles, and, as a few changed words break many
shingles, also the part's words in order within a stretch of about its length.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, materialize, resident, text_or_empty

#: BM25's constants, postings of a block, the share of an item's own score that retrieves it, and that is verified.
K1, B, BLOCK, THRESHOLD, OVERLAP = 1.2, 0.75, 64, 0.6, 0.75
#: What an item may hold in common terms alone, so that reaching the threshold takes rarer ones.
COMMON = 0.25
SHINGLE = 5
#: What either part must keep if the whole item is covered to OVERLAP: a part of two or three words may have one changed.
LEAST_PART = 0.5
#: Texts whose bound is evaluated together.
TOGETHER = 100
#: Bytes of benchmark text indexed together; a larger benchmark is searched shard by shard.
SHARD_BYTES = 32 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and all other bytes beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's parts: at an answer mark or the last question mark, else its last sentence is the answer. One sentence is a question only."""
    if m := re.search(r"(?i)\b(?:answer|a)\s*:", text):
        return text[: m.start()], text[m.end() :]
    if "?" in text.rstrip()[:-1]:
        at = text.rstrip()[:-1].rindex("?") + 1
        return text[:at], text[at:]
    ends = [m.end() for m in re.finditer(r"[.!]\s+", text.strip())]
    return (text.strip()[: ends[-1]], text.strip()[ends[-1] :]) if ends else (text, "")


def _grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def in_order(part: list[bytes], words: list[bytes]) -> float:
    """The greatest share of a part's words that stand in order within some stretch of words, a quarter longer than the part."""
    bits: dict[bytes, int] = {}
    for i, w in enumerate(part):
        bits[w] = bits.get(w, 0) | 1 << i
    full, reach, best = (1 << len(part)) - 1, len(part) + len(part) // 4, 0
    where = [i for i, w in enumerate(words) if w in bits]
    for k, start in enumerate(where):
        row = full  # Bits that are 0 count the longest common subsequence.
        for i in where[k : k + reach]:
            if i >= start + reach:
                break
            met = row & bits[words[i]]
            row = (row + met | row - met) & full
        best = max(best, len(part) - row.bit_count())
        if best == len(part):
            break
    return best / len(part)


def covered(part: list[bytes], grams: set[tuple[bytes, ...]], words: list[bytes], alone: set[bytes], shared: set[tuple[bytes, ...]]) -> float:
    """How much of a part a passage (words, its distinct ones, its shingles) covers; a missing part counts as found."""
    if not part:
        return 1.0
    share = len(grams & shared) / len(grams) if len(part) >= SHINGLE else len(set(part) & alone) / len(set(part))
    if share < OVERLAP and len(part) >= SHINGLE and sum(w in alone for w in part) >= LEAST_PART * len(part):
        return max(share, in_order(part, words))
    return share


@dataclass
class Counts:
    """What BM25 counts over a whole benchmark: items, their words, the longest one's words, and in how many items each term is."""

    items: int
    words: int
    longest: int
    df: dict[bytes, int]


@dataclass
class Posting:
    """One term's items in order, their impacts, and the greatest impact of each block and of all."""

    items: list[int]
    impacts: list[float]
    block_max: list[float]
    most: float


class ItemIndex:
    """The index of test items (id, text); items without words are in it but can't be met.

    `counts` are those of the whole benchmark, if the items are a shard of it only.
    """

    def __init__(self, items: list[tuple[int, str]], counts: Counts | None = None):
        self.ids = [i for i, _ in items]
        docs = [terms(t) for _, t in items]
        counts = counts or Counts(len(docs), sum(map(len, docs)), max(map(len, docs), default=0), Counter(w for d in docs for w in set(d)))
        self.longest = max(1, counts.longest)
        self.parts = [tuple((p, _grams(p)) for p in map(terms, question_and_answer(t))) for _, t in items]
        self.wholes = [(d, _grams(d)) for d in docs]
        df, n, mean = counts.df, counts.items, max(1.0, counts.words / max(1, counts.items))
        lists: dict[bytes, list[tuple[int, float]]] = {}
        weights = [{w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(d) / mean)) for w, c in Counter(d).items()} for d in docs]
        for k, own in enumerate(weights):
            whole = sum(own.values())
            for w, x in own.items():
                lists.setdefault(w, []).append((k, x / whole))
        self.postings = [Posting([k for k, _ in p], [x for _, x in p], [max(x for _, x in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)], max(x for _, x in p)) for p in lists.values()]
        self.number = {w: t for t, w in enumerate(lists)}
        # Common terms: taken from the most frequent on, while no item gathers more than COMMON from them.
        held, self.rare = np.zeros(len(docs)), np.ones(len(self.postings) + 1, bool)
        self.rare[-1] = False
        for t in sorted(range(len(self.postings)), key=lambda t: -len(self.postings[t].items)):
            p = self.postings[t]
            held[p.items] += p.impacts
            if held[p.items].max() > COMMON:
                held[p.items] -= p.impacts
            else:
                self.rare[t] = False
        self.sizes = np.array([len(p.items) for p in self.postings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.flat_items = np.array([k for p in self.postings for k in p.items], np.int64)
        self.flat_impacts = np.array([x for p in self.postings for x in p.impacts])

    def passages(self, n: int) -> list[tuple[int, int]]:
        """Windows over n words: twice the longest item wide, half overlapping, so every item's length fits in one wholly."""
        return [(at, min(n, at + 2 * self.longest)) for at in range(0, max(1, n - self.longest), self.longest)]

    def retrieve(self, query: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose normalised score for the query's distinct terms reaches the threshold."""
        lists = [self.postings[t] for t in query]
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        while True:
            live = [q for q in live if at[q] < len(lists[q].items)]
            live.sort(key=lambda q: lists[q].items[at[q]])
            total, pivot = 0.0, -1
            for k, q in enumerate(live):
                total += lists[q].most
                if total >= THRESHOLD:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            upto = live[: pivot + 1]
            places = [bisect_left(lists[q].items, item, at[q]) for q in upto]
            inside = [(q, i) for q, i in zip(upto, places, strict=True) if i < len(lists[q].items)]
            if sum(lists[q].block_max[i // BLOCK] for q, i in inside) < THRESHOLD:
                # No item can pass before the nearest end of these blocks, nor before the next list comes in.
                ends = [lists[q].items[min(len(lists[q].items), (i // BLOCK + 1) * BLOCK) - 1] + 1 for q, i in inside]
                if pivot + 1 < len(live):
                    ends.append(lists[live[pivot + 1]].items[at[live[pivot + 1]]])
                to = max(min(ends), item + 1)
                for q in upto:
                    at[q] = bisect_left(lists[q].items, to, at[q])
                continue
            score = sum(lists[q].impacts[i] for q, i in inside if lists[q].items[i] == item)
            if score >= THRESHOLD - 1e-9:
                found.append((item, score))
            for q in upto:
                at[q] = bisect_left(lists[q].items, item + 1, at[q])

    def promising(self, texts: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text, passage) where some item's rarer terms weigh enough to reach the threshold. Term numbers of each text are given."""
        keys, first, n_terms = [], 0, len(self.postings) + 1
        owners = []
        for d, numbers in enumerate(texts):
            count = len(self.passages(len(numbers)))
            at = np.flatnonzero(self.rare[numbers])
            for back in (0, 1):
                k = at // self.longest - back
                ok = (k >= 0) & (k < count)
                keys.append((first + k[ok]) * n_terms + numbers[at[ok]])
            owners += [(d, k) for k in range(count)]
            first += count
        distinct = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        passage, term = distinct // n_terms, distinct % n_terms
        sizes = self.sizes[term] if len(term) else np.zeros(0, np.int64)
        where = np.repeat(self.starts[term] - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum()) if len(term) else np.zeros(0, np.int64)
        cells, inverse = np.unique(np.repeat(passage, sizes) * len(self.ids) + self.flat_items[where], return_inverse=True)
        sums = np.bincount(inverse, self.flat_impacts[where], len(cells))
        return {owners[k] for k in np.unique(cells[sums >= THRESHOLD - COMMON - 1e-9] // max(1, len(self.ids))).tolist()}

    def search(self, texts: list[str]) -> list[list[tuple[int, float, float, float]]]:
        """Verified items of each whole text: (item, best score, question overlap, answer overlap)."""
        out = []
        for lo in range(0, len(texts), TOGETHER):
            words = [terms(t) for t in texts[lo : lo + TOGETHER]]
            get, none = self.number.get, len(self.postings)
            numbers = [np.fromiter([get(w, none) for w in ws], np.int64, len(ws)) for ws in words]
            hits: list[dict[int, tuple[float, float, float]]] = [{} for _ in words]
            for d, k in sorted(self.promising(numbers)) if self.ids else []:
                begin, end = self.passages(len(words[d]))[k]
                self._verify(words[d][begin:end], np.unique(numbers[d][begin:end]), hits[d])
            out += [[(self.ids[k], *x) for k, x in sorted(h.items())] for h in hits]
        return out

    def _verify(self, words: list[bytes], query: np.ndarray, best: dict[int, tuple[float, float, float]]) -> None:
        """Retrieve the passage's items and keep those whose question and answer it covers, or the whole and half of either."""
        found = self.retrieve(query[query < len(self.postings)].tolist())
        grams, alone = (_grams(words), set(words)) if found else (set(), set())
        for k, score in found:
            overlaps = [covered(p, g, words, alone, grams) for p, g in self.parts[k]]
            met = min(overlaps) >= OVERLAP or min(overlaps) >= LEAST_PART and covered(*self.wholes[k], words, alone, grams) >= OVERLAP
            if met and (k not in best or score > best[k][0]):
                best[k] = (score, *overlaps)


def shards(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], Counts | None]]:
    """The distinct items in shards of about SHARD_BYTES, one in memory at a time, each with the whole benchmark's counts.

    A benchmark of one shard is counted where it is indexed.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SHARD_BYTES)
    if n > 1:
        items = materialize(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")), "items")

        def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                split = [terms(t) for t in pdf["text"]]
                yield pd.DataFrame([(s, len(ws), w) for s, ws in zip(pdf["shard"], split, strict=True) for w in [None, *set(ws)]], columns=["shard", "words", "term"])

        counted = items.mapInPandas(words, "shard int, words long, term binary")
        whole = counted.where("term is null").agg(F.count("*").alias("items"), F.sum("words").alias("words"), F.max("words").alias("longest")).first()
        per_shard = materialize(counted.where("term is not null").groupBy("term", "shard").count(), "terms")
        df = materialize(per_shard.join(per_shard.groupBy("term").agg(F.sum("count").alias("df")), "term").select("shard", "term", "df"), "frequencies")
    for k in range(n):
        mine = items.where(F.col("shard") == k).select("item_id", "text") if n > 1 else items
        counts = Counts(whole["items"], whole["words"], whole["longest"], {bytes(r[0]): r[1] for r in df.where(F.col("shard") == k).select("term", "df").toLocalIterator()}) if n > 1 else None
        yield sorted((r[0], r[1]) for r in mine.toLocalIterator()), counts


def _finder(shared: Broadcast):
    """A function from texts to their verified items, over one shard of the benchmark. A worker keeps the last shard's index."""
    key = uuid.uuid4().hex

    @F.pandas_udf("array<struct<item_id long, score double, question_overlap double, answer_overlap double>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = resident(key, lambda: ItemIndex(*shared.value))
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), x, strict=True)) for x in found] for found in index.search(texts.tolist())])

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, question_overlap, answer_overlap.

    Scores are an item's BM25 score for the best passage over its score for its own text. Both parts must be
    covered to OVERLAP, or the whole item to that and either part to LEAST_PART: by five-word shingles or by words in
    order, under five words by words alone; a missing part counts as found. Null and empty
    texts hold nothing; null items are no items; items without words are never met. Repeated rows of documents
    give repeated rows; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    found = None
    for shard in shards(benchmark):
        shared = spark.sparkContext.broadcast(shard)
        hits = docs.select("doc_id", F.explode(_finder(shared)(text_or_empty())).alias("x")).select("doc_id", "x.*")
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no test item is found, with all columns; row by row, so nothing is shuffled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for shard in shards(benchmark):
        shared = spark.sparkContext.broadcast(shard)
        docs = docs.where(F.size(_finder(shared)(text_or_empty())) == 0)
    return docs
