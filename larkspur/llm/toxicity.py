"""Toxicity by subword bags: character n-gram vectors averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of its n-grams' vectors, so a misspelling never seen shares most of a known
word's. A document is read in segments of SEGMENT words, each averaged and scored; its score is its worst
segment's, so one insult in a long text isn't averaged away. As only documents are labelled, training goes over those
segments of a document that the model itself finds worst.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, text_or_empty
from larkspur.llm.sampling import held_out, marked_texts

#: n-gram lengths, their hash buckets, numbers for each, words of a segment.
NGRAMS, BUCKETS, DIM, SEGMENT = (3, 4, 5), 1 << 17, 8, 12
#: The training sample: whole texts of so many documents of each label, and none after so many bytes of them.
DOCS_PER_LABEL, BYTES_PER_LABEL = 3000, 12_000_000
LEAST_DOCS = 4
ROUNDS, WHOLE, BATCH, STEP, DECAY, SEED = 14, 2, 256, 0.02, 0.9, 5
WORD = re.compile(r"\w+")
CACHE = 100_000


def grams(word: str) -> list[int]:
    """Buckets of a word's n-grams, its ends marked; the whole word, if it has none."""
    w = f"<{word}>"
    if w.isascii():  # a byte a character
        b = w.encode()
        return [zlib.crc32(b[i : i + n]) % BUCKETS for n in NGRAMS for i in range(len(b) - n + 1)] or [zlib.crc32(b) % BUCKETS]
    return [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in NGRAMS for i in range(len(w) - n + 1)] or [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS]


@dataclass
class SubwordBag:
    """The trained vectors and softmax. With both linear, a word's part in the log odds is one number, remembered by word."""

    vectors: np.ndarray
    odds: np.ndarray
    bias: float
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        # With the mean and the softmax linear, a bucket's part in the log odds is one number too.
        self.parts = (self.vectors @ self.odds).astype(float).tolist()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def word(self, word: str) -> float:
        if (x := self.known.get(word)) is None:
            if len(self.known) > CACHE:
                self.known.clear()
            buckets = grams(word)
            x = self.known[word] = sum(map(self.parts.__getitem__, buckets)) / len(buckets)
        return x

    def score(self, text: str) -> float:
        """The probability of label 1 in the worst segment of the whole text."""
        words = WORD.findall(text.lower())
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        x = np.fromiter(map(self.word, words), float, len(words))
        starts = np.arange(0, len(x), SEGMENT)
        sums = np.add.reduceat(x, starts)
        # The last segment counts as a full one, so that a lone word weighs as it does elsewhere.
        return float(1 / (1 + np.exp(-np.clip((sums / SEGMENT).max() + self.bias, -50, 50))))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _summed(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of rows by group number."""
    return np.stack([np.bincount(group, v, groups) for v in values.T], 1)


class _Bags:
    """Segments of the sample as word numbers, and the n-gram buckets of each word, end to end."""

    def __init__(self, texts: list[str]):
        numbers: dict[str, int] = {}
        rows, owner, buckets, sizes = [], [], [], []
        for d, t in enumerate(texts):
            words = WORD.findall(t.lower())
            for k in range(0, len(words), SEGMENT):
                row = np.full(SEGMENT, -1, np.int32)
                for i, w in enumerate(words[k : k + SEGMENT]):
                    if w not in numbers:
                        numbers[w] = len(numbers)
                        g = grams(w)
                        buckets.append(np.array(g, np.int32))
                        sizes.append(len(g))
                    row[i] = numbers[w]
                rows.append(row)
                owner.append(d)
        self.rows, self.owner = np.array(rows, np.int32).reshape(-1, SEGMENT), np.array(owner, np.int64)
        self.buckets = np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    def documents(self, chosen: np.ndarray) -> np.ndarray:
        """In how many of the chosen documents each bucket is."""
        count = np.zeros(BUCKETS, np.int64)
        for part in np.split(np.arange(len(self.owner)), np.flatnonzero(np.diff(self.owner)) + 1):
            if len(part) and chosen[self.owner[part[0]]]:
                words = np.unique(self.rows[part])
                count[np.unique(np.concatenate([self.buckets[self.starts[w] : self.starts[w] + self.sizes[w]] for w in words[words >= 0]]))] += 1
        return count

    def parts(self, pick: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the picked segments: each word's number among their distinct words and its segment; of the distinct words, end to end, the buckets, and how many each has."""
        row, place = np.nonzero(self.rows[pick] >= 0)
        distinct, word = np.unique(self.rows[pick][row, place], return_inverse=True)
        n = self.sizes[distinct]
        at = np.repeat(self.starts[distinct] - _starts(n), n) + np.arange(n.sum())
        return word, row, self.buckets[at], n

    def odds(self, by_bucket: np.ndarray) -> np.ndarray:
        """Each segment's log odds from a number for each bucket."""
        words = np.append(np.add.reduceat(by_bucket[self.buckets], self.starts) / self.sizes, 0.0)
        return words[self.rows].sum(1) / SEGMENT


def train(texts: list[str], labels: np.ndarray) -> SubwordBag:
    """Fit vectors and softmax jointly, by Adagrad over sparse segments; the same data give the same model.

    The first WHOLE rounds go over all segments of all documents; the others over the worst segment of each
    document by the model so far, and as many others of clean documents. Both labels weigh the same.
    """
    rng = np.random.default_rng(SEED)
    bags = _Bags(texts)
    own, lab = bags.owner, labels[bags.owner]
    # Only n-grams of several documents are learned: those of one document would just tell that document.
    learned = bags.documents(labels >= 0) >= LEAST_DOCS
    e = rng.normal(0, 0.1, (BUCKETS, DIM)) * learned[:, None]
    w, b = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    ge, gw, gb = np.full(BUCKETS, 1e-6), np.full(w.shape, 1e-6), np.full(2, 1e-6)
    for r in range(ROUNDS):
        e *= DECAY
        chosen = np.arange(len(own))
        if r >= WHOLE and len(own):
            order = np.lexsort((-bags.odds(e @ (w[:, 1] - w[:, 0])), own))
            worst = order[np.r_[True, own[order][1:] != own[order][:-1]]]
            clean = np.flatnonzero(lab == 0)
            chosen = np.unique(np.concatenate([worst, rng.choice(clean, min(len(worst), len(clean)), replace=False)]))
        pos, neg = chosen[lab[chosen] == 1], chosen[lab[chosen] == 0]
        if not len(pos) or not len(neg):
            break
        share = len(chosen) / (2 * np.array([len(neg), len(pos)]))
        order = rng.permutation(chosen)
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            word, row, buckets, n = bags.parts(pick)
            vectors = np.add.reduceat(e[buckets], _starts(n)) / n[:, None]
            mean = _summed(vectors[word], row, len(pick)) / SEGMENT
            s = mean @ w + b
            q = np.exp(s - s.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(pick)), lab[pick]] -= 1
            q *= share[lab[pick]][:, None] / len(pick)
            dw, db, dm = mean.T @ q, q.sum(0), q @ w.T
            by_word = _summed(dm[row], word, len(n)) / (SEGMENT * n[:, None])
            hit, inverse = np.unique(buckets, return_inverse=True)
            grad = _summed(np.repeat(by_word, n, 0), inverse, len(hit)) * learned[hit][:, None]
            ge[hit] += (grad**2).mean(1)
            gw += dw * dw
            gb += db * db
            e[hit] -= STEP * 10 * grad / np.sqrt(ge[hit])[:, None]
            w -= STEP * dw / np.sqrt(gw)
            b -= STEP * db / np.sqrt(gb)
    return SubwordBag(e.astype(np.float32), (w[:, 1] - w[:, 0]).astype(np.float32), float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame) -> SubwordBag | None:
    """The model of a bounded sample, DOCS_PER_LABEL and BYTES_PER_LABEL, by a hash of the id; never of held-out documents.

    A document marked twice is toxic if either mark says so. None where one of the two labels is missing; every score is then 0.
    """
    got = marked_texts(docs, labels, "toxic", DOCS_PER_LABEL, BYTES_PER_LABEL).toPandas().sort_values(["doc_id", "text"], kind="stable")
    return train(got["text"].tolist(), got["toxic"].to_numpy().astype(int)) if got["toxic"].nunique() == 2 else None


def score(docs: DataFrame, model: SubwordBag | None, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add `out` (replacing a column of that name): the score of each whole text of any length, 0 to 1.

    Null counts as empty, and empty texts have the model's prior; equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bag = shared.value
        for texts in batches:
            yield pd.Series([bag.score(t) if bag else 0.0 for t in texts], dtype="float64")

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, run(text_or_empty(text)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Repeated rows get equal scores; other columns are not read."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
