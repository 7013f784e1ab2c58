"""Quality by a factorisation machine over hashed words, structure statistics and metadata, trained in numpy.

Each word, each statistic's bin and each metadata column's bin has a weight and a short vector; a document's
log odds are the sum of its features' weights and of the inner products of all pairs of their vectors. By the
sum-of-squares identity all pairs cost no more than one pass over the features.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, text_or_empty
from larkspur.llm.sampling import held_out, marked_texts

#: Buckets of words, numbers of a vector, bins of a statistic, and least documents of the sample that a word must be in.
BUCKETS, DIM, BINS, LEAST_DOCS = 1 << 18, 8, 12, 4
#: The training sample: whole texts of so many documents of each label, and none after so many bytes of them.
DOCS_PER_LABEL, BYTES_PER_LABEL = 3000, 12_000_000
ROUNDS, BATCH, STEP, DECAY, SEED = 12, 64, 0.05, 0.97, 13
CACHE = 100_000
STATISTICS = ("words", "word length", "upper", "digits", "symbols", "symbols before a space", "distinct words", "commonest word", "words of a line", "distinct lines", "bare symbols", "letters beyond ASCII")
_LETTER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _BEYOND = range(6)


def _kinds() -> np.ndarray:
    """The kind of each character of the basic plane; all others count as symbols."""
    kinds = np.full(1 << 16, _SYMBOL, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        if c.isspace():
            kinds[k] = _SPACE
        elif unicodedata.category(c)[0] in "LM":
            kinds[k] = _UPPER if c.isupper() else _LETTER if k < 128 else _BEYOND
        elif c.isdigit():
            kinds[k] = _DIGIT
    return kinds


_KINDS = _kinds()
_word_buckets: dict[str, int] = {}


def bucket(word: str) -> int:
    """A word's bucket."""
    if (b := _word_buckets.get(word)) is None:
        if len(_word_buckets) > CACHE:
            _word_buckets.clear()
        b = _word_buckets[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
    return b


def measured(text: str, words: list[str], counts: Counter) -> list[float]:
    """The STATISTICS of a whole text."""
    kinds = _KINDS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
    of = np.bincount(kinds, minlength=6)
    letters, marks, n = max(1, of[_LETTER] + of[_UPPER] + of[_BEYOND]), max(1, len(kinds) - of[_SPACE]), max(1, len(words))
    before_space = np.count_nonzero((kinds[:-1] == _SYMBOL) & (kinds[1:] == _SPACE)) + bool(len(kinds) and kinds[-1] == _SYMBOL)
    lines = [x for x in text.split("\n") if x.strip()]
    bare = sum(k for w, k in counts.items() if len(w) < 3 and not any(map(str.isalnum, w)))
    return [
        math.log1p(len(words)), marks / n, of[_UPPER] / letters, of[_DIGIT] / marks, of[_SYMBOL] / marks, before_space / n, len(counts) / n,
        max(counts.values(), default=0) / n, math.log1p(len(words) / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), bare / n, of[_BEYOND] / letters,
    ]


@dataclass
class Sparse:
    """Documents' features: words' buckets with their values end to end, and a row of numbers (statistics, then metadata) for each."""

    buckets: list[np.ndarray] = field(default_factory=list)
    numbers: list[list[float]] = field(default_factory=list)

    def add(self, text: str, metadata: tuple) -> None:
        words = text.lower().split()
        counts = Counter(words)
        self.buckets.append(np.unique(np.fromiter(map(bucket, counts), np.int64, len(counts))))
        self.numbers.append([*measured(text, words, counts), *(math.nan if x is None or x != x else math.copysign(math.log1p(abs(float(x))), float(x)) for x in metadata)])


@dataclass
class FactorisationMachine:
    """Weights and vectors of all features, and the edges between the bins of each statistic and metadata column."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    edges: list[np.ndarray]

    def features(self, part: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers end to end, their values, and how many each document has. Words weigh 1 together by squares, bins 1 each; a missing number has a bin of its own."""
        table = np.array(part.numbers, float).reshape(len(part.buckets), len(self.edges))
        bins = np.stack([BUCKETS + k * (BINS + 1) + np.where(np.isnan(table[:, k]), BINS, np.searchsorted(e, table[:, k], "right")) for k, e in enumerate(self.edges)], 1)
        sizes = np.array([len(b) + len(self.edges) for b in part.buckets])
        ids = np.concatenate([x for b, row in zip(part.buckets, bins, strict=True) for x in (b, row)])
        values = np.concatenate([x for b in part.buckets for x in (np.full(len(b), max(1, len(b)) ** -0.5), np.ones(len(self.edges)))])
        return ids.astype(np.int64), values.astype(np.float32), sizes

    def odds(self, ids: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log odds of each document: (sum of x v) squared less the sum of (x v) squared is twice the sum over all pairs."""
        starts = np.cumsum(sizes) - sizes
        own = self.vectors[ids] * values[:, None]
        sums, squares = np.add.reduceat(own, starts), np.add.reduceat((own * own).sum(1), starts)
        return self.bias + np.add.reduceat(self.weights[ids] * values, starts) + ((sums * sums).sum(1) - squares) / 2

    def score(self, part: Sparse) -> np.ndarray:
        if not part.buckets:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.odds(*self.features(part)).astype(float), -50, 50)))


def train(part: Sparse, labels: np.ndarray) -> FactorisationMachine:
    """Fit by Adagrad on the cross entropy, both labels weighing the same; the same data give the same model."""
    rng = np.random.default_rng(SEED)
    table = np.array(part.numbers, float)
    edges = [np.unique(np.quantile(c[~np.isnan(c)], np.arange(1, BINS) / BINS)) if (~np.isnan(c)).any() else np.zeros(0) for c in table.T]
    size = BUCKETS + len(edges) * (BINS + 1)
    model = FactorisationMachine(0.0, np.zeros(size, np.float32), np.zeros((size, DIM), np.float32), edges)
    ids, values, sizes = model.features(part)
    learned = np.bincount(ids, minlength=size) >= LEAST_DOCS
    model.vectors[:] = rng.normal(0, 0.05, (size, DIM)) * learned[:, None]
    gw, gv, gb = np.full(size, 1e-4, np.float32), np.full(size, 1e-4, np.float32), 1e-4
    ends = np.cumsum(sizes)
    share = len(labels) / (2 * np.bincount(labels, minlength=2))
    for _ in range(ROUNDS):
        model.weights *= DECAY
        model.vectors *= DECAY
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            n = sizes[pick]
            at = np.repeat(ends[pick] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
            f, x = ids[at], values[at]
            starts = np.cumsum(n) - n
            slope = (1 / (1 + np.exp(-np.clip(model.odds(f, x, n), -30, 30))) - labels[pick]) * share[labels[pick]] / len(pick)
            each = np.repeat(slope, n) * x * learned[f]
            sums = np.add.reduceat(model.vectors[f] * x[:, None], starts)
            hit, place = np.unique(f, return_inverse=True)
            dw = np.bincount(place, each, len(hit))
            pull = each[:, None] * (np.repeat(sums, n, 0) - model.vectors[f] * x[:, None])
            dv = np.stack([np.bincount(place, c, len(hit)) for c in pull.T], 1)
            gb += slope.sum() ** 2
            gw[hit] += dw**2
            gv[hit] += (dv**2).mean(1)
            model.bias -= STEP * float(slope.sum()) / gb**0.5
            model.weights[hit] -= (STEP * dw / np.sqrt(gw[hit])).astype(np.float32)
            model.vectors[hit] -= (STEP * dv / np.sqrt(gv[hit])[:, None]).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ()) -> FactorisationMachine | None:
    """The model of a bounded sample, DOCS_PER_LABEL and BYTES_PER_LABEL, by a hash of id and text; never of held-out documents.

    A document marked twice is good if either mark says so. None where one of the two labels is missing; every score is then 0.
    """
    got = marked_texts(docs, labels, "quality", DOCS_PER_LABEL, BYTES_PER_LABEL, metadata).toPandas().sort_values(["doc_id", "text"], kind="stable")
    if got["quality"].nunique() < 2:
        return None
    part = Sparse()
    for text, *more in zip(got["text"], *[got[c] for c in metadata], strict=True):
        part.add(text, tuple(more))
    return train(part, got["quality"].to_numpy().astype(int))


def score(docs: DataFrame, model: FactorisationMachine | None, text: str = "text", out: str = "quality", metadata: tuple[str, ...] = ()) -> DataFrame:
    """Add `out` (replacing a column of that name): the score of each whole text of any length, 0 to 1.

    Null counts as empty; empty texts are scored by their statistics and metadata as any other; numbers missing in
    `metadata` (numeric columns, those the model was fitted with) have a bin of their own. Rows that are equal have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        machine = shared.value
        for texts, *more in batches:
            part = Sparse()
            for t, *numbers in zip(texts, *more, strict=True) if machine else ():
                part.add(t, tuple(numbers))
            yield pd.Series(machine.score(part) if machine else np.zeros(len(texts)), dtype="float64")

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, run(text_or_empty(text), *[F.col(c).cast("double") for c in metadata]))


def score_documents(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.3). Repeated rows get equal scores; other columns are not read."""
    scored = score(docs.select("doc_id", "text", *metadata), fit(docs, labels, metadata), metadata=metadata)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), F.col("quality").alias("score"), F.when(F.col("quality") >= 0.3, 1).otherwise(0).alias("predicted"))
