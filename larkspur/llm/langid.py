"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter's largest response in a
window goes into a softmax over languages. The network is trained in numpy on the windows of a bounded
sample of labelled documents. A document's languages are judged over all of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, text_or_empty
from larkspur.llm.sampling import few_of_each, held_out, within_bounds

#: Bytes of a window, filter widths, filters of each width, numbers for each byte.
WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4), 16, 8
#: The training sample: whole texts of so many documents of each language, and none after so many bytes of them.
DOCS_PER_LANG, BYTES_PER_LANG = 160, 400_000
EPOCHS, BATCH, STEP = 6, 128, 0.01
#: Windows that are in memory together; and the least score that the corpus stage accepts, just over an even spread over four.
CHUNK, LEAST_SCORE = 256, 0.3
UNKNOWN = "und"


def windows(data: bytes) -> np.ndarray:
    """The bytes in rows of WINDOW, overlapping by the widest filter less one so that no place is lost; zeros at the end."""
    stride = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // stride))
    padded = np.zeros((n - 1) * stride + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::stride]


@dataclass
class ByteCnn:
    """The network's weights: bytes to numbers, one matrix and bias for each width, and the softmax layer."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def __post_init__(self) -> None:
        # A filter's response is a sum over its bytes; tables over pairs of bytes hold two of them each.
        parts = [[self.embed @ f[k * EMBED : (k + 1) * EMBED] for k in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        self.tables = [[(k, (p[k][:, None] + p[k + 1][None]).reshape(65536, FILTERS) if k + 1 < len(p) else p[k]) for k in range(0, len(p), 2)] for p in parts]

    def features(self, rows: np.ndarray) -> np.ndarray:
        pairs = (rows[:, :-1].astype(np.intp) << 8) | rows[:, 1:]
        found = []
        for w, tables, bias in zip(WIDTHS, self.tables, self.biases, strict=True):
            n = WINDOW - w + 1
            total = None
            for k, t in tables:
                part = t[pairs[:, k : k + n]] if len(t) > 256 else t[rows[:, k : k + n]]
                total = part if total is None else np.add(total, part, out=total)
            found.append(np.maximum(total.max(1) + bias, 0))
        return np.concatenate(found, 1)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        logits = self.features(rows) @ self.out + self.out_bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language whose probability is highest on average over all windows of each whole text, and that average."""
        lettered = [any(map(str.isalpha, t)) for t in texts]
        parts = [windows(t.encode("utf-8", "replace")) for t, ok in zip(texts, lettered, strict=True) if ok]
        if not parts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        sums, counts = np.zeros((len(parts), len(self.langs))), np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), counts)
        at, group, size = 0, [], 0
        for part in [*parts, None]:
            for cut in [part[i : i + CHUNK] for i in range(0, len(part), CHUNK)] if part is not None else [None]:
                if group and (cut is None or size + len(cut) > CHUNK):
                    p = self.probabilities(np.concatenate(group))
                    np.add.at(sums, owner[at : at + size], p)
                    at, group, size = at + size, [], 0
                if cut is not None:
                    group.append(cut)
                    size += len(cut)
        mean = sums / counts[:, None]
        best = iter([(self.langs[k], float(min(1.0, m[k]))) for m, k in zip(mean, mean.argmax(1).tolist(), strict=True)])
        both = [next(best) if ok else (UNKNOWN, 0.0) for ok in lettered]
        return [x for x, _ in both], [y for _, y in both]


def train(rows: np.ndarray, labels: np.ndarray, langs: list[str]) -> ByteCnn:
    """Fit the network to windows and their languages' numbers, by Adam on the cross entropy; the same data give the same weights."""
    rng = np.random.default_rng(1)
    k = len(langs)
    p = [rng.normal(0, 0.3, (256, EMBED)), *(rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS), *(np.zeros(FILTERS) for _ in WIDTHS), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), k)), np.zeros(k)]
    p = [x.astype(np.float32) for x in p]
    m, v, step, nw = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0, len(WIDTHS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            pick = order[lo : lo + BATCH]
            x, y = rows[pick], labels[pick]
            e = p[0][x]
            feats, where, views = [], [], []
            for i, w in enumerate(WIDTHS):
                n = WINDOW - w + 1
                view = np.concatenate([e[:, j : j + n] for j in range(w)], 2)
                r = view @ p[1 + i] + p[1 + nw + i]
                at = r.argmax(1)
                views.append(view)
                where.append(at)
                feats.append(np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0], 0))
            f = np.concatenate(feats, 1)
            logits = f @ p[-2] + p[-1]
            q = np.exp(logits - logits.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(y)), y] -= 1
            q /= len(y)
            g = [np.zeros_like(z) for z in p]
            g[-2], g[-1] = f.T @ q, q.sum(0)
            df = (q @ p[-2].T) * (f > 0)
            for i, w in enumerate(WIDTHS):
                d = df[:, i * FILTERS : (i + 1) * FILTERS]
                g[1 + nw + i] = d.sum(0)
                patch = np.take_along_axis(views[i], where[i][:, :, None], 1)  # batch, filter, width times EMBED
                g[1 + i] = np.einsum("bf,bfe->ef", d, patch)
                back = d[:, :, None] * p[1 + i].T[None]
                for j in range(w):
                    np.add.at(g[0], x[np.arange(len(x))[:, None], where[i] + j], back[:, :, j * EMBED : (j + 1) * EMBED])
            step += 1
            for z, gz, mz, vz in zip(p, g, m, v, strict=True):
                mz += 0.1 * (gz - mz)
                vz += 0.001 * (gz * gz - vz)
                z -= STEP * (mz / (1 - 0.9**step)) / (np.sqrt(vz / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(langs, p[0], p[1 : 1 + nw], p[1 + nw : 1 + 2 * nw], p[-2], p[-1])


def sample_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of the training sample: all windows of whole texts, of every language.

    The sample is the only thing that comes to the driver; DOCS_PER_LANG and BYTES_PER_LANG bound it.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(3, 1)).select("doc_id", "lang", "text")
    picked = within_bounds(few_of_each(usable, "lang", DOCS_PER_LANG, ("doc_id", "text")), "lang", DOCS_PER_LANG, BYTES_PER_LANG)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(lang, w.tobytes()) for lang, text in zip(pdf["lang"], pdf["text"], strict=True) for w in windows(text.encode("utf-8", "replace"))], columns=["lang", "window"])

    bounded_batches(docs.sparkSession)
    got = picked.select("lang", "text").mapInPandas(cut, "lang string, window binary").toPandas().sort_values(["lang", "window"], kind="stable")
    langs = sorted(got["lang"].unique().tolist())
    if not langs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    rows = np.stack([np.frombuffer(w, np.uint8) for w in got["window"]])
    return rows, got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), langs


def identify(docs: DataFrame, model: ByteCnn | None, text: str = "text", out: str = "language") -> DataFrame:
    """Add `out` (replacing a column of that name): struct<lang, score> from the whole text.

    Texts that are null or without a letter are `und` with score 0; of languages with equal averages the first by name counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for texts in batches:
            lang, score = net.predict(texts.tolist()) if net else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"lang": lang, "score": score})

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, run(text_or_empty(text)))


def fit(docs: DataFrame) -> ByteCnn | None:
    """The network for documents with text and lang; None where there is nothing to learn from, and then every text is `und`."""
    rows, labels, langs = sample_windows(docs)
    return train(rows, labels, langs) if langs else None


def predict_languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Repeated rows get equal results; other columns are not read."""
    judged = identify(docs.select("doc_id", "text"), fit(docs))
    return judged.select("doc_id", held_out(3, 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is recognised: not `und`, and a score of LEAST_SCORE or more."""
    judged = identify(docs, fit(docs), out="__language")
    return judged.where((F.col("__language.lang") != UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)).select(*docs.columns)
