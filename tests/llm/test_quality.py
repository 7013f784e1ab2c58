"""The factorisation machine against all pairs written out, its gradient, held-out rows, and samples of odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import langid, quality, sampling, toxicity

SF = "/root/testdata/sf0.001"


def part_of(*rows):
    part = quality.Sparse()
    for text, *numbers in rows:
        part.add(text, tuple(numbers))
    return part


def test_identity_equals_all_pairs():
    rng = np.random.default_rng(1)
    edges = [np.sort(rng.random(5)) for _ in quality.STATISTICS] + [np.array([2.0])]
    size = quality.BUCKETS + len(edges) * (quality.BINS + 1)
    model = quality.FactorisationMachine(0.2, rng.normal(size=size), rng.normal(size=(size, quality.DIM)) * 0.1, edges)
    part = part_of(("Some words, and some more words!", 30), ("", None), ("é | é |\n12", float("nan")), ("x " * 500, -4))
    ids, values, sizes = model.features(part)
    at, plain = 0, []
    for n in sizes:
        f, x = ids[at : at + n], values[at : at + n].astype(float)
        at += n
        pairs = sum(model.vectors[f[i]] @ model.vectors[f[j]] * x[i] * x[j] for i in range(n) for j in range(i))
        plain.append(1 / (1 + np.exp(-(0.2 + model.weights[f] @ x + pairs))))
    assert np.allclose(model.score(part), plain) and ((0 <= np.array(plain)) & (np.array(plain) <= 1)).all()
    assert ids[sizes[0] + len(edges) - 1] == ids[sizes[0] + sizes[1] + sizes[2] - 1] == quality.BUCKETS + 12 * 13 + quality.BINS


def test_pairs_are_learned():
    # Either word alone says nothing: only both together, or neither, are good.
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(1200):
        a, b = bool(i & 1), bool(i & 2)
        texts.append((f"{'alpha' if a else 'beta'} {'gamma' if b else 'delta'} w{rng.integers(9)}",))
        labels.append(int(a == b))
    rounds, quality.ROUNDS = quality.ROUNDS, 60
    try:
        model = quality.train(part_of(*texts), np.array(labels))
    finally:
        quality.ROUNDS = rounds
    assert ((model.score(part_of(*texts)) >= 0.5) == np.array(labels, bool)).mean() > 0.95


def test_statistics():
    from collections import Counter

    text = "AB cd12, é!\n\n| AB\nAB"
    words = text.lower().split()
    got = dict(zip(quality.STATISTICS, quality.measured(text, words, Counter(words))))
    # Letters ABcdéABAB, digits 12, symbols , ! and |, of which the first two end words and the bar stands alone.
    want = {"words": np.log(7), "word length": 14 / 6, "upper": 6 / 9, "digits": 2 / 14, "symbols": 3 / 14, "symbols before a space": 0.5, "distinct words": 4 / 6, "commonest word": 0.5, "words of a line": np.log(3), "distinct lines": 1, "bare symbols": 1 / 6, "letters beyond ASCII": 1 / 9}
    assert got == pytest.approx(want)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert len(bad) > 5 and (good.predicted == 1).mean() >= 0.97 and (bad.predicted == 0).mean() >= 0.9
    again = quality.score_documents(docs, labels).where("doc_id % 7 = 0").toPandas().merge(got, on="doc_id")
    assert (again.score_x == again.score_y).all()


def test_labels_of_held_out_rows_and_other_columns_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    once = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    other = labels.withColumn("quality", F.when(sampling.held_out(5, 0), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.lit(None))
    assert {r.doc_id: r.score for r in quality.score_documents(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), other).collect()} == once


def test_odd_tables(spark):
    rows = [(1, "x y", 3), (1, "x y", 3), (1, "other text", 10), (None, "x", 1), (4, None, None), (5, "", None), (6, "word " * 30_000, -1), (7, "퟿\U0001f600 \x00", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("quality", F.lit(9)).withColumn("order", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(docs, none).collect()} == {0.0} and quality.score_documents(docs.limit(0), none).count() == 0
    many = spark.createDataFrame([(100 + i, f"{'good thing' if i % 2 else 'BAD!! | |'} {i}", 9) for i in range(300)], docs.schema[:3])
    marked = spark.createDataFrame([*((100 + i, i % 2) for i in range(300)), (100, 1), (None, 1), (101, None), (102, 7)], "doc_id long, quality int")
    got = quality.score_documents(docs.select("doc_id", "text", "n_chars").unionByName(many), marked).collect()
    assert len(got) == len(rows) + 300 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    mine = [r.score for r in got if r.doc_id == 1]
    assert len(mine) == 3 and len(set(mine)) == 2
    assert quality.score(docs, None).columns == docs.columns


def test_rows_without_an_id_share_the_sample(spark, monkeypatch):
    rows = [(None, f"text {i} without an id", "en") for i in range(1000)] + [(i, f"text {i} with an id", "en") for i in range(4000)]
    table = spark.createDataFrame([*rows, *[(None, "the same text again and again", "en")] * 500], "doc_id long, text string, lang string")
    picked = sampling.within_bounds(sampling.few_of_each(table, "lang", 160, ("doc_id", "text")), "lang", 160, 10**9).collect()
    assert len(picked) == 160 and 10 <= sum(r.doc_id is None for r in picked) <= 60 and len({r.text for r in picked}) == 160
    monkeypatch.setattr(sampling, "MOST_LABELS", 100)
    with pytest.raises(ValueError, match="distinct"):
        sampling.few_of_each(table.withColumn("lang", F.col("text")), "lang", 1)
    monkeypatch.undo()
    assert len(langid.sample_windows(table)[0]) > 100


def test_texts_of_one_id_are_thinned(spark):
    docs = spark.createDataFrame([(1, f"text number {i} of one id") for i in range(9000)] + [(2, "the other label")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    sample = sampling.marked_texts(docs, labels, "toxic", 50, 10**9)
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert counts == {1: 50, 0: 1}
    assert toxicity.fit(docs, labels) is not None
