"""The pipeline's stages: columns, decisions against the operators, and the whole run."""

import corpus_pipeline
from pyspark.sql import functions as F

from larkspur.llm import decontam, lines, neardup
from larkspur.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "1234 567"), (10**6 + 1, None), (10**6 + 2, "The and of the to that with and onen there.")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        if name == "language":
            assert ids(docs) - ids(out) == {10**6, 10**6 + 1}
        if name == "line_dedup":
            assert lines.duplicate_lines(out).where("distance = 0").join(lines.split_lines(out), ["doc_id", "line_no"]).count() == 0
        if name == "near_dedup":
            assert ids(out) == ids(neardup.near_duplicates(docs).where("kept"))
        if name == "decontaminate":
            assert ids(docs) - ids(out) == ids(decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")))
        if name == "tokenize":
            assert ids(out) == ids(docs) and out.agg(F.min("n_tokens")).first()[0] >= 0
        else:
            assert out.columns == docs.columns
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
