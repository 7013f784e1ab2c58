"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import ann, bpe, decontam, langid, lines, neardup, periodic, quality, tokencount, toxicity, warc, whiten
from larkspur.llm.pii import pii_digest
from larkspur.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": lambda spark, sf: langid.predict_languages(table(spark, sf, "documents")),
    "op2_pii": lambda spark, sf: pii_digest(table(spark, sf, "documents")),
    "op3_bpe": lambda spark, sf: bpe.encode_digest(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")),
    "op5_near_duplicates": lambda spark, sf: neardup.near_duplicates(table(spark, sf, "documents")),
    "op9_decontamination": lambda spark, sf: decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
    "op10_token_counts": lambda spark, sf: tokencount.token_counts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
    "op6_toxicity": lambda spark, sf: toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op7_warc": lambda spark, sf: warc.archive_and_read(table(spark, sf, "pages")),
    "op4_nearest_neighbours": lambda spark, sf: ann.search(table(spark, sf, "embeddings")),
    "op11_periodic_runs": lambda spark, sf: periodic.run_digest(table(spark, sf, "documents")),
    "op12_whitening": lambda spark, sf: whiten.whiten(table(spark, sf, "embeddings")),
    "op13_quality": lambda spark, sf: quality.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op8_line_dedup": lambda spark, sf: lines.duplicate_lines(table(spark, sf, "documents")),
}
ORACLE: dict[str, str] = {"op8_line_dedup": lines.ORACLE, "op7_warc": warc.ORACLE}
