"""Bounded samples of labelled rows for the classifiers. Nothing else comes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, text_or_empty

_SPACE = 1 << 32
#: A column of labels with more distinct values than this isn't one.
MOST_LABELS = 10_000


def held_out(parts: int, out: int) -> Column:
    """Whether a row's remainder of crc32(doc_id as text) is `out`; a null id counts as the text "null"."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), F.lit(parts)) == out


def few_of_each(rows: DataFrame, label: str, most: int, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """About 1.3 * most + 50 rows of each label at most, by a hash of the columns `by` (column `order`), and all of rarer labels.

    A threshold on the hash, taken from the labels' counts, thins every partition out alike, so no label's rows
    are gathered in one task; `by` must tell rows apart, as those that it doesn't stay or go together. Which rows
    are taken depends on the table only. More than MOST_LABELS labels raise ValueError.
    """
    order = F.pmod(F.xxhash64(*by), F.lit(_SPACE))
    counts = rows.groupBy(label).agg(F.count("*").alias("of_label"))
    if counts.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"{label} has more than {MOST_LABELS} distinct values")
    chance = (most * 1.3 + 50) / F.col("of_label") * _SPACE
    return rows.withColumn("order", order).join(F.broadcast(counts), label).where(F.col("order") < chance).drop("of_label")


def within_bounds(rows: DataFrame, label: str, most: int, most_bytes: int) -> DataFrame:
    """Of the thinned rows (with `order`, `doc_id` and `text`), whole texts in the hash's order: at most `most` of a label, and none after most_bytes of text.

    Repeated rows count once; they meet before the shuffle that ranks a label's rows.
    """
    by = Window.partitionBy(label).orderBy("order", "doc_id", "text")
    size = F.octet_length("text").cast("long")
    ranked = rows.dropDuplicates([label, "doc_id", "text"]).withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)
    ranked = ranked.withColumn("before", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size)
    return ranked.where(F.col("before") < most_bytes).drop("n", "before", "order")


def marked_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the label and `columns` of a bounded sample of documents with a label, none of them held out (remainder 0 of 5).

    The sample is thinned by id first, so that few texts are read for it, and by id and text again where many
    texts share an id. A document marked twice has the greater label; other labels than 0 and 1, null ids and empty texts
    have no part.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(5, 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    chosen = F.broadcast(few_of_each(marked, label, most).drop("order"))  # 1.3 * most + 50 rows of either label
    texts = docs.select("doc_id", text_or_empty().alias("text"), *columns).join(chosen, "doc_id").where("text <> ''")
    texts = materialize(texts.dropDuplicates(["doc_id", "text"]), "marked")
    return within_bounds(few_of_each(texts, label, most, ("doc_id", "text")), label, most, most_bytes)
