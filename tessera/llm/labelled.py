"""Bounded samples of labelled documents for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most, and the bytes of their texts at most: longer texts mean fewer rows.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 32 << 20


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of the identifier as text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """Up to ``rows`` (text, label) pairs that are not held out, in order of a hash of the identifier.

    Rows without identifier, text or label are left out; an identifier with
    several labels takes the smallest.  Texts are whole; where those of the
    chosen rows are more than ``most`` bytes together, the last rows that do
    not fit go.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = known.orderBy(order, "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("n", F.octet_length("text"))
    first = found.orderBy(order, "doc_id", F.xxhash64("text")).limit(rows)
    upto = F.sum("n").over(Window.orderBy(order, "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0))  # of ``rows`` rows at most
    kept = first.withColumn("upto", upto).where(F.col("upto") <= most).orderBy("upto", "doc_id").select("text", "label").collect()
    return [(r["text"].encode(), r["label"]) for r in kept]
