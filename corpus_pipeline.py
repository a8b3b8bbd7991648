"""The corpus pipeline: documents to packed training sequences.

Each stage is one of the text operators on all that its predecessor kept.
``run`` writes every stage as Parquet in the shared folder and reads it back,
so a lost executor costs a stage's partition at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, near_copies, packing, pii, quality, shared


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, made that of the text again."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later copies of repeated line runs go; every document stays, an emptied one with an empty text."""
    return _counted(line_dedup.line_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each class of near copies (5-word Jaccard likeness 0.8 or more) the document with the smallest identifier stays."""
    return near_copies.keep_one(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data gives way to the name of its kind."""
    return _counted(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token ids in sequences of at most 4096, a row for each piece."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality", drop_poor),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("pii", redact_private),
    ("packing", pack_sequences),
]

#: No SQL: a learnt classifier, SimHash and a tokenizer; tests/llm checks every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
