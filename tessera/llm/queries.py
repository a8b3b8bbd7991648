"""The registered queries of the text operators.

Each applies its operator with production parameters to its whole table and
derives the agreed digest columns from the operator's own output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import pieces, pii, syncmers
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.line_dedup import deduplicated
from tessera.llm.packing import pack
from tessera.llm.quality import quality_scores
from tessera.llm.shared import documents
from tessera.llm.sharding import place
from tessera.llm.simhash import near_duplicates
from tessera.llm.toxicity import toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its group of equal texts (A-Z folded); the largest identifier stays. Null texts are empty ones."""
    return exact_dedup(documents(spark, sf_dir), keep="largest")


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness; the last text's next is the first. Null texts are empty ones."""
    found = syncmers.edited_fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        syncmers.as_string(F.col("fp")).alias("fingerprint"),
        syncmers.as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        syncmers.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        syncmers.alignment(F.col("fp"), F.col("edited_fp")).alias("aligned_edited"),
        syncmers.alignment(F.col("fp"), F.col("next_fp")).alias("aligned_next"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and deleted lines of every row, and a digest of what is left; a null text is one empty line."""
    found = deduplicated(documents(spark, sf_dir))
    return found.select("row.doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; texts without words have fingerprint zero and are linked like any other."""
    found = near_duplicates(documents(spark, sf_dir), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every text; empty and null texts get the score of no features."""
    return quality_scores(documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and decision for every text; empty and null texts get the rates of the thresholds."""
    return toxicity(documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document, by identifier, among 256 shards; a null text has no bytes."""
    placed = place(documents(spark, sf_dir), [f"shard-{i:03d}" for i in range(256)])
    return placed.select("row.doc_id", "slot", "shard", F.octet_length(F.coalesce("row.text", F.lit(""))).cast("long").alias("n_bytes"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans of every text; null and empty texts have none."""
    found = pii.spans(documents(spark, sf_dir))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    base = F.filter("spans", lambda s: s["base"])
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    counts = [_of_kind(rank).alias(f"n_{k}") for rank, k in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _of_kind(rank: int):
    return F.size(F.filter("spans", lambda s: s["base"] & (s["rank"] == rank))).cast("long")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = documents(spark, sf_dir)
    encoded = pieces.encode(texts, path)
    back = pieces.with_decoded(encoded, path)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of every document; a document without text is its end id alone."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(documents(spark, sf_dir), path, end_id=2).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_syncmers": op2_syncmers,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_packing": op10_packing,
}

ORACLE_SQL = {
    "op1_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
""",
    "op3_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
w AS (
  SELECT *, lead(line, 1) OVER p AS l2, lead(line, 2) OVER p AS l3,
         row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS later,
         len(list_filter(string_split_regex(line, '[ \t\v\f\r]+'), lambda x: x <> '')) AS words
  FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT *, l3 IS NOT NULL AND row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) > 1 AS run FROM w),
g AS (
  SELECT doc_id, i, line,
         (later AND words >= 10) OR run OR coalesce(lag(run, 1) OVER p, FALSE) OR coalesce(lag(run, 2) OVER p, FALSE) AS gone
  FROM r WINDOW p AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM g GROUP BY doc_id
""",
}
