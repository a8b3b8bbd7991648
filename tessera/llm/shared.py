"""Helpers of the text operators: the shared folder and written tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import discard, kept, shared_dir  # noqa: F401

#: Rows and bytes handed to Python at a time: texts can be long, so batches stay small.
ARROW_ROWS, ARROW_BYTES = 256, 32 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes of an Arrow batch, for this session; a longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts lineage so that a lost executor costs a re-read, not a recomputation,
    and so that a result which depends on the split of the input is computed
    once only.  ``small`` tells that far less comes out than went in: its rows
    are then moved together by their own size, instead of a file for each task.
    """
    return kept(df.hint("rebalance") if small else df, name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_windows(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of several batches together, a few megabytes of text each; null texts are empty."""

    def joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
        ids, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1))
        return ids, texts.fill_null("")

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)
