"""Reference records that arrive as a stream, against a static pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import blocking, keys


def pool_keys(pool: DataFrame, cap: int = blocking.KEY_CAP, phonetic: bool = False) -> DataFrame:
    """Capped keys of the pool; write them bucketed by (country, key) to spare every batch a shuffle of them."""
    return blocking.capped(blocking.exploded(keys.production_keys(text.normalised(pool), phonetic)), cap)


def retrieve(arrivals: DataFrame, pool: DataFrame, k: int = blocking.TOP, phonetic: bool = False) -> DataFrame:
    """Top candidates of a batch of arrivals (entity_id, name, addr, country)."""
    own = blocking.exploded(keys.production_keys(text.normalised(arrivals), phonetic))
    return blocking.top_candidates(blocking.scored_pairs(own, pool), k)


def start(stream: DataFrame, pool: DataFrame, path: str, checkpoint: str, k: int = blocking.TOP):
    """Write the candidates of every micro-batch to its own folder, so that a batch run again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        retrieve(df, pool, k).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
