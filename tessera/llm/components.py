"""Connected components by alternating large-star and small-star rounds.

All work is on edge tables: a round is two grouped minima and two joins, its
result a written table.  Minima are tables of their own, so both sides of a
join are plain exchanges and the edges of a hub may be split over tasks.
Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long) but the roots themselves.

    The root is the smallest node reachable.  Loops, repeated edges and edges
    with a null end are ignored; no edge gives an empty result.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(near, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large_star")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        was, now = now, written(low.select("u", F.col("m").alias("v")).unionByName(rest).distinct(), "small_star")
        discard(was, near, large, low)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components have not converged")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
