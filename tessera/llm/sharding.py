"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of
prime size: an offset and a step, from hashes of its name.  Shards take turns
claiming the first slot they prefer that is free, so their shares differ by
one slot at most, and a shard that joins or leaves moves few slots of others.
The table has a fixed size, is broadcast, and gives a document's shard in
constant time.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime much larger than the number of shards.
SLOTS = 65_537


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """The shard (index) of every slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards are distinct names, one at least and no more than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots is prime")
    # whole preference orders, walked by position: no shard looks at a slot twice
    offsets = [_number(s, "offset") % slots for s in shards]
    steps = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    table, at, filled = np.full(slots, -1, np.int32), [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            slot = (offsets[i] + at[i] * steps[i]) % slots
            while table[slot] >= 0:
                at[i] += 1
                slot = (slot + steps[i]) % slots
            table[slot] = i
            at[i] += 1
            filled += 1
            if filled == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 15 hexadecimal digits of its md5, modulo the slots; a null key has slot 0."""
    number = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return F.coalesce(number % slots, F.lit(0)).cast("int")


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` as columns row (the input), slot and shard (the name).

    Placement is by identifier, so a hot source spreads evenly; repeated rows
    go to one shard, null identifiers to that of slot 0.  The table's size
    does not depend on the data.
    """
    spark = docs.sparkSession
    table = lookup_table(shards, slots)
    look_up = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "slot int, shard string")
    rows = docs.select(F.struct("*").alias("row"), slot_of(F.col(id_col), slots).alias("slot"))
    return rows.join(F.broadcast(look_up), "slot").select("row", "slot", "shard")


def write_shards(docs: DataFrame, shards: list[str], path: str, slots: int = SLOTS, id_col: str = "doc_id", files: int = 8) -> None:
    """Write every shard to a folder of its own (``shard=<name>``), dealt over ``files`` files each."""
    placed = place(docs, shards, slots, id_col).select("row.*", "shard", "slot")
    placed.repartition("shard", F.pmod("slot", F.lit(files))).drop("slot").write.partitionBy("shard").parquet(path)
