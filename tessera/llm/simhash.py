"""SimHash fingerprints and near-duplicate classes by covering locality-sensitive hashing.

For radius r every bit position gets a non-zero (r+1)-bit vector, and each
non-zero vector v defines the mask of the positions whose vector has odd
inner product with v.  At most r differing positions leave some v orthogonal
to all of them, so a pair within the radius agrees under at least one of the
2^(r+1)-1 masks: no link is lost.

Within a bucket two fingerprints differ outside the mask only.  Instead of all
pairs, a member of a bucket with company names every value that lies r/2 or
fewer flips away from it; members naming a common value are within r of each
other, and every pair within r names one.  A value has a bounded number of
members, so links are stars of bounded size and rows stay linear in members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import discard, small_batches, written

BITS = 64
#: Shingles hashed and counted at a time.
_CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """The masks, as unsigned 64-bit values."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


def fingerprint(text: bytes, shingle: int) -> int:
    """The unsigned SimHash of a text: words between ASCII white space, A-Z folded."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(words) - shingle + 1)
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, _CHUNK):
        h = np.array([xxh64_intdigest(whole[a:b], 42) for a, b in zip(starts[k : min(n, k + _CHUNK)], stops[k : k + _CHUNK])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = [_signed(fingerprint(t or b"", shingle)) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], schema=schema)

    return run


def simhash(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) per input row, fp the signed 64-bit fingerprint; no words give zero."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _flips(free: int, most: int) -> list[int]:
    """All values with up to ``most`` of the bits of ``free``."""
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    return [_signed(sum(c)) for k in range(most + 1) for c in combinations(bits, k)]


def _long_array(values: list[int]) -> Column:
    return F.expr("array(" + ",".join("(-9223372036854775807L - 1L)" if v == -(1 << 63) else f"{v}L" for v in values) + ")")


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Star edges (u, v) joining distinct fingerprints (node, fp) within ``radius`` bits."""
    if radius % 2:
        raise ValueError("the radius is even: two fingerprints meet half way")
    masks = covering_masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("b")
    keyed = nodes.select("node", "fp", table).select("node", "fp", "b.t", "b.key")
    # tables of their own, here and below: both sides of a join are plain exchanges, which a hot key may split
    company = written(keyed.groupBy("t", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("t", "key"), "company")
    members = keyed.join(company, ["t", "key"])
    all_bits = (1 << BITS) - 1
    flips = F.lit(None).cast("array<bigint>")
    for t, m in enumerate(masks):
        flips = F.when(F.col("t") == t, _long_array(_flips(all_bits & ~m, radius // 2))).otherwise(flips)
    named = members.select("node", F.col("fp").alias("own"), F.explode(flips).alias("flip")).select("node", F.col("own").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    named = written(named, "named_values")
    least = written(named.groupBy("value").agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m <> x").select("value", "m"), "least_nodes")
    discard(company)
    return named.join(least, "value").where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (signed long) and component_id, the smallest doc_id reachable.

    Rows with equal fingerprints are one node, named by their smallest
    identifier, so exact copies never meet in a bucket.  Null and empty texts
    have fingerprint zero and are linked like any other.  Repeated rows get
    equal results.  A null identifier is never a class's name; a class of such
    rows alone has a null component_id.  Empty tables give empty results and
    other columns are ignored.
    """
    prints = written(simhash(docs, shingle, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    roots = components(links(nodes.where("node IS NOT NULL"), radius))
    classes = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    # a table of its own: both sides of the last join are plain exchanges, which a hot fingerprint may split
    classes = written(classes, "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that name their class: one of each class stays.

    Rows without identifier name no class and stay.  Rows that repeat an
    identifier are told apart by their texts: of the texts of a class under
    its smallest identifier the one of least hash stays, once.
    """
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    texts = own.where("_id IS NOT NULL").select("_key", "_text").dropDuplicates(["_key"])
    # texts are the nodes, named by their hash
    classes = near_duplicates(texts, shingle, radius, "_key", "_text").select(F.col("doc_id").alias("_key"), "component_id")
    ids = own.where("_id IS NOT NULL").groupBy("_key").agg(F.min("_id").alias("_id"))
    names = ids.join(classes, "_key").groupBy("component_id").agg(F.min(F.struct("_id", "_key")).alias("n")).select("n.*")
    kept = own.where("_id IS NOT NULL").join(names, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return kept.unionByName(own.where("_id IS NULL")).select("row.*")
