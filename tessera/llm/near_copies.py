"""Classes of near copies: SimHash links, completed to all pairs with a Jaccard likeness of 0.8 of their 5-word shingles.

Fingerprints of 5-word shingles that covering locality-sensitive hashing joins
(``simhash.links``) are candidates.  Texts that are alike differ in 10 of 64
bits on average, more than covering masks of any bearable number reach, so the
rest is found exactly: two sets that are alike share a shingle among the first
fifth of both, in any order common to all texts (prefix filtering), and the
first such shingle stands early enough in both (positional filter), within the
first ninth of the smaller one.  Of each set a bitmap keeps which bits an odd
number of its hashes falls on: two bitmaps differ in no more bits than the sets
in hashes, so candidates whose bitmaps differ in too many go before any text is
read (bitmap filter).  No pair is lost, and all others are confirmed on their
texts.  Shingles that a sample of the texts repeats come last in the order,
which keeps buckets short and changes no result.

Members of a bucket are first confirmed against a few leaders.  Pairs that this
has joined already need no look; of the others every one is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import components
from tessera.llm.hashed_words import Window, spaced
from tessera.llm.shared import discard, small_batches, text_or_empty, written

SHINGLE = 5
#: A text in so many is sampled; shingles of so many sampled texts come last, the most frequent ones if they are more.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 3, 1 << 17
#: Bytes of text whose shingles are hashed at a time.
_AT_ONCE = 2 << 20


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """A byte table that folds A-Z and makes ASCII white space plain spaces."""
    table = spaced()
    table[65:91] += 32
    return table


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _of_few(texts: list[bytes]) -> list[np.ndarray]:
    window = Window(texts, _folded())
    words = _scrambled(window.words())
    per_text = np.bincount(window.doc, minlength=len(texts))
    starts = np.cumsum(per_text) - per_text
    h = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        h = _scrambled(h ^ words[j : j + len(h)])
    out = []
    for at, n in zip(starts.tolist(), per_text.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(h[at : at + n - SHINGLE + 1]))
        else:  # all words are one shingle; none make none
            one = np.full(min(n, 1), n, np.uint64)
            for w in words[at : at + n]:
                one = _scrambled(one ^ w)
            out.append(one)
    return out


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct hashes, sorted, of each text's shingles: words between ASCII white space, A-Z folded."""
    out, held, size = [], [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= _AT_ONCE:
            out += _of_few(held)
            held, size = [], 0
    return out + _of_few(held) if held else out


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard likeness of two sets is 0.8 or more; that of two empty sets is 1."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _fingerprint(h: np.ndarray) -> int:
    """The signed SimHash of a set of hashes."""
    counts = np.zeros(simhash.BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def _parity(h: np.ndarray) -> np.ndarray:
    """A bitmap, as signed words, of the bits that an odd number of hashes falls on: 64 times a power of two, as many as hashes at least."""
    size = 1 << max(6, (len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in shingles(batch.column(0).cast(pa.binary()).to_pylist()):
            yield pa.record_batch([pa.array(found.view("<i8"))], names=["token"])


def _prefixes(frequent: np.ndarray):
    """``frequent`` is sorted."""
    schema = pa.schema([("node", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def is_frequent(h: np.ndarray) -> np.ndarray:
        if not len(frequent):
            return np.zeros(len(h), bool)
        return frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, prefixes, bits = [], [], [], []
            for h in shingles(batch.column(2).cast(pa.binary()).to_pylist()):
                late = is_frequent(h)
                sizes.append(len(h))
                prints.append(_fingerprint(h))
                prefixes.append(np.concatenate([h[~late], h[late]])[: len(h) // 5 + 1].view("<i8"))
                bits.append(_parity(h))
            columns = [pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(prefixes, schema.field(4).type), pa.array(bits, schema.field(5).type)]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], schema=schema)

    return run


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        x, y = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
        known = list({*x, *y})
        sets = dict(zip(known, shingles(known)))
        keep = pa.array([alike(sets[a], sets[b]) for a, b in zip(x, y)], pa.bool_())
        yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)


def _frequent(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that the sampled texts repeat; each distinct text counts once."""
    sample = texts.where(F.col("node").bitwiseAND(F.lit(SAMPLE - 1)) == 0).dropDuplicates(["node"]).select("text")
    counts = sample.mapInArrow(_sampled, "token long").groupBy("token").count().where(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).select("token").collect()
    return np.sort(np.array([r["token"] for r in found], "<i8").view("<u8"))


def _possible(a: str, b: str) -> Column:
    """Whether the sizes, and the places of a first common shingle, allow a likeness of 0.8."""
    return F.expr(f"5 * least({a}.n, {b}.n) >= 4 * greatest({a}.n, {b}.n) AND 9 * least({a}.n - {a}.i, {b}.n - {b}.i) >= 4 * ({a}.n + {b}.n)")


def _with_both(pairs: DataFrame, values: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) with the value of each side as x and y, and the table of the values asked for."""
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = written(values.select("node", column).join(asked, "node", "left_semi").dropDuplicates(["node"]), f"candidate_{column}", small=True)
    side = lambda n, t: wanted.select(F.col("node").alias(n), F.col(column).alias(t))
    return pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").select("u", "v", "x", "y"), wanted


def _differ() -> Column:
    """In how many bits the bitmaps x and y differ, the longer one folded to the length of the other."""
    folded = "aggregate(sequence(1, size({0}) div words - 1), slice({0}, 1, words), (s, k) -> zip_with(s, slice({0}, k * words + 1, words), (a, b) -> a ^ b))"
    same = "IF(size({0}) = words, {0}, " + folded + ")"
    bits = f"aggregate(zip_with({same.format('x')}, {same.format('y')}, (a, b) -> bit_count(a ^ b)), 0, (s, k) -> s + k)"
    return F.expr(bits)


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that are alike, as a table; nodes (node, n, bits), texts (node, text)."""
    pairs = written(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates", small=True)
    sketches = nodes.select("node", F.struct("n", "bits").alias("sketch"))
    rows, asked = _with_both(pairs, sketches, "sketch")
    rows = rows.selectExpr("u", "v", "x.n + y.n AS n", "x.bits AS x", "y.bits AS y", "least(size(x.bits), size(y.bits)) AS words")
    close = written(rows.where(9 * _differ() <= F.col("n")).select("u", "v"), "close", small=True)
    discard(pairs, asked)
    rows, asked = _with_both(close, texts, "text")
    out = written(rows.mapInArrow(_confirmed, "u long, v long"), "confirmed", small=True)
    discard(close, asked)
    return out


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) by SimHash: texts of equal fingerprint, as stars, and what covering masks join."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("m")), "fingerprints")
    equal = nodes.select("node", "fp").join(least, "fp").where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    return equal.unionByName(simhash.links(least.select(F.col("m").alias("node"), "fp")))


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs that are alike; nodes (node, n, fp, prefix, bits), texts (node, text)."""
    rows = written(nodes.select("node", "n", F.posexplode("prefix").alias("i", "token")), "shingle_rows")
    # a table of its own, here and below: both sides of a join are plain exchanges, which a hot shingle may split
    # a node has a token once; one of an alike pair has their first common token in its first ninth
    shared = rows.groupBy("token").agg(F.count("*").alias("k"), F.max(F.expr("9 * i <= n")).alias("early"))
    company = written(shared.where("k > 1 AND early").select("token"), "company", small=True)
    members = written(rows.join(company, "token"), "members", small=True)
    discard(rows, company)
    # a leader for texts of each size, with the fewest shingles of its own
    sized = members.groupBy("token", F.floor(F.log("n") / F.log(F.lit(1.25))).alias("size")).agg(F.min(F.struct("i", "node", "n")).alias("l"))
    leaders = sized.select("token", "l.*")
    stars = members.alias("a").join(leaders.alias("b"), "token").where(F.col("a.node") != F.col("b.node")).where(_possible("a", "b"))
    first = _links(stars.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).unionByName(_by_fingerprint(nodes)), nodes, texts)
    split = members.join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = written(split, "members_by_class", small=True)
    discard(members)
    classes = split.groupBy("token", "root").count().groupBy("token").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("k"))
    several = written(classes.where("k > 1").select("token", F.col("m.root").alias("main")), "mixed_tokens", small=True)
    mixed = written(split.join(several, "token"), "mixed", small=True)
    discard(split, several)
    # two members of different classes: one of them at least is outside the bucket's main class
    a, b = mixed.where("root <> main").alias("a"), mixed.alias("b")
    apart = F.expr("a.root <> b.root AND (b.root = b.main OR a.node < b.node)")
    rest = a.join(b, (F.col("a.token") == F.col("b.token")) & apart & _possible("a", "b"))
    second = _links(rest.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), nodes, texts)
    discard(mixed)
    return first.unionByName(second)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those whose class of near copies has a smaller identifier.

    A class is what pairs of texts that are alike connect; all texts without
    words are alike.  Rows without identifier stay and name no class.  Rows
    that repeat an identifier are told apart by their texts: one of equal rows
    stays.
    """
    small_batches(docs.sparkSession)
    key = F.xxhash64(text_or_empty(text_col))
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"), key.alias("_key"))
    texts = docs.select(key.alias("node"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).where("doc_id IS NOT NULL")
    prints = written(texts.mapInArrow(_prefixes(_frequent(texts)), "node long, doc_id long, n int, fp long, prefix array<long>, bits array<long>"), "prefixes")
    nodes = prints.where("n > 0").dropDuplicates(["node"]).select("node", "n", "fp", "prefix", "bits")
    roots = components(links(nodes, texts.select("node", "text")))
    least = prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    root = F.when(F.col("n") > 0, F.coalesce("root", "node"))  # texts without words have none, and are one class
    classes = least.join(roots, "node", "left").groupBy(root.alias("root")).agg(F.min(F.struct("doc_id", "node")).alias("least"))
    names = classes.select(F.col("least.doc_id").alias("_id"), F.col("least.node").alias("_key"))
    kept = own.where("_id IS NOT NULL").join(names, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return kept.unionByName(own.where("_id IS NULL")).select("row.*")
