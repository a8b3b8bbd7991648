"""Blocking joins, retrieval scores and top candidates.

The frequency cap is applied to the pool side before the join, so a reference
record meets at most ``cap`` rows for a key, whatever the key's frequency
among reference records.  Nothing loops over countries: the country is part
of the join key.

Identifiers of equal keys have equal scores with all others, so the joins see
one of each such class.  Only results are told for every member, and ranks
need at most ``k`` members of a class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY_CAP, TOP = 500, 30
#: Members of a class come in that many parts where all its pairs are listed.
PARTS = 16
#: Keys of a block of source 1 and of one of the pool, about, where pairs are scored within tasks.
LEFT_KEYS, RIGHT_KEYS = 250_000, 1_000_000
#: No key was met: above every key's order.
NONE = np.iinfo(np.int32).max


def exploded(records: DataFrame) -> DataFrame:
    """A row for each key of a record: entity_id, country, kord, key, w.

    ``explode`` would put a test of the array's size below all projections,
    which computes the keys twice; the outer form with a test of its rows does not.
    """
    rows = records.select("entity_id", "country", F.explode_outer("keys").alias("k")).where("k IS NOT NULL")
    return rows.select("entity_id", "country", "k.kord", "k.key", "k.w")


def _named_by_keys(each: DataFrame) -> DataFrame:
    """``each`` (entity_id, keys) plus ``sig``, a digest that is equal where the keys are; arrays themselves sort slowly."""
    return each.withColumn("sig", F.sha2(F.to_json(F.struct("keys")), 256))


def _key_rows(sized: DataFrame) -> DataFrame:
    rows = sized.select("entity_id", "n", F.explode_outer("keys").alias("k")).where("k IS NOT NULL")
    return rows.select("entity_id", "k.country", "k.kord", "k.key", "k.w", "n")


def classes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identifiers of equal keys as a class, by its least identifier: (entity_id, cls) and key rows, as from ``exploded``, with the class's size ``n``.

    All rows of an identifier count together, countries go with the keys.
    """
    placed = keyed.select("entity_id", F.transform("keys", lambda k: F.struct(F.col("country").alias("country"), k["kord"].alias("kord"), k["key"].alias("key"), k["w"].alias("w"))).alias("keys"))
    each = _named_by_keys(placed.groupBy("entity_id").agg(F.sort_array(F.flatten(F.collect_list("keys"))).alias("keys")))
    found = each.groupBy("sig").agg(F.min(F.struct("entity_id", "keys")).alias("least"), F.count("*").alias("n"))
    members = each.select("entity_id", "sig").join(found.select("sig", F.col("least.entity_id").alias("cls")), "sig").drop("sig")
    return members, _key_rows(found.select("least.entity_id", "n", "least.keys"))


def _merged(members: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``classes``, from classes and those of their key rows that can meet the other side; classes without any are left out."""
    each = _named_by_keys(rows.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("country", "kord", "key", "w"))).alias("keys"), F.first("n").alias("n")))
    found = each.groupBy("sig").agg(F.min(F.struct("entity_id", "keys")).alias("least"), F.sum("n").alias("n"))
    names = each.select(F.col("entity_id").alias("cls"), "sig").join(found.select("sig", F.col("least.entity_id").alias("_to")), "sig").select("cls", "_to")
    return members.join(names, "cls").select("entity_id", F.col("_to").alias("cls")), _key_rows(found.select("least.entity_id", "n", "least.keys"))


def _sides(keyed: DataFrame, cap: int, never: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members and key rows of the classes of source 1, and of the pool without keys over the cap."""
    (s1, s1_rows), (pool, pool_rows) = classes(keyed.where("source = 1")), classes(keyed.where("source <> 1"))
    kept = capped(pool_rows, cap, never)
    s1, s1_rows = _merged(s1, s1_rows.join(kept.select("country", "key"), ["country", "key"], "left_semi").select(*s1_rows.columns))
    return s1, s1_rows, *_merged(pool, kept.select(*pool_rows.columns))


def key_frequency(pool_keys: DataFrame) -> DataFrame:
    return pool_keys.groupBy("country", "key").agg((F.sum("n") if "n" in pool_keys.columns else F.count("*")).alias("df"))


def capped(pool_keys: DataFrame, cap: int = KEY_CAP, never: str | None = None) -> DataFrame:
    """Pool keys of at most ``cap`` rows in their country; keys that start with ``never`` are never cut.

    Frequencies are summed before the shuffle, and only the keys over the cap
    come back: a small side that Spark broadcasts if its measured size allows,
    so that rows of a hot key go where they are read.
    """
    hot = key_frequency(pool_keys).where((F.col("df") > cap) & (~F.col("key").startswith(never) if never else F.lit(True)))
    return pool_keys.join(hot.select("country", "key"), ["country", "key"], "left_anti")


def scored_pairs(s1_keys: DataFrame, pool_keys: DataFrame) -> DataFrame:
    """(country, s1, cand, blk, min_kord): the sum of weights over shared keys, repeats counted."""
    left = s1_keys.select("country", "key", F.col("entity_id").alias("s1"), "kord", "w")
    joined = left.join(pool_keys.select("country", "key", F.col("entity_id").alias("cand")), ["country", "key"])
    return joined.groupBy("country", "s1", "cand").agg(F.sum("w").alias("blk"), F.min("kord").alias("min_kord"))


def top_candidates(pairs: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best candidates of each reference record with rank ``rnk``; ties by first shared key, then identifier."""
    best = Window.partitionBy("s1").orderBy(F.desc("blk"), "min_kord", "cand")
    return pairs.withColumn("rnk", F.row_number().over(best)).where(F.col("rnk") <= k)


def _named(pairs: DataFrame, side: str, members: DataFrame) -> DataFrame:
    """``pairs`` of classes with a row for each member in place of the class of one side."""
    names = members.select(F.col("cls").alias(side), F.col("entity_id").alias("_member"))
    return pairs.join(names, side).withColumn(side, F.col("_member")).select(*pairs.columns)


def _top_members(pairs: DataFrame, s1: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Top candidates from pairs of classes: the first ``k`` classes, by their least members, hold the first ``k`` members."""
    first = pool.withColumn("_nth", F.row_number().over(Window.partitionBy("cls").orderBy("entity_id"))).where(F.col("_nth") <= k)
    some = _named(top_candidates(pairs, k).drop("rnk"), "cand", first)
    return _named(top_candidates(some, k), "s1", s1)


def all_pairs(keyed: DataFrame, cap: int = KEY_CAP, never: str | None = None) -> DataFrame:
    """Every scored pair of source 1 and the other sources, from records with ``keys`` (see ``scored_pairs``)."""
    s1, s1_rows, pool, pool_rows = _sides(keyed, cap, never)
    pairs = scored_pairs(s1_rows, pool_rows)
    # few classes may make many pairs: their parts, not the classes, are dealt to the tasks that list them
    dealt = pool.groupBy(F.col("cls").alias("cand"), F.pmod(F.xxhash64("entity_id"), F.lit(PARTS)).alias("_part")).agg(F.collect_list("entity_id").alias("_ids"))
    rows = _named(pairs.join(dealt.select("cand", "_part"), "cand"), "s1", s1).join(dealt.hint("merge"), ["cand", "_part"])
    return rows.withColumn("cand", F.explode("_ids")).select(*pairs.columns)


def one_of_equals(records: DataFrame, side: str = "source = 1") -> tuple[DataFrame, DataFrame]:
    """(``records`` with one of all equal ones of a side, the least identifier; (entity_id, cls) of that side).

    Identifiers are equal if all their rows agree in country, name and address.
    """
    own = records.where(side)
    each = own.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("country", "name", "addr"))).alias("keys"))
    each = _named_by_keys(each).drop("keys")
    names = each.groupBy("sig").agg(F.min("entity_id").alias("cls"))
    members = each.join(names, "sig").select("entity_id", "cls")
    kept = own.join(members.where("entity_id = cls").select("entity_id"), "entity_id", "left_semi")
    return kept.select(*records.columns).unionByName(records.where(f"NOT ({side})")), members


def for_equals(found: DataFrame, members: DataFrame, side: str = "s1") -> DataFrame:
    """What was found for one of all equal identifiers, told for each of them."""
    return _named(found, side, members)


def candidates(keyed: DataFrame, cap: int = KEY_CAP, k: int = TOP, never: str | None = None) -> DataFrame:
    """Top candidates of source 1 among the other sources, from records with ``keys``."""
    s1, s1_rows, pool, pool_rows = _sides(keyed, cap, never)
    return _top_members(scored_pairs(s1_rows, pool_rows), s1, pool, k)


def idf_candidates(keyed: DataFrame, cap: int = KEY_CAP, k: int = 25, plus: float = 0.0) -> DataFrame:
    """As ``candidates``, a key counting ln((N+1)/(df+1)) + ``plus`` times its weight."""
    size = keyed.where("source <> 1").agg(F.count("*").alias("total"))  # one row
    s1, s1_rows, pool, pool_rows = _sides(keyed, cap)
    rated = key_frequency(pool_rows).crossJoin(F.broadcast(size))
    left = s1_rows.join(rated, ["country", "key"])
    gain = F.round((F.log((F.col("total") + 1) / (F.col("df") + 1)) + plus) * F.col("w"), 9).cast("decimal(20,9)")
    left = left.groupBy("country", F.col("entity_id").alias("s1")).agg(F.collect_list(F.struct("key", "kord", (gain * 1_000_000_000).cast("long").alias("gain"))).alias("keys"))
    right = pool_rows.where("country IS NOT NULL").groupBy("country", F.col("entity_id").alias("cand")).agg(F.collect_list("key").alias("keys"))
    return _top_members(_best_of_blocks(left, right, k), s1, pool, k)


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """(country, n): in how many blocks of about ``most`` keys the rows of a country come."""
    return rows.groupBy("country").agg(F.ceil(F.sum(F.size("keys")) / most).cast("int").alias("n"))


def _best_of_blocks(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Pairs as from ``scored_pairs``, with gains for weights: for each s1 the ``k`` best of every block of the pool.

    ``left`` has (country, s1, keys of key, kord and gain), ``right`` (country,
    cand, keys).  A key that many records hold makes far more pairs than there
    are records, so pairs are not shuffled: a block of either side meets each
    block of the other side in one task, which adds up the gains there.
    """
    sizes = _blocks(left, LEFT_KEYS).withColumnRenamed("n", "_m").join(_blocks(right, RIGHT_KEYS), "country")
    part = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(F.broadcast(sizes), "country").withColumn("a", part("s1", "_m")).withColumn("b", every("n")).select("country", "a", "b", "s1", "keys")
    right = right.join(F.broadcast(sizes), "country").withColumn("b", part("cand", "n")).withColumn("a", every("_m")).select("country", "a", "b", "cand", "keys")
    # a number of partitions that is asked for is not merged into few
    parts, by = 4 * left.sparkSession.sparkContext.defaultParallelism, ["country", "a", "b"]
    sides = left.repartition(parts, *by).groupBy(*by).cogroup(right.repartition(parts, *by).groupBy(*by))
    found = sides.applyInArrow(_block_scorer(k), "country string, s1 string, cand string, units long, min_kord int")
    return found.select("country", "s1", "cand", F.expr("cast(cast(units AS decimal(20,0)) * cast('0.000000001' AS decimal(10,9)) AS decimal(30,9))").alias("blk"), "min_kord")


def _block_scorer(k: int):
    def flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        """The elements of all lists, and the list of each."""
        whole = pa.concat_arrays(lists.chunks)
        return whole.flatten(), pc.list_parent_indices(whole).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["country", "s1", "cand", "units", "min_kord"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        right = right.sort_by("cand")
        size = right.num_rows
        held, at = flat(right["keys"])
        held = held.dictionary_encode()
        # places of each key, in order of identifiers, and how often one holds the key
        places, times = np.unique(held.indices.to_numpy(zero_copy_only=False).astype(np.int64) * size + at, return_counts=True)
        begin = np.searchsorted(places, np.arange(len(held.dictionary) + 1) * size)
        places %= size
        asked, who = flat(left["keys"])
        code = pc.fill_null(pc.index_in(asked.field("key"), value_set=held.dictionary), -1).to_numpy(zero_copy_only=False)
        kord, gain = asked.field("kord").to_numpy(zero_copy_only=False), asked.field("gain").to_numpy(zero_copy_only=False)
        # later keys of a record overwrite the order of earlier ones, so the first order comes last
        order = np.lexsort((-kord, who))
        order = order[code[order] >= 0]
        who, code, kord, gain = who[order], code[order], kord[order], gain[order]
        bounds = np.searchsorted(who, np.arange(left.num_rows + 1))
        units, first = np.zeros(size, np.int64), np.full(size, NONE, np.int32)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for row in range(left.num_rows):
            low, high = bounds[row], bounds[row + 1]
            for i in range(low, high):
                span = slice(begin[code[i]], begin[code[i] + 1])
                units[places[span]] += gain[i] * times[span]
                first[places[span]] = kord[i]
            met = np.flatnonzero(first != NONE)
            if not len(met):
                continue
            best, total = met, units[met]
            if len(met) > k:
                least = np.partition(total, len(met) - k)[len(met) - k]
                best = met[total >= least]
            best = best[np.lexsort((best, first[best], -units[best]))[:k]]
            for column, values in zip(out, (np.full(len(best), row), best, units[best], first[best])):
                column.append(values)
            units[met], first[met] = 0, NONE
        rows, cands, sums, kords = (np.concatenate(c) if c else np.array([], np.int64) for c in out)
        country = pa.array([key[0].as_py()] * len(rows), pa.string())
        columns = [country, left["s1"].take(pa.array(rows, pa.int64())), right["cand"].take(pa.array(cands, pa.int64())), pa.array(sums, pa.int64()), pa.array(kords, pa.int32())]
        return pa.Table.from_arrays(columns, names=names)

    return run


def volume(cands: DataFrame, s1: DataFrame, pool_size: DataFrame) -> DataFrame:
    """Mean, median and 90th percentile of candidates per reference record, and 1 - mean/pool."""
    counts = s1.select(F.col("entity_id").alias("s1")).join(cands.groupBy("s1").count(), "s1", "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    stats = counts.agg(F.avg("n").alias("mean_candidates"), F.expr("percentile(n, 0.5)").alias("median_candidates"), F.expr("percentile(n, 0.9)").alias("p90_candidates"))
    return stats.crossJoin(pool_size).select("mean_candidates", "median_candidates", "p90_candidates", (1 - F.col("mean_candidates") / F.col("n")).alias("reduction"))
