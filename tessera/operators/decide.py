"""Decisions: linear score, cascade tiers, exclusive owners, margin guard, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.distance import with_measures
from tessera.operators.features import paired

THRESHOLD, TIER3_THRESHOLD, NAME_BAR = 0.84, 0.85, 85.0


def linear_score(name: Column, addr: Column, s_nums: Column, c_nums: Column) -> Column:
    """0.50 name + 0.35 address (null counts 50) + 0.15 numbers (shared 100, disjoint 20, absent 50)."""
    absent = (F.size(s_nums) == 0) | (F.size(c_nums) == 0)
    nums = F.when(absent, 50.0).when(F.arrays_overlap(s_nums, c_nums), 100.0).otherwise(20.0)
    return 0.5 * name + 0.35 * F.coalesce(addr, F.lit(50.0)) + 0.15 * nums


def exclusive(scored: DataFrame, threshold: float = THRESHOLD, margin: float = 0.0) -> DataFrame:
    """The best owner (s1) of each candidate among pairs of p >= threshold; ties go to the smaller s1.

    With a margin, a candidate whose runner-up is closer than that is dropped.
    """
    best = Window.partitionBy("cand").orderBy(F.desc("p"), "s1")
    ranked = scored.where(F.col("p") >= threshold).withColumns({"_rank": F.row_number().over(best), "_second": F.lead("p").over(best)})
    kept = ranked.where("_rank = 1")
    if margin > 0:
        kept = kept.where(F.col("_second").isNull() | (F.col("_second") <= 0) | (F.col("p") - F.col("_second") >= margin))
    return kept.drop("_rank", "_second")


def lists(spine: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(s1, <name>): a comma list of candidates for every s1 of the spine, sorted, '' without any."""
    ids = pairs.groupBy("s1").agg(F.array_join(F.sort_array(F.collect_set("cand")), ",").alias(name))
    return spine.join(ids, "s1", "left").select("s1", F.coalesce(name, F.lit("")).alias(name))


def with_matches(candidate_lists: DataFrame, match_lists: DataFrame) -> DataFrame:
    """Candidate lists with missing matches appended, so that matches are a subset."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    joined = candidate_lists.join(match_lists, "s1", "left")
    return joined.select("s1", F.array_join(F.array_union(split(F.col("candidates")), split(F.col("matches"))), ",").alias("candidates"))


CANON_COLUMNS = ["canon_name", "canon_addr", "core_toks", "addr_nums", "locality"]


def tier1(a_set: Column) -> Column:
    """Equal canonical names, with evidence from numbers, addresses, or the name's own length."""
    c = F.col
    name = (c("s_canon_name") != "") & (c("s_canon_name") == c("c_canon_name"))
    local = F.size(F.array_intersect("s_locality", "c_locality"))
    numbered, addressed = (F.size("s_addr_nums") > 0) & (F.size("c_addr_nums") > 0), (c("s_canon_addr") != "") & (c("c_canon_addr") != "")
    by_number = F.arrays_overlap("s_addr_nums", "c_addr_nums") & ((local >= 1) | (a_set >= 45))
    by_name = (F.size("s_core_toks") >= 2) & (F.length("s_canon_name") >= 10)
    return name & F.when(numbered, by_number).when(addressed, (a_set >= 70) | (local >= 2)).otherwise(by_name)


def tier2_anchor(a_set: Column) -> Column:
    """What the second tier asks besides the names' likeness: a shared number and no contradiction of place."""
    local = F.size(F.array_intersect("s_locality", "c_locality"))
    names = (F.col("s_canon_name") != "") & (F.col("c_canon_name") != "")
    return F.arrays_overlap("s_addr_nums", "c_addr_nums") & ((local > 0) | (a_set >= 45)) & names


def tiers(pairs: DataFrame, canon: DataFrame, exact_address: bool = True) -> DataFrame:
    """(s1, cand, blk, tier, p): tier 1 scores 1.00, tier 2 0.95, all else tier 0 without a score.

    One pass over the pairs.  Measures run in Python, so each gets its strings
    only of pairs that may need it, and nulls of all others: address likeness
    where numbers and places leave the case open, name likeness where the
    anchor holds.  ``exact_address=False`` counts every address likeness as 0.
    """
    df, c = paired(pairs, canon, CANON_COLUMNS), F.col
    zero, full = F.lit(0.0), F.lit(100.0)
    asked = lambda flag, name: F.when(F.col(flag), F.col(name))
    if exact_address:
        unsettled = (tier1(full) != tier1(zero)) | (tier2_anchor(full) != tier2_anchor(zero))
        df = df.withColumn("_open", F.coalesce(unsettled & (c("s_canon_addr") != "") & (c("c_canon_addr") != ""), F.lit(False)))
        df = df.withColumns({"_sa": asked("_open", "s_canon_addr"), "_ca": asked("_open", "c_canon_addr")})
        df = with_measures(df, "_sa", "_ca", "a_", ["set"])
    else:
        df = df.withColumn("a_set", zero)
    df = df.withColumns({"_one": F.coalesce(tier1(c("a_set")), F.lit(False)), "_two": F.coalesce(tier2_anchor(c("a_set")), F.lit(False))})
    df = df.withColumn("_ask", c("_two") & ~c("_one")).withColumns({"_sn": asked("_ask", "s_canon_name"), "_cn": asked("_ask", "c_canon_name")})
    df = with_measures(df, "_sn", "_cn", "n_", ["set", "jw"])
    close = c("_ask") & (F.greatest("n_set", "n_jw") >= NAME_BAR)
    tier = F.when(c("_one"), 1).when(close, 2).otherwise(0)
    return df.select("s1", "cand", "blk", tier.alias("tier"), F.when(tier == 1, 1.0).when(tier == 2, 0.95).alias("p"))
