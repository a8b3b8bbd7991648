"""Audits of sources and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_size(ids: Column) -> Column:
    """Entries of a comma list, 0 for null and ''."""
    return F.when(F.coalesce(ids, F.lit("")) == "", 0).otherwise(F.length(ids) - F.length(F.replace(ids, F.lit(","))) + 1).cast("long")


def country_summary(results: DataFrame) -> DataFrame:
    """By country: records, matches, records without any, their percentage, mean list of the others; columns country and n."""
    empty = F.sum(F.when(F.col("n") == 0, 1).otherwise(0))
    return results.groupBy("country").agg(F.count("*").alias("records"), F.sum("n").alias("matches"), empty.alias("empty"), F.round(100.0 * empty / F.count("*"), 2).alias("empty_pct"), F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 4).alias("mean_matched"))


def match_histogram(results: DataFrame) -> DataFrame:
    """(n, records, pct) for every list size; the total is summed from the groups."""
    sizes = results.groupBy("n").agg(F.count("*").alias("records"))
    return sizes.select("n", "records", F.round(100.0 * F.col("records") / F.sum("records").over(Window.partitionBy()), 4).alias("pct"))


def length_bin(x: Column, low: int, high: int) -> Column:
    n = F.length(F.coalesce(x, F.lit("")))
    return F.when(n < low, "short").when(n < high, "medium").otherwise("long")


def match_statistics(results: DataFrame, by: str) -> DataFrame:
    """Count, mean, median and share of empty lists by a column."""
    return results.groupBy(F.col(by).alias("grp")).agg(F.count("*").alias("records"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").cast("double").alias("median"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("share_zero"))


def id_number(entity_id: Column) -> Column:
    """The digits behind the source prefix, null if there are none."""
    return F.regexp_replace(entity_id, "^S[0-9]-", "").try_cast("bigint")


def id_leakage(truth: DataFrame) -> DataFrame:
    """Whether identifiers of true pairs give them away: correlation, mean distance and ratio, quantiles of the distance."""
    pairs = truth.select(id_number(F.col("s1")).alias("a"), id_number(F.col("cand")).alias("b")).withColumn("d", F.abs(F.col("a") - F.col("b")))
    ratio = F.col("d") / F.greatest(F.col("a"), F.lit(1))
    steps = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    q = F.percentile("d", F.array(*[F.lit(s) for s in steps]))
    out = pairs.agg(F.count("*").alias("pairs"), F.round(F.corr("a", "b"), 6).alias("correlation"), F.round(F.avg("d"), 6).alias("mean_distance"), F.round(F.avg(ratio), 6).alias("mean_ratio"), F.round(F.stddev_samp("d"), 6).alias("sd_distance"), q.alias("q"))
    return out.select("pairs", "correlation", "mean_distance", "mean_ratio", "sd_distance", *[F.round(F.col("q")[i], 6).alias(f"q{int(s * 100):02d}") for i, s in enumerate(steps)])


def exact_match_rates(pairs: DataFrame) -> DataFrame:
    """Shares of true pairs equal as given, normalised and with sorted tokens; s_/c_ name, addr, n_norm, a_norm, nums."""
    share = lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6).alias(name)
    eq = lambda c: (F.col(f"s_{c}") == F.col(f"c_{c}")) & (F.col(f"s_{c}") != "")
    ordered = lambda c: F.array_join(F.sort_array(F.split(F.col(c), " ")), " ")
    eq_sorted = lambda c: (ordered(f"s_{c}") == ordered(f"c_{c}")) & (F.col(f"s_{c}") != "")
    return pairs.agg(
        F.count("*").alias("pairs"), share(eq("name"), "raw_name"), share(eq("addr"), "raw_addr"), share(eq("n_norm"), "clean_name"), share(eq("a_norm"), "clean_addr"),
        share(eq_sorted("n_norm"), "sorted_name"), share(eq_sorted("a_norm"), "sorted_addr"), share(eq("n_norm") & eq("a_norm"), "clean_both"), share(F.arrays_overlap("s_nums", "c_nums"), "number_overlap"),
    )


def canonical_match_rates(pairs: DataFrame) -> DataFrame:
    """Shares of true pairs with equal canonical name, address and both; s_/c_ canon_name, canon_addr."""
    share = lambda c, name: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6).alias(name)
    eq = lambda c: (F.col(f"s_{c}") == F.col(f"c_{c}")) & (F.col(f"s_{c}") != "")
    return pairs.agg(F.count("*").alias("pairs"), share(eq("canon_name"), "name"), share(eq("canon_addr"), "addr"), share(eq("canon_name") & eq("canon_addr"), "both"))


def mismatches(pairs: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The first ``n`` pairs, by identifiers, whose sides differ in a column."""
    return pairs.where(F.col(f"s_{column}") != F.col(f"c_{column}")).orderBy("s1", "cand").limit(n)


def positions(df: DataFrame, order: str, leaves: int = 64) -> DataFrame:
    """``df`` plus ``position``, its row's number (from 1) in order of a numeric column without repeats.

    Rows are dealt by quantiles, numbered within each, and shifted by the
    sizes of the quantiles before (``leaves`` rows at most).
    """
    found = df.agg(F.percentile_approx(order, [i / leaves for i in range(1, leaves)], 10_000).alias("q")).first()["q"] or []
    part = F.lit(0)
    for bound in sorted(set(found)):
        part = part + (F.col(order) >= bound).cast("int")
    dealt = df.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.join(F.broadcast(shift), "_part").withColumn("position", (within + F.col("_shift")).cast("long")).drop("_part", "_shift")


def position_leakage(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Correlation of the places of true pairs in their sources: a join with each source, of which one has the candidate."""
    placed = [positions(records.where(F.col("source") == n).select("entity_id", id_number(F.col("entity_id")).alias("n")), "n") for n in (1, 2, 3)]
    at = lambda k, key, name: placed[k].select(F.col("entity_id").alias(key), F.col("position").alias(name))
    joined = truth.join(at(0, "s1", "p1"), "s1").join(at(1, "cand", "p2"), "cand", "left").join(at(2, "cand", "p3"), "cand", "left").withColumn("p", F.coalesce("p2", "p3"))
    return joined.where("p IS NOT NULL").agg(F.count("*").alias("pairs"), F.round(F.corr("p1", "p"), 6).alias("correlation"), F.round(F.avg(F.abs(F.col("p1") - F.col("p"))), 6).alias("mean_distance"))


def address_flags(addr: Column) -> tuple[Column, Column]:
    """(missing, has digits)."""
    text = F.coalesce(addr, F.lit(""))
    return F.trim(text) == "", text.rlike("[0-9]")
