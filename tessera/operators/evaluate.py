"""Scores of match lists against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcomes(spine: DataFrame, truth: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(s1, n_true, n_pred, tp) for every s1 of the spine, from pair tables; ``by`` columns of the spine and of predictions are kept apart."""
    keys = ["s1", *(by or [])]
    true_pairs = truth.select("s1", "cand").distinct()
    found = predicted.select(*keys, "cand").distinct()
    hits = found.join(true_pairs.withColumn("hit", F.lit(1)), ["s1", "cand"], "left").groupBy(*keys).agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    counts = true_pairs.groupBy("s1").agg(F.count("*").alias("n_true"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return spine.join(counts, "s1", "left").join(hits, keys, "left").select(*keys, zero("n_true"), zero("n_pred"), zero("tp"))


def f_half(n_true: Column, n_pred: Column, tp: Column) -> Column:
    """F0.5 of one record: without truth 1 if nothing is predicted, else 0."""
    p, r = tp / n_pred, tp / n_true
    return F.when(n_true == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).when((n_pred == 0) | (tp == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def scored(outcome: DataFrame) -> DataFrame:
    return outcome.withColumn("f", f_half(F.col("n_true"), F.col("n_pred"), F.col("tp")))


def totals() -> list[Column]:
    """Aggregates over scored outcomes: macro F0.5, micro precision and recall, counts, singleton accuracy."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, pred, true = F.sum("tp"), F.sum("n_pred"), F.sum("n_true")
    single = F.sum(F.when(F.col("n_true") == 0, 1).otherwise(0))
    return [
        F.avg("f").alias("macro_f05"), ratio(tp, pred).alias("precision"), ratio(tp, true).alias("recall"), tp.alias("tp"), (pred - tp).alias("fp"), (true - tp).alias("fn"),
        ratio(F.sum(F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 1).otherwise(0)), single).alias("singleton_accuracy"),
        F.sum(F.when((F.col("n_true") > 0) & (F.col("f") > 0.5), 1).otherwise(0)).alias("well_matched"),
    ]


def by_truth_size(outcome: DataFrame) -> DataFrame:
    """Mean F0.5 for records with 0, 1, 2-3 and 4 or more true matches."""
    n = F.col("n_true")
    bucket = F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")
    return scored(outcome).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("f").alias("macro_f05"))


def recall_at(truth: DataFrame, pool: DataFrame, cands: DataFrame, ks: list[int]) -> DataFrame:
    """(k, total_true, hits, recall): the share of true pairs, of candidates in the pool, among the first k."""
    wanted = truth.select("s1", "cand").distinct().join(pool.select(F.col("entity_id").alias("cand")), "cand", "left_semi")
    ranks = wanted.join(cands.select("s1", "cand", "rnk"), ["s1", "cand"], "left")
    at = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    each = ranks.select("rnk", at).groupBy("k").agg(F.count("*").alias("total_true"), F.count(F.when(F.col("rnk") <= F.col("k"), 1)).alias("hits"))
    return each.select("k", "total_true", "hits", F.when(F.col("total_true") > 0, F.col("hits") / F.col("total_true")).otherwise(0.0).alias("recall"))


def threshold_sweep(spine: DataFrame, truth: DataFrame, pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, <totals>) of exclusive assignment at every threshold, in one plan.

    The owner of a candidate is the best pair at any threshold, so it is found
    once; thresholds only filter.
    """
    best = Window.partitionBy("cand").orderBy(F.desc("p"), "s1")
    owned = pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    kept = owned.select("s1", "cand", "p", each).where("p >= threshold")
    outcome = outcomes(spine.select("s1", each), truth, kept, ["threshold"])
    return scored(outcome).groupBy("threshold").agg(*totals())


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold of the best macro F0.5."""
    return sweep.orderBy(F.desc(F.round("macro_f05", 9)), "threshold").limit(1)
