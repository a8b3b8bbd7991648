"""End-to-end plans of record linkage: train, infer (classifier or cascade), evaluate.

One lazy plan covers all countries.  Tables used by several branches are
persisted by the caller where it pays; nothing here loops over data.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import blocking, decide, evaluate, features, keys, model, splits
from tessera.sources import tables


def spine(records: DataFrame) -> DataFrame:
    return records.where("source = 1").select(F.col("entity_id").alias("s1"), "country")


def production_candidates(records: DataFrame, cap: int = blocking.KEY_CAP, k: int = blocking.TOP, phonetic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(normalised records, top candidates)."""
    norm = text.normalised(text.romanised(records))
    return norm, blocking.candidates(keys.production_keys(norm, phonetic), cap, k)


def cascade_candidates(records: DataFrame, cap: int = blocking.KEY_CAP, k: int = 50, phonetic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(canonical records, top candidates); whole-name keys are never cut."""
    canon = text.canonical(text.romanised(records))
    return canon, blocking.candidates(keys.cascade_keys(canon, phonetic), cap, k, never="nsig:")


def training_pairs(records: DataFrame, truth: DataFrame, cap: int = blocking.KEY_CAP, k: int = blocking.TOP, seed: int = 42) -> DataFrame:
    """Labelled feature rows; pairs that blocking missed are added on the training side only; ``is_val`` marks the hold-out."""
    norm, cands = production_candidates(records, cap, k)
    cands = cands.persist(StorageLevel.DISK_ONLY)  # read by three branches
    pool = records.where("source <> 1").select("entity_id")
    forced = splits.teacher_forced(cands, truth, pool).join(cands.select("s1", "cand", F.lit(True).alias("_found")), ["s1", "cand"], "left")
    own = splits.holdout(spine(records), "s1", seed=seed)
    pairs = forced.join(own, "s1").where("split = 'train' OR _found")
    rows = features.production(pairs.select("s1", "cand", "country", "blk"), norm)
    return rows.join(pairs.select("s1", "cand", "label", (F.col("split") == "val").alias("is_val")), ["s1", "cand"])


def train(records: DataFrame, truth: DataFrame, settings: dict | None = None, **options) -> PipelineModel:
    rows = tables.kept(model.gathered(training_pairs(records, truth, **options), features.PRODUCTION), "alike")
    try:
        return model.fit_trees(rows, features.PRODUCTION, **(settings or model.PRODUCTION))
    finally:
        tables.discard(rows)


def tiered_validation(records: DataFrame, truth: DataFrame, per_country: int = 1000, seed: int = 42) -> DataFrame:
    """Totals of tiers 1 and 2 (see ``evaluate.totals``) on up to ``per_country`` records of source 1 of every country, by hash, against the whole pool."""
    own = records.where("source = 1").withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "entity_id").cast("binary")))
    own = splits.stratified_head(own, "country", "_h", per_country).drop("_h")
    sample = own.select(*records.columns).unionByName(records.where("source <> 1"))
    matches, _ = infer_cascade(sample)
    return evaluation(sample, truth, matches)


def infer(records: DataFrame, fitted: PipelineModel, threshold: float = decide.THRESHOLD, margin: float = 0.0, cap: int = blocking.KEY_CAP, k: int = blocking.TOP) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates) as pairs: classifier scores, one owner for each candidate."""
    norm, cands = production_candidates(records, cap, k)
    scored = model.scores(fitted, features.production(cands, norm))
    return decide.exclusive(scored.select("s1", "cand", "country", "p"), threshold, margin), cands


def infer_cascade(records: DataFrame, fitted: PipelineModel | None = None, cap: int = blocking.KEY_CAP, k: int = 50, margin: float = 0.0, phonetic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(matches, candidates): tier 1, then tier 2, then the classifier (if given) for the rest, one owner each."""
    some, equals = blocking.one_of_equals(records)
    canon, cands = cascade_candidates(some, cap, k, phonetic)
    judged = decide.tiers(cands, canon)
    sure = judged.where("tier > 0").select("s1", "cand", "p")
    if fitted is not None:
        # read by both branches: kept on disk, computed again where an executor is lost
        judged = judged.persist(StorageLevel.DISK_ONLY)
        sure = judged.where("tier > 0").select("s1", "cand", "p")
        rest = judged.where("tier = 0").join(spine(some), "s1").select("s1", "cand", "country", "blk")
        scored = model.scores(fitted, features.production(rest, text.normalised(text.romanised(some))))
        sure = sure.unionByName(scored.where(F.col("p") >= decide.TIER3_THRESHOLD).select("s1", "cand", "p"))
    # of equal records the least would own a candidate; with a margin the others contest it
    owners = sure if margin <= 0 else blocking.for_equals(sure, equals)
    return decide.exclusive(owners, 0.0, margin), blocking.for_equals(cands, equals)


def evaluation(records: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of totals (see ``evaluate.totals``)."""
    return evaluate.scored(evaluate.outcomes(spine(records).select("s1"), truth, matches)).agg(*evaluate.totals())
