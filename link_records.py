"""Command line: train, infer, validate and evaluate on a folder of source files.

The folder holds source1.tsv, source2.tsv, source3.tsv and, for training and
evaluation, ground_truth.tsv; results, saved pairs and the model go to the
output folder.  Inference keeps a folder for each country and does only those
that are not complete, unless told to overwrite; the list files are written
when all countries are there.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import decide, evaluate, features, model
from tessera.plans import linkage
from tessera.sources import lists


def records(spark: SparkSession, folder: str) -> DataFrame:
    parts = [lists.read_records(spark, f"{folder}/source{n}.tsv").withColumn("source", F.lit(n)) for n in (1, 2, 3)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.select("entity_id", "source", F.col("business_name").alias("name"), F.col("business_address").alias("addr"), "country")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def train(spark: SparkSession, data: DataFrame, folder: str, output: str, saved: bool, settings: dict) -> None:
    """Fit and save the trees, from saved pairs if asked; pairs are saved otherwise."""
    pairs = f"{output}/pairs"
    if not saved:
        linkage.training_pairs(data, lists.read_truth(spark, f"{folder}/ground_truth.tsv")).write.mode("overwrite").parquet(pairs)
    model.save(model.fit_trees(spark.read.parquet(pairs), features.PRODUCTION, **settings), f"{output}/model")


def infer(spark: SparkSession, data: DataFrame, output: str, cascade: bool, threshold: float, overwrite: bool) -> None:
    """Candidates and matches of every country that lacks them (all of them in one plan), by country folder."""
    spine, done = linkage.spine(data), f"{output}/by_country"
    if not overwrite:
        todo = lists.missing_countries(spark, spine, f"{done}/candidates")
        data = data.join(F.broadcast(todo), "country", "left_semi") if todo.count() else data.limit(0)
    has_model = _exists(spark, f"{output}/model")
    if not cascade and not has_model:
        raise ValueError("train a model first, or infer with --cascade")
    fitted = model.load(f"{output}/model") if has_model else None
    matches, cands = linkage.infer_cascade(data, fitted) if cascade else linkage.infer(data, fitted, threshold)
    own = linkage.spine(data)
    # matches first: a country counts as done by its candidates.  A record without any has a line of its own
    for name, pairs in (("matches", matches), ("candidates", cands.select("s1", "cand").unionByName(matches.select("s1", "cand")).distinct())):
        lists.write_by_country(own.join(pairs.select("s1", "cand"), "s1", "left"), f"{done}/{name}")


def assemble(spark: SparkSession, data: DataFrame, folder: str, output: str) -> bool:
    """Write the list files in order of source 1, if all countries are done."""
    spine, done = linkage.spine(data), f"{output}/by_country"
    if lists.missing_countries(spark, spine, f"{done}/candidates").count():
        return False
    ordered = spine.join(lists.read_ordered(spark, f"{folder}/source1.tsv").select(F.col("entity_id").alias("s1"), "ord"), "s1")
    for name, file, header in (("matches", "matching_results", lists.MATCHES), ("candidates", "candidate_pairs", lists.CANDIDATES)):
        pairs = spark.read.parquet(f"{done}/{name}").where("cand IS NOT NULL").select("s1", "cand")
        lists.write_lists(ordered, pairs, f"{output}/{file}", header, "ord")
    return True


def validate(spark: SparkSession, data: DataFrame, output: str) -> int:
    """Print every broken rule; the number of them.  Matches that are no candidates are a warning."""
    spine, pool, broken, read = linkage.spine(data), data.where("source <> 1"), 0, {}
    for name, header in (("matching_results", lists.MATCHES), ("candidate_pairs", lists.CANDIDATES)):
        if not _exists(spark, f"{output}/{name}"):
            print(f"{name}: missing")
            broken += name == "matching_results"
            continue
        problem, read[name] = lists.header_problem(spark, f"{output}/{name}", header), lists.raw_lines(spark, f"{output}/{name}")
        found = lists.violations(read[name], spine, pool).collect()
        for line in ([f"{name}: {problem}"] if problem else []) + [f"{name}: {r['rule']}: {r['n_offenders']} ({r['examples']})" for r in found]:
            print(line)
            broken += 1
    if len(read) == 2:
        outside = lists.not_subset(read["matching_results"], read["candidate_pairs"]).count()
        if outside:
            print(f"warning: {outside} records have matches that are no candidates")
    return broken


def show_scores(spark: SparkSession, data: DataFrame, folder: str, output: str, share: float) -> None:
    """Totals on the hold-out, or a part of it, of what was inferred."""
    from tessera.operators import splits

    truth = lists.read_truth(spark, f"{folder}/ground_truth.tsv")
    own = splits.holdout_part(linkage.spine(data), "s1", 0.15, share).select("s1")
    matches = spark.read.parquet(f"{output}/by_country/matches").where("cand IS NOT NULL").join(own, "s1", "left_semi")
    outcome = evaluate.outcomes(own, truth, matches)
    evaluate.scored(outcome).agg(*evaluate.totals()).show()
    evaluate.by_truth_size(outcome).show()


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("folder")
    args.add_argument("output")
    for step in ("train", "infer", "validate", "evaluate", "all", "cascade", "use-saved-pairs", "overwrite"):
        args.add_argument(f"--{step}", action="store_true")
    args.add_argument("--threshold", type=float, default=decide.THRESHOLD)
    args.add_argument("--share", type=float, default=1.0, help="part of the hold-out that is evaluated")
    args.add_argument("--rounds", type=int, default=model.PRODUCTION["rounds"])
    args.add_argument("--least", type=int, default=model.PRODUCTION["least"], help="pairs in a leaf, at least")
    args.add_argument("--countries", nargs="*")
    chosen = args.parse_args(argv)
    every = chosen.all or not (chosen.train or chosen.infer or chosen.validate or chosen.evaluate)
    spark = SparkSession.builder.appName("linkage").getOrCreate()
    data = records(spark, chosen.folder)
    if chosen.countries:
        data = data.where(F.col("country").isin(chosen.countries))
    if chosen.train or every and not chosen.cascade and not _exists(spark, f"{chosen.output}/model"):
        train(spark, data, chosen.folder, chosen.output, chosen.use_saved_pairs, model.PRODUCTION | {"rounds": chosen.rounds, "least": chosen.least})
    if chosen.infer or every:
        infer(spark, data, chosen.output, chosen.cascade, chosen.threshold, chosen.overwrite)
        if not assemble(spark, data, chosen.folder, chosen.output):
            print("some countries are not done; no list files")
            return 1
    if chosen.evaluate:
        show_scores(spark, data, chosen.folder, chosen.output, chosen.share)
    return int(bool((chosen.validate or every) and validate(spark, data, chosen.output)))


if __name__ == "__main__":
    sys.exit(main())
