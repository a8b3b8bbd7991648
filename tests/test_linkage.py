import os

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

import link_records
from tessera.operators import blocking, decide, evaluate, features, keys, model, splits
from tessera.functions import text
from tessera.plans import linkage
from tessera.sources import adapters, lists
from tessera.streaming import arrivals


@pytest.fixture(scope="module")
def parts(spark):
    return adapters.part_records(spark, SMALL).cache()


@pytest.fixture(scope="module")
def cands(spark, parts):
    return linkage.production_candidates(parts)[1].cache()


def test_candidates_keep_the_limits(parts, cands):
    assert cands.groupBy("s1").count().agg(F.max("count")).first()[0] <= blocking.TOP
    assert cands.select("s1", "cand").distinct().count() == cands.count()


def test_cap_cuts_hot_keys_on_the_pool_side(spark):
    rows = [(f"S2-{i}", 2, "hot name", "", "x") for i in range(20)] + [("S1-1", 1, "hot name", "", "x"), ("S2-99", 2, "hot other", "", "x")]
    df = spark.createDataFrame(rows, "entity_id string, source int, name string, addr string, country string")
    keyed = keys.production_keys(text.normalised(df), phonetic=False)
    assert blocking.candidates(keyed, cap=30).count() == 21
    assert blocking.candidates(keyed, cap=10).count() == 0


def test_features_are_complete_and_bounded(parts, cands):
    norm = text.normalised(parts)
    out = features.production(cands.limit(200), norm)
    assert out.columns == ["s1", "cand", "country", *features.PRODUCTION] and len(features.PRODUCTION) == 34
    low, high = out.agg(F.min(F.least(*features.PRODUCTION)), F.max(F.greatest(*features.PRODUCTION))).first()
    assert low >= 0 and high <= 100
    assert out.where(F.greatest(*[F.col(c).isNull().cast("int") for c in features.PRODUCTION]) == 1).count() == 0


def test_each_candidate_has_one_owner(spark):
    df = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-2", "S2-1", 0.95), ("S1-1", "S2-2", 0.9), ("S1-0", "S2-2", 0.9), ("S1-1", "S3-3", 0.2)], "s1 string, cand string, p double")
    assert sorted(map(tuple, decide.exclusive(df, 0.84).select("s1", "cand").collect())) == [("S1-0", "S2-2"), ("S1-2", "S2-1")]
    assert decide.exclusive(df, 0.84, margin=0.04).count() == 1


def test_f_half_of_the_worked_example(spark):
    true = spark.createDataFrame([("S1-1", "S2-00047"), ("S1-1", "S3-00812")], "s1 string, cand string")
    found = spark.createDataFrame([("S1-1", "S2-00047"), ("S1-1", "S2-00193"), ("S1-1", "S3-00812")], "s1 string, cand string")
    spine = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    got = {r["s1"]: r["f"] for r in evaluate.scored(evaluate.outcomes(spine, true, found)).collect()}
    assert got["S1-1"] == pytest.approx(0.714, abs=5e-4) and got["S1-2"] == 1.0


def test_cascade_end_to_end(spark, parts):
    matches, found = linkage.infer_cascade(parts)
    matches = matches.cache()
    assert matches.count() == matches.select("cand").distinct().count()
    assert matches.join(found, ["s1", "cand"], "left_anti").count() == 0
    assert set(r[0] for r in matches.select("p").distinct().collect()) <= {1.0, 0.95}


def test_train_infer_save_and_load(spark, parts, tmp_path):
    truth = adapters.true_pairs(parts, "parts")
    extra = parts.where("source <> 1").select("entity_id", "name", "country").join(parts.where("source = 1").select(F.col("entity_id").alias("s1"), F.col("name").alias("n1"), F.col("country").alias("c1")), F.expr("name = n1 AND country = c1")).select("s1", F.col("entity_id").alias("cand"))
    fitted = model.fit_trees(linkage.training_pairs(parts, truth.unionByName(extra)).drop("is_val"), features.PRODUCTION, rounds=3, depth=3, least=2)
    model.save(fitted, str(tmp_path / "m"))
    matches, _ = linkage.infer(parts, model.load(str(tmp_path / "m")), threshold=0.5)
    totals = linkage.evaluation(parts, truth, matches).first()
    assert 0 <= totals["macro_f05"] <= 1
    with pytest.raises(ValueError):
        model.scores(fitted, parts)


def test_holdout_is_disjoint_and_stable(spark, parts):
    got = splits.holdout(parts, "entity_id").groupBy("split").count().collect()
    assert {r["split"] for r in got} == {"train", "val"} and sum(r["count"] for r in got) == parts.count()


def test_list_files_and_validator(spark, tmp_path):
    spine = spark.createDataFrame([("S1-1", "x"), ("S1-2", "x")], "s1 string, country string")
    pairs = spark.createDataFrame([("S1-1", "S3-2"), ("S1-1", "S2-1")], "s1 string, cand string")
    path = str(tmp_path / "m")
    lists.write_lists(spine, pairs, path, lists.MATCHES)
    text_file = next(p for p in (tmp_path / "m").iterdir() if p.suffix == ".csv").read_text()
    assert text_file == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n"
    assert lists.header_problem(spark, path, lists.MATCHES) is None
    assert lists.violations(lists.raw_lines(spark, path), spine).count() == 0
    assert sorted(map(tuple, lists.read_truth(spark, path).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    (tmp_path / "bad.tsv").write_text("source1_entity_id,matched_entity_ids\nS1-1,S2-1\nS1-9\tS2-1, S3-1,\nS1-9\tS1-4,S2-1,S2-1\n\n")
    assert lists.header_problem(spark, str(tmp_path / "bad.tsv"), lists.MATCHES) == "comma header"
    rules = {r["rule"]: r["n_offenders"] for r in lists.violations(lists.raw_lines(spark, str(tmp_path / "bad.tsv")), spine).collect()}
    assert rules == {"no tab": 1, "duplicate row": 1, "repeated id": 1, "source 1 id": 1, "wrong prefix": 2, "missing s1": 2, "unknown s1": 1}
    (tmp_path / "empty.tsv").write_text("")
    assert lists.header_problem(spark, str(tmp_path / "empty.tsv"), lists.MATCHES) == "empty file"


def test_sources_keep_quotes_and_nulls(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A \\ B\t\tFR\n\nS1-2\tx\ty\tUS\n')
    got = lists.read_records(spark, str(tmp_path / "s.tsv")).orderBy("entity_id").collect()
    assert tuple(got[0]) == ("S1-1", '"A \\ B', None, "FR") and len(got) == 2


def test_resume_finds_what_is_missing(spark, tmp_path):
    spine = spark.createDataFrame([("S1-1", "x"), ("S1-2", "y")], "s1 string, country string")
    path = str(tmp_path / "by")
    assert lists.missing_countries(spark, spine, path).count() == 2
    lists.write_by_country(spine.where("country = 'x'"), path)
    assert [r[0] for r in lists.missing_countries(spark, spine, path).collect()] == ["y"]


def test_stream_equals_batch(spark, parts, tmp_path):
    s1, pool = parts.where("source = 1").drop("source"), parts.where("source <> 1")
    s1.repartition(3).write.parquet(str(tmp_path / "in"))
    pool_keys = arrivals.pool_keys(pool).cache()
    stream = spark.readStream.schema(s1.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = arrivals.start(stream, pool_keys, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("s1", "cand", "rnk")
    want = arrivals.retrieve(s1, pool_keys).select("s1", "cand", "rnk")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0


def test_empty_tables(spark, parts):
    none = parts.limit(0)
    matches, cands = linkage.infer_cascade(none)
    assert matches.count() == 0 and cands.count() == 0
    assert decide.lists(linkage.spine(none), matches, "matches").count() == 0


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    order = [i * 7 % 30 for i in range(30)]
    for n in (1, 2, 3):
        (folder / f"source{n}.tsv").write_text(head + "".join(f"S{n}-{i}\tfirm {i} word{i}\t{i + 10} Main Rd\t{'FR' if i % 2 else 'US'}\n" for i in order))
    (folder / "ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\tS2-{i},S3-{i}\n" for i in range(30)))
    return folder


def test_command_line(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert link_records.main([str(folder), out, "--all", "--rounds", "5", "--least", "2"]) == 0
    found = lists.read_truth(spark, f"{out}/matching_results")
    assert found.where("substring(s1, 4) = substring(cand, 4)").count() == found.count() > 40
    # the model and the pairs stay: nothing is trained or inferred again
    before = {p: p.stat().st_mtime_ns for d in ("model", "by_country", "pairs") for p in (tmp_path / "out" / d).rglob("*") if p.is_file()}
    assert link_records.main([str(folder), out, "--all"]) == 0
    after = {p: p.stat().st_mtime_ns for d in ("model", "by_country", "pairs") for p in (tmp_path / "out" / d).rglob("*") if p.is_file() and "_SUCCESS" not in p.name}
    assert {p: t for p, t in before.items() if "_SUCCESS" not in p.name} == after
    assert link_records.main([str(folder), out, "--train", "--use-saved-pairs", "--rounds", "2", "--least", "2"]) == 0
    capsys.readouterr()
    assert link_records.main([str(folder), out, "--evaluate"]) == 0
    assert "macro_f05" in capsys.readouterr().out


def test_command_line_resumes_without_a_model(spark, folder, tmp_path):
    import shutil

    out = tmp_path / "out"
    with pytest.raises(ValueError):
        link_records.main([str(folder), str(out), "--infer"])
    assert link_records.main([str(folder), str(out), "--infer", "--cascade", "--countries", "FR"]) == 0
    part = out / "by_country" / "candidates" / "country=FR"
    kept = sorted(p.name for p in part.iterdir())
    assert link_records.main([str(folder), str(out), "--infer", "--validate", "--cascade"]) == 0
    assert sorted(p.name for p in part.iterdir()) == kept  # only the other country was done
    lines = next(p for p in (out / "matching_results").iterdir() if p.suffix == ".csv").read_text().split("\n")[1:-1]
    assert [x.split("\t")[0] for x in lines] == [f"S1-{i * 7 % 30}" for i in range(30)]
    shutil.rmtree(part)
    assert lists.missing_countries(spark, linkage.spine(link_records.records(spark, str(folder))), str(out / "by_country" / "candidates")).collect()[0][0] == "FR"


def test_tiered_validation(spark, parts):
    totals = linkage.tiered_validation(parts, adapters.true_pairs(parts, "parts"), per_country=2).first()
    assert 0 <= totals["macro_f05"] <= 1


def test_tables_are_kept_under_a_name(spark, parts, tmp_path):
    from tessera.sources import tables

    kept = tables.materialise(parts.where("source = 1"), "kept_parts", str(tmp_path / "t"))
    assert spark.sql("SELECT count(*) FROM kept_parts").first()[0] == kept.count() == parts.where("source = 1").count()


def test_numbers_in_other_scripts(spark):
    df = spark.createDataFrame([("१२ rue 12 x9 12",), (None,)], "addr string")
    assert [r[0] for r in df.select(text.raw_numbers(F.col("addr"))).collect()] == [["१२", "12"], []]


def _copies(spark, n):
    """``n`` copies of three names in both sides, one pool identifier with two rows, and a name of its own."""
    rows = [(f"S{side}-{i}", side, f"{word} harbour trading", f"{10000 + i % 2} Quay Rd", "x") for side in (1, 2) for i, word in enumerate(["blue", "red", "green"] * n)]
    rows += [("S2-0", 2, "blue harbour trading", "7 Mole Rd", "x"), ("S1-own", 1, "lonely pier", "1 Main Rd", "y")]
    return spark.createDataFrame(rows, "entity_id string, source int, name string, addr string, country string")


@pytest.mark.parametrize("kind", ["candidates", "all_pairs", "idf_candidates"])
def test_copies_are_joined_once_and_told_for_all(spark, monkeypatch, kind):
    df, joined, plain = _copies(spark, 20), [], blocking.scored_pairs
    keyed = keys.idf_keys(df) if kind == "idf_candidates" else keys.cascade_keys(text.canonical(df), phonetic=False)
    own, pool = blocking.exploded(keyed.where("source = 1")), blocking.exploded(keyed.where("source <> 1"))
    pairs = plain(own, pool) if kind != "idf_candidates" else None
    monkeypatch.setattr(blocking, "scored_pairs", lambda a, b: joined.append(plain(a, b)) or joined[-1])
    top = {"k": 7} if kind != "all_pairs" else {}
    found = getattr(blocking, kind)(keyed, **top)
    if kind == "idf_candidates":
        left = blocking.exploded(keyed.where("source = 1")).select("country", "key", F.col("entity_id").alias("s1"), "kord", "w")
        gain = F.round(F.log((F.lit(pool.select("entity_id").distinct().count() + 1) + 1) / (F.col("df") + 1)) * F.col("w"), 9).cast("decimal(20,9)")
        rated = pool.select("country", "key", F.col("entity_id").alias("cand")).join(blocking.key_frequency(pool), ["country", "key"])
        pairs = left.join(rated, ["country", "key"]).groupBy("country", "s1", "cand").agg(F.sum(gain).alias("blk"), F.min("kord").alias("min_kord"))
    want = pairs if kind == "all_pairs" else blocking.top_candidates(pairs, 7)
    assert found.columns == want.columns and want.count() > 0
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0
    if joined:
        assert joined[0].count() <= 7 * 6  # classes, not the 3,600 pairs of their members


@pytest.mark.parametrize("fit", [model.fit_trees, model.fit_forest])
def test_equal_pairs_are_fitted_together(spark, monkeypatch, fit):
    # six groups of equal pairs, two of them single; the last column of a row tells how often it comes
    groups = [(0.1, 0, False, 300), (0.2, 0, False, 200), (0.2, 0, True, 1), (0.8, 1, False, 60), (0.9, 1, False, 1), (0.9, 1, True, 5)]
    pairs = spark.createDataFrame([(v, label, val) for v, label, val, n in groups for _ in range(n)], "v double, label int, is_val boolean")
    given, plain = [], model.Pipeline.fit
    monkeypatch.setattr(model.Pipeline, "fit", lambda self, df: given.append(df) or plain(self, df))
    fitted = fit(pairs, ["v"], depth=2, **({"rounds": 3, "least": 10} if fit is model.fit_trees else {}))
    most = 10 if fit is model.fit_trees else model.DRAWN
    got = {tuple(r)[:3]: (r["n"], round(r["w"], 6)) for r in given[0].groupBy("v", "label", "is_val").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    ratio = 501 / 66
    assert got == {(v, label, val): (min(n, most), round(n * (ratio if label else 1.0), 6)) for v, label, val, n in groups}
    p = {r["v"]: r["p"] for r in model.scores(fitted, pairs.select("v").distinct()).collect()}
    assert max(p[0.1], p[0.2]) < 0.5 < min(p[0.8], p[0.9])


def test_idf_pairs_of_all_blocks_are_scored_within_tasks(spark, monkeypatch):
    # no two records alike, words of all frequencies, identifiers of two rows and of two countries, records without a country
    word = lambda i, n: ["harbour", "quay", "mole", "pier", "wharf"][i * n % 5 if n % 3 else i % 2]
    rows = [(f"S{1 + i % 3}-{i}", 1 + i % 3, f"{word(i, 1)} {word(i, 2)} {word(i, 3)} own{i}", f"{10 + i % 7} Long Road {10000 + i % 11}", [None, "x", "y", "x"][i % 4]) for i in range(150)]
    rows += [("S2-1", 2, "quay mole quay", "12 Road", "x"), ("S2-1", 2, "quay mole quay", "12 Road", "y"), ("S1-0", 1, "pier quay", "12 Road 10001", "x"), ("S1-3", 1, "pier quay", None, "x")]
    df = spark.createDataFrame(rows, "entity_id string, source int, name string, addr string, country string")
    keyed = keys.idf_keys(df)
    monkeypatch.setattr(blocking, "LEFT_KEYS", 60)
    monkeypatch.setattr(blocking, "RIGHT_KEYS", 90)
    found = blocking.idf_candidates(keyed, cap=70, k=6, plus=1.0)
    assert "CoGroupsInArrow" in found._jdf.queryExecution().analyzed().toString()  # pairs of classes are not shuffled
    found = found.cache()
    pool = blocking.capped(blocking.exploded(keyed.where("source <> 1")), 70)
    left = blocking.exploded(keyed.where("source = 1")).select("country", "key", F.col("entity_id").alias("s1"), "kord", "w")
    total = keyed.where("source <> 1").count()
    gain = F.round((F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1.0) * F.col("w"), 9).cast("decimal(20,9)")
    rated = pool.select("country", "key", F.col("entity_id").alias("cand")).join(blocking.key_frequency(pool), ["country", "key"])
    pairs = left.join(rated, ["country", "key"]).groupBy("country", "s1", "cand").agg(F.sum(gain).alias("blk"), F.min("kord").alias("min_kord"))
    want = blocking.top_candidates(pairs, 6).cache()
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0 and want.count() > 200
