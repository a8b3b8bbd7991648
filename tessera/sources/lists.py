"""Tab-separated sources, list files, their validation and resumable output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "entity_id string, business_name string, business_address string, country string"
MATCHES, CANDIDATES = ("source1_entity_id", "matched_entity_ids"), ("source1_entity_id", "candidate_entity_ids")


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="").csv(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A source file: header, no quoting, an empty field is null."""
    return _tsv(spark, path, SCHEMA)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """A source file plus ``ord``, which grows in order of its lines: the place of a line's block, and its number there."""
    return _tsv(spark, path, SCHEMA).withColumn("ord", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line")))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1, cand) pairs of a truth or match file; empty lists give none."""
    lists = _tsv(spark, path, "s1 string, ids string")
    return lists.select("s1", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("cand"))


def write_lists(spine: DataFrame, pairs: DataFrame, path: str, names: tuple[str, str], order: str = "s1") -> None:
    """One list file in order of the spine, a line for every spine record, tab-separated and unquoted."""
    from tessera.operators.decide import lists

    found = lists(spine.select("s1"), pairs, "ids")
    if order != "s1":
        found = found.join(spine.select("s1", order), "s1")
    out = found.orderBy(order).select(F.col("s1").alias(names[0]), F.col("ids").alias(names[1]))
    out.coalesce(1).write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="").csv(path)


def write_by_country(pairs: DataFrame, path: str) -> None:
    """Pairs by country folder; countries already there are replaced one by one, others stay (resume)."""
    pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country").parquet(path)


def missing_countries(spark: SparkSession, spine: DataFrame, path: str) -> DataFrame:
    """Countries of the spine (s1, country) whose part of ``path`` has not a line for each record."""
    want = spine.groupBy("country").agg(F.count("*").alias("want"))
    try:
        have = spark.read.parquet(path).groupBy("country").agg(F.count_distinct("s1").alias("have"))
    except Exception as error:  # the folder isn't there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return want.select("country")
    return want.join(have, "country", "left").where("have IS NULL OR have <> want").select("country")


def header_problem(spark: SparkSession, path: str, names: tuple[str, str]) -> str | None:
    """What is wrong with the first line, if anything: empty file, commas for tabs, other names."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return "empty file"
    line = first[0]["value"].strip().lower()
    if "\t" not in line and "," in line:
        return "comma header"
    return None if line.split("\t") == list(names) else "wrong header"


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(s1, ids, tabbed) of the lines below the header, untrimmed, blank lines skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = F.lower("value").rlike(r"^source1_entity_id[\t,]")
    parts = F.split("value", "\t")
    return lines.where(~header).select(F.get(parts, F.lit(0)).alias("s1"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("ids"), (F.size(parts) >= 2).alias("tabbed"))


def violations(lines: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, n_offenders, examples): every broken rule of a list file, with its first five offenders.

    ``lines`` as from ``raw_lines``, ``required`` the s1 that must be there,
    ``known`` the valid candidate identifiers (unchecked if None).
    """
    good = lines.where("tabbed")
    ids = good.where("ids <> ''").select("s1", F.explode(F.split("ids", ",")).alias("id"))
    found = [
        lines.where("NOT tabbed").select(F.lit("no tab").alias("rule"), F.col("s1").alias("offender")),
        good.groupBy("s1").count().where("count > 1").select(F.lit("duplicate row").alias("rule"), F.col("s1").alias("offender")),
        ids.groupBy("s1", "id").count().where("count > 1").select(F.lit("repeated id").alias("rule"), F.concat_ws(":", "s1", "id").alias("offender")),
        ids.where("id LIKE 'S1-%'").select(F.lit("source 1 id").alias("rule"), F.col("id").alias("offender")),
        ids.where("NOT (id LIKE 'S1-%' OR id LIKE 'S2-%' OR id LIKE 'S3-%')").select(F.lit("wrong prefix").alias("rule"), F.col("id").alias("offender")),
        required.select("s1").distinct().join(good, "s1", "left_anti").select(F.lit("missing s1").alias("rule"), F.col("s1").alias("offender")),
        good.select("s1").distinct().join(required, "s1", "left_anti").select(F.lit("unknown s1").alias("rule"), F.col("s1").alias("offender")),
    ]
    if known is not None:
        found.append(ids.where("id LIKE 'S2-%' OR id LIKE 'S3-%'").join(known.select(F.col("entity_id").alias("id")), "id", "left_anti").select(F.lit("unknown id").alias("rule"), F.col("id").alias("offender")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    # distinct offenders by rule, then ranks: no rule's offenders are gathered in one row
    counts = every.groupBy("rule", "offender").count()
    from pyspark.sql import Window

    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("offender"))).where("r <= 5")
    examples = ranked.groupBy("rule").agg(F.array_join(F.sort_array(F.collect_list("offender")), ",").alias("examples"))
    return counts.groupBy("rule").agg(F.count("*").alias("n_offenders")).join(examples, "rule")


def not_subset(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1, extra): the matches of list files that are no candidates."""
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    both = matches.select("s1", F.col("ids").alias("m")).join(candidates.select("s1", F.col("ids").alias("c")), "s1", "left")
    extra = F.array_except(split(F.col("m")), split(F.col("c")))
    return both.select("s1", F.array_join(F.sort_array(extra), ",").alias("extra")).where("extra <> ''")
