"""Records of entities from the example tables: (entity_id, source, name, addr, country)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(df: DataFrame) -> DataFrame:
    return df.withColumn("source", F.substring("entity_id", 2, 1).cast("int")).select("entity_id", "source", "name", "addr", "country")


def doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the first line is the name, all other lines the address, the language the country."""
    key, line = F.col("doc_id"), F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(line) + 2, F.length("text"))
    return _records(table(spark, sf_dir, "documents").select(F.concat(F.lit("S"), (1 + key % 3).cast("string"), F.lit("-"), key.cast("string")).alias("entity_id"), line.alias("name"), rest.alias("addr"), F.col("lang").alias("country")))


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: repeated short names, numbers and codes in the address."""
    key = F.col("p_partkey")
    return _records(
        table(spark, sf_dir, "part").select(
            F.concat(F.lit("S"), (1 + key % 3).cast("string"), F.lit("-"), key.cast("string")).alias("entity_id"),
            F.concat("p_name", F.lit(" "), "p_type", F.lit(" Ltd")).alias("name"),
            F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_brand", F.lit(" Rd "), (10000 + key % 50).cast("string")).alias("addr"),
            F.col("p_type").alias("country"),
        )
    )


def party_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against suppliers, by region: hardly any match."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    one = customer.join(place, customer.c_nationkey == place.n_nationkey).select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_name").alias("name"), F.col("n_name").alias("addr"), F.col("r_name").alias("country"))
    two = supplier.join(place, supplier.s_nationkey == place.n_nationkey).select(F.concat(F.lit("S2-"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("name"), F.col("n_name").alias("addr"), F.col("r_name").alias("country"))
    return _records(one.unionByName(two))


ADAPTERS = {"docs": doc_records, "parts": part_records, "parties": party_records}


def truth(records: DataFrame, by: list[str]) -> DataFrame:
    """(s1, cand): records of other sources that agree with one of source 1 in country and all of ``by`` (expressions)."""
    keyed = records.select("entity_id", "source", "country", *[F.expr(e).alias(f"_k{i}") for i, e in enumerate(by)])
    on = ["country", *[f"_k{i}" for i in range(len(by))]]
    left = keyed.where("source = 1").withColumnRenamed("entity_id", "s1").drop("source")
    right = keyed.where("source <> 1").withColumnRenamed("entity_id", "cand").drop("source")
    return left.join(right, on).select("s1", "cand")


#: Agreement that defines the synthetic truth of each adapter.
TRUTH_BY = {"docs": ["lower(name)"], "parts": ["name", "split(addr, ' ')[1]"]}


def true_pairs(records: DataFrame, adapter: str) -> DataFrame:
    return truth(records, TRUTH_BY[adapter])
