import pytest
from helpers import SMALL
from pyspark.sql import functions as F

#: Rows with nulls, empty texts, ties, repeats and a very long text.
EDGES = [
    (1, None), (2, ""), (3, ""), (4, "Same Text here\nand there"), (5, "same text HERE\nand there"), (5, "same text HERE\nand there"),
    (None, "same text here\nand there"), (None, None), (9, " \t\n "), (10, "ÀÉ straße 漢字 😀 \x00 end"), (11, "x" * 70_000), (12, "a b c d e f g h i j k l m n\n" * 40),
    (13, "one"), (14, "call +1 (743) 555-3824 or me@x.org, 10.0.0.1, 4111 1111 1111 1111"),
]
#: Names that operators use inside.
CLASHING = ["row", "slot", "key", "pos", "rank", "fp", "node", "uid", "at", "later", "spans", "_t", "_bucket", "_candidates", "ids", "score", "shard", "h1", "_id", "body", "TEXT_"]


@pytest.fixture(scope="session")
def edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(7) for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")
