"""Frames as SQL tables: views, and results kept as Parquet under a name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def register(df: DataFrame, name: str) -> None:
    """``df`` as a temporary view that SQL can name."""
    df.createOrReplaceTempView(name)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, if it comes from fewer splits (small files of many rows) than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def materialise(df: DataFrame, name: str, path: str) -> DataFrame:
    """``df`` written to ``path`` and registered from there, so that later queries read the result."""
    df.write.mode("overwrite").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    register(table, name)
    return table


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set and all runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and what reads it has a short plan."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``kept`` has made, once no plan to come reads them."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table._written_at
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
