import pytest
from helpers import SMALL, rows

import __spark_entry__
from tessera.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SMALL)) == rows(duck.sql(catalogue.ORACLE_SQL[name]))


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_lists_every_reference_record(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["s1", "matches"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found.count() == docs.where("doc_id % 3 = 0").count()


def test_plans_prune_and_push_down(spark):
    plan = catalogue.QUERIES["key_df_cap"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan and "CartesianProduct" not in plan
