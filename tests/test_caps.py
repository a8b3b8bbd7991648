import pytest

from tessera.plans import catalogue


@pytest.mark.parametrize("name, k", [("feature_vector_34", 30), ("feature_vector_13", 30), ("feature_vector_15", 50), ("cascade_tiers", 50)])
def test_common_keys_stay_up_to_the_default_cap(spark, tmp_path, name, k):
    # 30 records of source 1, and 60 of the pool that share a first word with them
    df = spark.range(90).selectExpr("id AS p_partkey", "concat('harbour ', md5(string(id))) AS p_name", "'T' AS p_type", "cast(id AS int) AS p_size", "concat('B', id) AS p_brand")
    df.write.parquet(str(tmp_path / "part.parquet"))
    assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == 30 * k
