import pytest
from cairn.operators import skew
from pyspark.sql import functions as F


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_plain_join(spark, how):
    df = spark.range(500).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).alias("k"), "id")
    counted = df.where("k IS NOT NULL AND k <> 3").groupBy("k").agg(F.count("*").alias("n"))
    assert skew.hot_keys(counted, ["k"], "n", 500, 4).collect()[0]["__salts"] > 1
    found = skew.join_counted(df, counted, ["k"], how, parts=4)
    assert sorted(found.collect(), key=str) == sorted(df.join(counted, "k", how).collect(), key=str)


def test_no_hot_key_and_no_rows(spark):
    df = spark.range(20).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    counted = df.groupBy("k").agg(F.count("*").alias("n"))
    assert skew.hot_keys(counted, ["k"], "n", 20) is None
    assert skew.join_counted(df, counted, ["k"]).count() == 20
    assert skew.join_counted(df.where("false"), counted.where("false"), ["k"]).count() == 0
