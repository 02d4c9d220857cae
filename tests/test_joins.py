"""Joins over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfield.plans import registry

from .oracle import TESTDATA, difference


def test_full_outer_join_returns_every_supplier_and_customer(spark):
    sql = "SELECT s_suppkey, c_custkey, coalesce(s_nationkey, c_nationkey) AS nation FROM supplier FULL JOIN customer ON s_nationkey = c_nationkey"
    assert difference(spark, registry.QUERIES["joi_full_outer"], sql, f"{TESTDATA}/sf0.001") == ""


def test_full_join_of_small_tables_is_dealt_out_by_its_pairs(spark, tmp_path, monkeypatch):
    """Nulls, nations of one side alone and repeats, in as many tasks as the pairs ask for."""
    from wayfield.plans import stars

    spark.createDataFrame([(k, n) for k, n in enumerate([1, 1, 2, 3, None, 5])], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(k, n) for k, n in enumerate([1] * 40 + [2, 4, None, 3])], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/b")
    for part, name in (("a", "supplier"), ("b", "customer")):
        next((tmp_path / part).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    monkeypatch.setattr(stars, "PAIRS", 10)
    assert difference(spark, stars.joi_full_outer, registry.SQL["joi_full_outer"], str(tmp_path)) == ""
    made = stars.joi_full_outer(spark, str(tmp_path)).where("s_suppkey is not null and c_custkey is not null")
    assert made.count() == 82 and made.select("nation").rdd.getNumPartitions() >= 9
    assert made.withColumn("p", F.spark_partition_id()).where("nation = 1").select("p").distinct().count() > 1
