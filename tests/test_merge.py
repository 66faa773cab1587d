"""Merges, upserts, deletes and lookup joins, with ties, nulls and hot keys."""

import pytest
from pyspark.sql import functions as F

from retentia.operators import joins, merge


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_latest_by_text_date(spark):
    old = spark.createDataFrame([("1", "01/01/2024 09:00", "a"), ("2", None, "c")], ["Student ID", "Update Date", "v"])
    new = spark.createDataFrame([("01/02/2024 09:00", "b", "1")], ["Update Date", "v", "Student ID"])
    got = merge.merge_deliveries(old, new).select("Student ID", "v")
    assert rows(got) == [("1", "b"), ("2", "c")]


def test_new_delivery_wins_ties_and_merge_is_idempotent(spark):
    old = spark.createDataFrame([("1", "01/01/2024 09:00", "z")], ["Student ID", "Update Date", "v"])
    new = spark.createDataFrame([("1", "01/01/2024 09:00", "a")], ["Student ID", "Update Date", "v"])
    once = merge.merge_deliveries(old, new).drop("Update_Date_ts")
    assert once.head()["v"] == "a"
    assert rows(merge.merge_deliveries(once, new).drop("Update_Date_ts")) == rows(once)


def test_hot_key_keeps_one_row(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"),
                                   F.col("id").alias("at"), F.lit("x").alias("v"))
    got = merge.latest_per_key(df, ["k"], ["at"])
    assert got.count() == 20001 and got.filter("k = -1").head()["at"] == 29997


def test_latest_carries_maps(spark):
    df = spark.createDataFrame([(1, 1, {"a": 1}), (1, 2, {"b": 2})], "k int, at int, m map<string,int>")
    assert merge.latest_per_key(df, ["k"], ["at"]).head()["m"] == {"b": 2}


def test_result_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 97).alias("k"), (F.col("id") % 5).alias("at"), F.col("id").alias("v"))
    results = [rows(merge.latest_per_key(df.repartition(n), ["k"], ["at"])) for n in (1, 2, 8)]
    assert results[0] == results[1] == results[2]


def test_union_distinct(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    b = spark.createDataFrame([("b", 2), ("c", 3)], "v string, id int")
    assert rows(merge.union_distinct(a, b)) == [(1, "a"), (2, "b"), (3, "c")]


def test_upsert_takes_null_and_keeps_unnamed(spark):
    old = spark.createDataFrame([("k1", 3.0, "n"), ("k2", 2.0, "m")], "id string, gpa double, note string")
    new = spark.createDataFrame([("k1", None), ("k3", 1.0)], "id string, gpa double")
    assert rows(merge.upsert(old, new, "id")) == [("k1", None, "n"), ("k2", 2.0, "m"), ("k3", 1.0, None)]


def test_upsert_with_repeated_change(spark):
    old = spark.createDataFrame([("k1", 3.0)], "id string, gpa double")
    new = spark.createDataFrame([("k1", 1.0, 1), ("k1", 2.0, 2)], "id string, gpa double, at int")
    assert rows(merge.upsert(old, new, "id", ["at"])) == [("k1", 2.0, 2)]


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 5)], "id int, v int")
    assert rows(merge.delete_where(df, F.col("v") > 2)) == [(1, 1), (2, None)]
    assert rows(merge.update_where(df, F.col("v") > 2, v=F.lit(0))) == [(1, 1), (2, None), (3, 0)]
    keys = spark.createDataFrame([(1,), (1,)], "id int")
    assert rows(merge.delete_matching(df, keys, ["id"])) == [(2, None), (3, 5)]
    assert rows(merge.update_matching(df, keys, ["id"], v=F.lit(9))) == [(1, 9), (2, None), (3, 5)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_equals_plain_join(spark, how):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None))
                                   .otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v"))
    small = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert rows(joins.lookup_join(big, small, ["k"], how)) == rows(big.join(small, ["k"], how))


def test_hot_key_of_a_lookup_is_split(spark):
    """With both sides shuffled, the partition of a hot key is read by several tasks; no job runs before."""
    big = spark.range(400_000, numPartitions=8).select(
        F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id") % 1000).alias("k"), F.md5(F.col("id").cast("string")).alias("m"))
    small = spark.range(1000).select("id", F.lit("w").alias("w")).withColumnRenamed("id", "k")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k"}
    old = {k: spark.conf.get(k) for k in settings}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookup", "lookup")
    try:
        for k, value in settings.items():
            spark.conf.set(k, value)
        joined = joins.lookup_join(big, small, ["k"])
        assert not tracker.getJobIdsForGroup("lookup")
        # no aggregate by the key above the join: it would ask for all rows of a key in one task
        seen = joined.select("k", F.hash("m").alias("h"), F.spark_partition_id().alias("t")).toPandas()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, value in old.items():
            spark.conf.set(k, value)
    hot = seen[seen.k == 1]
    assert len(seen) == 400_000 and len(hot) == 360_000 and hot.t.nunique() >= 3


def test_latest_of_rows_with_a_map_inside_an_array(spark):
    df = spark.sql("SELECT 1 AS k, 1 AS at, array(map('a', 1)) AS m UNION ALL SELECT 1, 2, array(map('b', 2))")
    assert merge.latest_per_key(df, ["k"], ["at"]).head()["m"] == [{"b": 2}]


def test_lookup_refuses_outer_joins(spark):
    with pytest.raises(ValueError):
        joins.lookup_join(spark.range(1), spark.range(1), ["id"], "full_outer")
