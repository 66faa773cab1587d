"""The substring index against a scan, merged profiles against exact counts."""

import pytest
from pyspark.sql import functions as F

from retentia.operators import quality, selection
from retentia.session import scratch_path
from retentia.sources import profiles, text_index

TEXTS = [(0, "Attention span", "open"), (1, None, "open"), (2, "ti", "done"), (3, "ten TIONS", "done"), (4, "", None),
         (5, "Attention span", "done"), (6, "été Ünïted 😀😀😀 x", "open"), (7, "a\nb tion", "open"), (8, "tio nat ion", "open")]


@pytest.fixture(scope="module")
def indexed(spark):
    df = spark.createDataFrame(TEXTS, "id int, text string, status string")
    home = scratch_path(spark, "index")
    text_index.build(df.filter("id < 5"), home, ["text"], rows_a_block=2)
    text_index.add(df.filter("id >= 5"), home)
    return df, home


@pytest.mark.parametrize("text", ["tion", "TION", "ti", "", "span", "zzz", "😀😀😀", "ünï", "\nb ", "attention span", "a\nb tion and more"])
def test_index_finds_what_a_scan_finds(spark, indexed, text):
    df, home = indexed
    for status in (None, "done"):
        want = selection.search(df, text, ["text"], status).collect()
        got = text_index.search(spark, home, text, status)
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)


def test_few_blocks_are_read(spark):
    df = spark.range(4000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    home = scratch_path(spark, "index")
    text_index.build(df, home, rows_a_block=50)
    rare = df.filter("id = 77").head()["text"][5:17]
    got = text_index.search(spark, home, rare)
    assert [r["id"] for r in got.collect()] == [77]
    some = text_index.candidates(spark, home, rare)
    assert some.count() < 10 and "PushedFilters: [In(gram" in plan(some)
    scan = next(line for line in plan(got).splitlines() if line.startswith("PartitionFilters") and "_block" in line)
    assert scan.count(",") < 10


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "gram string, n int, block string")
    home = scratch_path(spark, "index")
    text_index.build(df, home)
    text_index.add(spark.createDataFrame([("Some words", 1, None)], df.schema), home)
    assert text_index.search(spark, home, "me wo").head()["n"] == 1
    assert text_index.search(spark, home, "absent").count() == 0


def test_profiles_add_up(spark):
    df = spark.range(20000).select("id", (F.col("id") % 300).alias("few"), F.when(F.col("id") % 3 == 0, "x").alias("gap"))
    home = scratch_path(spark, "profiles")
    for n, part in enumerate([df.filter("id < 9000"), df.filter("id >= 9000").drop("gap"), df.limit(0)], 1):
        profiles.record(part, home, "t", n)
    stored = profiles.profiles(spark, home)
    got = {r["field"]: (r["rows"], r["filled"], r["distinct_values"]) for r in profiles.catalogue(stored).collect()}
    assert {f: v[:2] for f, v in got.items()} == {"id": (20000, 20000), "few": (20000, 20000), "gap": (20000, 3000)}
    assert abs(got["id"][2] - 20000) < 600 and abs(got["few"][2] - 300) < 10 and got["gap"][2] == 1
    assert {r["field"]: r["nulls"] for r in profiles.gaps(stored, 1).collect()} == {"id": 0, "few": 0, "gap": 6000}
    grown = {(r["field"], r["version"]): r["new_values"] for r in profiles.growth(stored).collect()}
    assert grown["few", 2] == 0 and grown["few", 3] == 0 and abs(grown["id", 2] - 11000) < 600


def test_merged_profile_equals_profile_of_the_whole(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 1000).alias("a"), F.array("id").alias("b"))
    parts = profiles.profile(df.filter("id % 2 = 0"), "t", 1).union(profiles.profile(df.filter("id % 2 = 1"), "t", 2))
    whole = {r["field"]: r for r in profiles.catalogue(profiles.profile(df, "t", 1)).collect()}
    for r in profiles.catalogue(parts).collect():
        assert (r["rows"], r["filled"]) == (whole[r["field"]]["rows"], whole[r["field"]]["filled"])
        assert abs(r["distinct_values"] - whole[r["field"]]["distinct_values"]) <= 0.02 * whole[r["field"]]["distinct_values"]
    exact = {r["field"]: r["distinct_values"] for r in quality.field_catalog({"t": df.select("a")}, exact=True).collect()}
    near = {r["field"]: r["distinct_values"] for r in profiles.catalogue(parts).collect()}
    assert abs(near["a"] - exact["a"]) <= 0.03 * exact["a"]


def test_a_posting_lists_the_rows_of_a_batch(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("Common words "), F.md5(F.col("id").cast("string"))).alias("text"))
    home = scratch_path(spark, "index")
    text_index.build(df.coalesce(1), home, rows_a_block=100)
    postings = spark.read.parquet(f"{home}/postings")
    one = postings.filter("gram = 'mon'")
    assert one.count() == 1 and one.select(F.size("ids")).head()[0] == 3000
    pairs = postings.select("gram", F.explode("ids").alias("id"))
    want = df.select("id", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.lower("text").substr(i, F.lit(3))))))
    assert pairs.count() == pairs.distinct().count() == want.count()
    assert text_index.search(spark, home, "common words").count() == 3000
