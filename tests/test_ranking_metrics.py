"""Exact quantiles, codes, splits and metrics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentia.operators import features, metrics, ranking


def frame(spark, values, schema="x double"):
    return spark.createDataFrame([(None if v is None else v,) for v in values], schema)


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.9, 1.0])
def test_quantile(spark, p):
    rng = np.random.default_rng(3)
    values = [float(v) for v in rng.integers(0, 50, 700)] + [7.0] * 400 + [float(v) for v in rng.normal(size=300)]
    got = ranking.exact_quantile(frame(spark, values + [None]), "x", p).head()["q"]
    assert got == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_quantile_of_nothing_and_of_one(spark):
    assert ranking.exact_quantile(frame(spark, [None]), "x", 0.5).head()["q"] is None
    assert ranking.exact_quantile(frame(spark, [4.0]), "x", 0.5).head()["q"] == 4.0


def test_quantiles_of_many_columns_at_once(spark):
    rng = np.random.default_rng(8)
    table = {"a": rng.normal(size=5000), "b": rng.integers(0, 3, 5000).astype(float), "c": np.full(5000, np.nan),
             "d": np.where(rng.random(5000) < 0.3, np.nan, rng.exponential(size=5000)), "e": np.r_[np.inf, -np.inf, np.zeros(4998)]}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*table.values())], ", ".join(f"{c} double" for c in table))
    for p in (0.0, 0.013, 0.5, 0.77, 1.0):
        got = {r["feature"]: r["q"] for r in ranking.exact_quantiles(df, list(table), p).collect()}
        assert got.pop("c") is None
        for c, q in got.items():
            assert q == np.quantile(table[c][~np.isnan(table[c])], p, method="lower") or q == pytest.approx(
                np.quantile(table[c][~np.isnan(table[c])], p))


def test_bounds_that_miss_the_rank_are_widened(spark, monkeypatch):
    df = frame(spark, [float(i) for i in range(101)])
    from pyspark.sql.classic.dataframe import DataFrame
    monkeypatch.setattr(DataFrame, "approxQuantile", lambda *_: [[70.0, 90.0]])
    assert ranking.exact_quantile(df, "x", 0.5).head()["q"] == 50.0


def test_medians_need_as_many_jobs_for_forty_columns_as_for_four(spark):
    df = spark.range(3000).select(*[(F.rand(i) * i).alias(f"x{i}") for i in range(40)]).cache()
    df.count()

    def jobs(n):
        spark.sparkContext.setJobGroup(f"m{n}", "medians")
        assert len(ranking.exact_medians(df, df.columns[:n]).collect()) == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"m{n}"))

    try:
        assert 0 < jobs(40) <= jobs(4)
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_running_totals(spark):
    df = spark.range(2000).select(F.col("id").alias("v"), (F.col("id") % 7).alias("n"))
    got = {r["v"]: r["n_before"] for r in ranking.running_totals(df, "v", ["n"]).collect()}
    total = 0
    for i in range(2000):
        assert got[i] == total
        total += i % 7


def test_category_codes(spark):
    df = frame(spark, ["Male", "Female", None, "Male"], "g string")
    assert sorted((str(r["g"]), r["code"]) for r in ranking.category_codes(df, "g").collect()) == [
        ("Female", 0), ("Male", 1), ("Male", 1), ("None", -1)]


def test_category_codes_of_a_long_list(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), (F.col("id") % 900).cast("string"))).alias("g"))
    want = {(r["g"], r["code"]) for r in ranking.category_codes(df, "g").collect()}
    names = sorted({g for g, _ in want if g})
    assert want == {(None, -1), *((g, i) for i, g in enumerate(names))}


def test_classification_metrics(spark):
    cells = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    got = metrics.classification_metrics(spark.createDataFrame(cells, "label int, prediction int")).head()
    assert tuple(got) == pytest.approx((0.7, 0.75, 0.6, 2 / 3))
    none = metrics.classification_metrics(spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")).head()
    assert tuple(none) == (0.5, 0.0, 0.0, 0.0)


def test_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, probability double")
    assert metrics.roc_auc(df).head()[0] == 0.75
    assert metrics.roc_auc(df.filter("label = 1")).head()[0] is None


def test_auc_equals_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = spark.range(3000).select((F.rand(1) < 0.3).cast("double").alias("label"), F.round(F.rand(2), 2).alias("probability"))
    df = df.withColumn("probability", F.col("probability") + 0.2 * F.col("label")).cache()
    want = BinaryClassificationEvaluator(rawPredictionCol="probability", numBins=0).evaluate(df)
    assert metrics.roc_auc(df).head()[0] == pytest.approx(want, abs=1e-9)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "label int, prediction double")
    assert tuple(metrics.regression_metrics(df).head()) == pytest.approx((1 / 3, 0.5))


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "label int")
    assert {r["label"]: r["weight"] for r in metrics.class_weights(df).collect()} == {0: 0.625, 1: 2.5}


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = features.stratified_holdout(df, "id", "y")
    assert {(r["y"], r["n"]) for r in out.filter("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 180), (1, 20)}
    again = features.stratified_holdout(df.repartition(3), "id", "y")
    assert out.filter("is_test").exceptAll(again.filter("is_test")).count() == 0


def test_impute_and_scale(spark):
    df = frame(spark, [1.0, 2.0, 4.0, None])
    got = sorted(r["x"] for r in features.standardise(df, ["x"]).collect())
    filled = np.array([1, 2, 4, 7 / 3])
    assert got == pytest.approx(sorted((filled - filled.mean()) / filled.std()))
    assert features.standardise(frame(spark, [3.0, 3.0]), ["x"]).head()["x"] == 0.0
    medians = ranking.exact_medians(df, ["x"])
    assert sorted(r["x"] for r in features.impute_medians(df, ["x"], medians).collect()) == [1, 2, 2, 4]


def test_encodings(spark):
    df = frame(spark, ["b", "a", None], "c string").coalesce(1)
    assert [tuple(r) for r in features.one_hot(df, ["c"]).collect()] == [(0, 1, 0), (1, 0, 0), (0, 0, 1)]
    assert [tuple(r) for r in features.dummies(df, ["c"]).collect()] == [(1,), (0,), (0,)]
    assert len(features.dummies(spark.range(1500), ["id"]).columns) == 1499
    assert features.one_hot(df, ["c"], {"c": ["a", "z"]}).columns == ["c_a", "c_z"]


def test_gaps_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double").coalesce(1)
    assert [r["x"] for r in features.impute_means(df, ["x"]).collect()] == [1.0, 2.0, 3.0, 2.0]
    scaled = [r["x"] for r in features.standardise(df, ["x"]).collect()]
    assert scaled == pytest.approx([-(2 ** 0.5), 0, 2 ** 0.5, 0])
    far = spark.createDataFrame([(float("inf"),)] * 5 + [(1.0,), (2.0,), (float("-inf"),)], "x double")
    assert ranking.exact_quantile(far, "x", 2 / 7).head()["q"] == 2.0


def test_splits_keep_null_keys_and_null_classes(spark):
    df = spark.createDataFrame([(i if i % 4 else None, None if i % 3 == 0 else i % 2) for i in range(300)], "id int, y int")
    train, test = features.holdout(df, "id")
    assert train.count() + test.count() == 300
    out = features.stratified_holdout(df, "id", "y")
    per_class = {r["y"]: r["n"] for r in out.filter("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert out.count() == 300 and per_class == {None: 20, 0: 20, 1: 20}


def test_training_frame_fills_defaults(spark):
    df = spark.createDataFrame([(20.0, " Yes "), (None, None)], "age double, part_time_job string").coalesce(1)
    first, second = features.training_frame(df).collect()
    assert first["part_time_job"] and not second["part_time_job"] and second["age"] == 20.0
    assert second["gender"] == "missing" and second["dropout"] is False
