"""Sparse categories against the wide encoding and a dense fit."""

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from retentia.operators import encoding, features, training
from retentia.session import scratch_path


def frame(spark):
    return spark.createDataFrame([(0, "b", "x"), (1, "a", None), (2, None, "y"), (3, "b", "x")], "id int, c string, d string")


def test_codes_follow_column_and_value(spark):
    codes = encoding.fit_codes(frame(spark), ["c", "d"], 5)
    assert [tuple(r) for r in codes.orderBy("code").collect()] == [
        ("c", "a", 5), ("c", "b", 6), ("c", "missing", 7), ("d", "missing", 8), ("d", "x", 9), ("d", "y", 10)]
    assert encoding.fit_codes(frame(spark).limit(0), ["c"]).count() == 0


def test_sparse_equals_wide(spark):
    df = frame(spark)
    codes = encoding.fit_codes(df, ["c", "d"])
    names = [f"{r['column']}_{r['value']}" for r in codes.orderBy("code").collect()]
    wide = {r["id"]: [i for i, n in enumerate(names) if r[n] == 1.0] for r in features.one_hot(df, ["c", "d"]).collect()}
    assert {r["id"]: r["codes"] for r in encoding.one_hot_sparse(df, ["c", "d"], codes).collect()} == wide
    few = features.dummies(df, ["c", "d"])
    wide = {r["id"]: [i for i, n in enumerate(names) if n in few.columns and r[n] == 1.0] for r in few.collect()}
    assert {r["id"]: r["codes"] for r in encoding.dummies_sparse(df, ["c", "d"], codes).collect()} == wide


def test_unknown_values_have_no_place(spark):
    codes = encoding.fit_codes(frame(spark).filter("id = 1"), ["c", "d"])
    assert [r["codes"] for r in encoding.one_hot_sparse(frame(spark), ["c", "d"], codes).orderBy("id").collect()] == [
        [], [0, 1], [], []]


def labelled(spark, rows, values):
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    return spark.range(rows).select(
        "id", F.when(F.col("id") % 11 != 0, h).alias("x"), F.concat(F.lit("v"), F.pmod(F.hash("id"), F.lit(values))).alias("c")
    ).withColumn("y", ((F.coalesce("x", F.lit(0.5)) > 0.5) != (F.hash("c") % 3 == 0)).cast("int").cast("string"))


def test_sparse_fit_equals_dense_fit(spark):
    df = labelled(spark, 1500, 7)
    found = encoding.train_sparse(df, "id", "y", ["x"], ["c"], scratch_path(spark, "sparse"))
    usable, _ = training.split_labelled(df, "y")
    train = features.stratified_holdout(usable, "id", "label").filter(~F.col("is_test"))
    prep = training.fit_preprocessor(train, ["x"], ["c"])
    rows = training.weighted(prep.transform(train))
    dense = LogisticRegression(labelCol="label", weightCol="weight", maxIter=1000, standardization=False,
                               regParam=1.0 / train.count()).fit(rows)
    want = {r["id"]: r["p"] for r in dense.transform(prep.transform(df)).select("id", training.class_one_probability().alias("p")).collect()}
    got = {r["id"]: r["probability"] for r in encoding.score_sparse(df, found["model_path"], ["id"]).collect()}
    assert len(got) == 1500 and np.allclose([got[i] for i in want], list(want.values()), atol=1e-4)
    assert found["metrics"]["roc_auc"] > 0.7


def test_a_million_values_train_and_score(spark):
    df = spark.range(1_000_000).select("id", F.concat(F.lit("v"), "id").alias("c"), F.when(
        F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("d"),
        (F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    found = encoding.train_sparse(df, "id", "y", ["x"], ["c", "d"], scratch_path(spark, "sparse"))
    assert found["metrics"]["accuracy"] == 1.0
    assert encoding.score_sparse(df, found["model_path"], ["id"]).count() == 1_000_000


def test_numbers_alone_and_categories_alone(spark):
    df = labelled(spark, 400, 5)
    for numeric, categorical in ((["x"], []), ([], ["c"])):
        path = encoding.train_sparse(df, "id", "y", numeric, categorical, scratch_path(spark, "sparse"))["model_path"]
        assert encoding.score_sparse(df, path, ["id"]).filter("probability between 0 and 1").count() == 400


def test_many_values_are_fitted_as_tables(spark, monkeypatch):
    monkeypatch.setattr(encoding, "HOT_ROWS", 50)  # the value "hot" is added up in slices
    df = spark.range(900).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 50.0).alias("x"), F.concat(
        F.lit("c"), F.pmod(F.hash("id"), F.lit(40))).alias("c"), F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(
        F.concat(F.lit("d"), F.pmod(F.hash("id", F.lit(1)), F.lit(60)))).alias("d"), (F.col("id") % 2).cast("string").alias("e"))
    codes = encoding.fit_codes(df, ["c", "d", "e"], 1)
    home = scratch_path(spark, "sparse")
    rows = encoding.with_codes(df, ["c", "d", "e"], codes).select(
        ((F.pmod(F.hash("id", F.lit(2)), F.lit(10)) + 2 * F.col("x") + F.col("_code_c") % 4 + F.col("_code_e") % 2) > 8).cast("double").alias("label"),
        (1 + F.col("_code_e") % 2 / 2.0).alias("weight"), F.col("x").alias("_x0"), "_code_c", "_code_d", "_code_e")
    rows.write.parquet(f"{home}/vectors")
    numbers, intercept, narrow, wide = encoding.fit_logistic(spark.read.parquet(f"{home}/vectors"), 1, ["c", "d", "e"], codes, home)
    assert len(narrow) == 2 and sorted(wide) == ["c", "d"]
    beta = {**narrow, **{r["code"]: r["weight"] for w in wide.values() for r in w.collect()}}
    assert sorted(beta) == [r["code"] for r in codes.orderBy("code").collect()]
    got = np.array(spark.read.parquet(f"{home}/vectors").collect(), dtype=float)
    y, a, x, places = got[:, 0], got[:, 1], got[:, 2], got[:, 3:].astype(int)
    m = intercept + numbers[0] * x + np.array([[beta[k] for k in r] for r in places]).sum(axis=1)
    r, fine = a * (1 / (1 + np.exp(-m)) - y), a.sum() / len(y)
    slopes = [r.sum(), r @ x + fine * numbers[0], *[r[(places == k).any(axis=1)].sum() + fine * b for k, b in beta.items()]]
    assert 0.05 < y.mean() < 0.95 and max(abs(b) for b in beta.values()) > 0.1 and np.abs(slopes).max() < 0.05
