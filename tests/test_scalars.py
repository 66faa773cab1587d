"""Hand-derived cases of the column functions."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from retentia.functions import scalars as s


def run(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.coalesce(1).select(fn(F.col("v"))).collect()]


def test_update_date(spark):
    assert run(spark, ["01/02/2024 10:00", "bad", None], s.parse_update_date) == [
        datetime(2024, 1, 2, 10), None, None]


def test_bools(spark):
    text = [" Yes ", "TRUE", "1", "no", None, "\tyes\n"]
    assert run(spark, text, s.str_to_bool) == [True, True, True, False, False, True]
    assert run(spark, [" Yes ", "TRUE", "1", "no", None], s.ingest_bool) == [False, True, True, False, None]
    assert run(spark, [1, 0, None], s.ingest_bool, "v int") == [True, False, None]


def test_numbers(spark):
    assert run(spark, ["3.5", " 4 ", "x", None, "1e2", "1.5d", "NaN", "", "-.5", "7."], s.safe_float) == [
        3.5, 4.0, None, None, 100.0, None, None, None, -0.5, 7.0]
    assert run(spark, ["3", "3.0", " 4", "x", "99999999999"], s.safe_int) == [3, None, 4, None, None]


def test_blank(spark):
    assert run(spark, ["", "  ", "a", " b ", None], s.blank_to_null) == [None, None, "a", " b ", None]


def test_labels(spark):
    assert run(spark, ["Yes", "yes", "No", "no", "true", "false", "perhaps"], s.label_map) == [1, 1, 0, 0, 1, 0, None]
    assert run(spark, [True, False], s.label_map, "v boolean") == [1, 0]
    assert run(spark, ["1", "0.9", "Yes", "maybe", None, "2", "-1"], s.label_parse) == [
        True, False, True, False, None, True, True]


def test_derived_label(spark):
    rows = [(1.9, 95.0), (3.0, 69.9), (2.0, 70.0), (None, 60.0), (None, None),
            (3.5, 95.0), (2.8, 85.0), (1.9, 60.0), (2.2, 75.0), (3.9, 98.0)]
    df = spark.createDataFrame(rows, "g double, a double").coalesce(1)
    got = [r[0] for r in df.select(s.derived_label(F.col("g"), F.col("a"))).collect()]
    assert got == [True, True, False, True, False, False, False, True, False, False]


def test_age(spark):
    df = spark.createDataFrame([("2024-05-09",), ("2024-05-10",)], "d string").coalesce(1)
    got = [r[0] for r in df.select(s.age_years(F.lit("2003-05-10").cast("date"), F.col("d").cast("date"))).collect()]
    assert got == [20, 21]


def test_date_texts(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 5, 15, 4),), (datetime(2024, 1, 5, 0, 0, 1, 500),)], "t timestamp").coalesce(1)
    t = F.col("t")
    rows = df.select(s.date_text(t), s.weekday_text(t), s.clock_text(t), s.iso_text(t)).collect()
    assert tuple(rows[0]) == ("2024-01-05", "Friday", "03:04 PM", "2024-01-05T15:04:00")
    assert rows[1][3] == datetime(2024, 1, 5, 0, 0, 1, 500).isoformat()


def test_title_case_equals_python(spark):
    names = ["random_forest", "x", "k-means2d run", "ALL_caps", "", "a__b", "école_élan", "it's"]
    assert run(spark, names, s.title_case) == [n.replace("_", " ").title() for n in names]


def test_display_name(spark):
    df = spark.createDataFrame([("ds1", "classification", "random_forest", 0.8765)], "d string, t string, m string, a double")
    got = df.select(s.display_name(*[F.col(c) for c in "dtma"])).head()[0]
    assert got == "ds1 | Classification | Random Forest | Acc: 87.65%"


def test_fixed_text_equals_python(spark):
    rng = random.Random(1)
    values = [0.125, 2.675, 1.005, 0.5, 1234567.891, -0.375, 0.0] + [rng.uniform(-1e4, 1e4) for _ in range(500)]
    assert run(spark, values, s.fixed_text, "v double") == [f"{x:.2f}" for x in values]
    assert run(spark, values, s.round_even, "v double") == [round(x, 2) for x in values]


def test_email(spark):
    import re
    cases = ["a.b-c@d.org", "a@b", "a b@c.de", "ä@ö.de", "x@y.z\n", "x@y.z\n\n", "@a.b", "a@b.c d", "a@b.c-d"]
    want = [re.match(s.EMAIL_PATTERN, c) is not None for c in cases]
    assert run(spark, cases, s.is_email) == want


def test_rating(spark):
    assert run(spark, ["0", "1", "5", "6", "", None, "2.5"], s.in_rating_range) == [
        False, True, True, False, False, False, False]


def test_alert_targets(spark):
    assert run(spark, ["student", "teacher", None], s.alert_targets) == [
        ["teacher", "admin", "analyst"], ["admin", "analyst"], ["admin", "analyst"]]


def test_fingerprint_depends_on_order(spark):
    import hashlib
    df = spark.createDataFrame([(["a", "b"],), (["b", "a"],)], "n array<string>").coalesce(1)
    got = [r[0] for r in df.select(s.name_fingerprint(F.col("n"))).collect()]
    assert got == [hashlib.sha256(x).hexdigest() for x in (b"a,b", b"b,a")]


@pytest.mark.parametrize("path,name", [("/a/b/c.csv", "c.csv"), ("c.csv", "c.csv")])
def test_base_name(spark, path, name):
    assert run(spark, [path], s.base_name) == [name]
