"""Files, versions, streaming and whole jobs."""

import contextlib
import io
import os
import time

import pytest
from pyspark.sql import functions as F

from retentia.plans import jobs
from retentia.schemas import raw_text_schema
from retentia.session import scratch_path
from retentia.sources import deliveries, files, keyed, tables
from retentia.streaming import incremental


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)


def test_corrupt_lines_are_kept(spark, tmp_path):
    put(tmp_path, "a.csv", "id,v\n1,2\nx,3\n")
    got = files.read_csv(spark, str(tmp_path), spark.createDataFrame([], "id int, v int").schema, keep_corrupt=True)
    assert [r["_corrupt_record"] for r in got.orderBy("v").collect()] == [None, "x,3"]


def test_latest_file(spark, tmp_path):
    schema = spark.createDataFrame([], "id int").schema
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    put(folder, "note.txt", "x")
    with pytest.raises(FileNotFoundError):
        files.read_latest(spark, folder, schema)
    put(folder, "a.csv", "id\n1\n")
    put(folder, "b.json", '{"id": 2}\n')
    os.utime(f"{folder}/a.csv", (time.time() + 50,) * 2)
    assert rows(files.read_latest(spark, folder, schema)) == [(1,)]
    os.utime(f"{folder}/b.json", (time.time() + 100,) * 2)
    assert rows(files.read_latest(spark, folder, schema)) == [(2,)]
    assert [r["name"] for r in files.files_with_suffix(files.list_files(spark, folder), ["csv", "xlsx"]).collect()] == ["a.csv"]


def test_versions_are_computed_from_themselves(spark):
    root = scratch_path(spark, "v")
    assert tables.current(spark, root) is None
    tables.publish(spark.range(5), root)
    name = tables.publish(tables.current(spark, root).filter("id > 2"), root)
    assert name == "dataset_2" and rows(tables.current(spark, root)) == [(3,), (4,)]


def test_merge_job(spark, tmp_path):
    schema = raw_text_schema(["Student ID", "Update Date", "v"])
    root = scratch_path(spark, "merge")
    put(tmp_path / "1", "a.csv", "Student ID,Update Date,v\n1,01/01/2024 09:00,a\n2,,c\n")
    put(tmp_path / "2", "a.csv", "Student ID,Update Date,v\n1,01/02/2024 09:00,b\n3,bad,d\n")
    jobs.merge_job(spark, str(tmp_path / "1"), root, schema)
    jobs.merge_job(spark, str(tmp_path / "2"), root, schema)
    jobs.merge_job(spark, str(tmp_path / "1"), root, schema)
    assert rows(tables.current(spark, root).select("Student ID", "v")) == [("1", "b"), ("2", "c"), ("3", "d")]


def test_store_delivery(spark):
    root = scratch_path(spark, "deliveries")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert jobs.store_delivery(a, root) == "dataset_1"
    b = spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string")
    assert jobs.store_delivery(b, root) == "merged_dataset_2"
    assert rows(deliveries.read(spark, deliveries.home_of(b, root))) == [(1, "a"), (2, "b"), (3, "c")]
    assert jobs.store_delivery(b.select("v", "id"), root) == "dataset_1"


def test_deliveries_keep_every_distinct_row_and_tell_nulls_apart(spark):
    home = scratch_path(spark, "deliveries")
    assert deliveries.read(spark, home) is None
    first = [(None, "x", 0.0), ("x", None, 0.0), ("", "x", -0.0), ("", "x", 0.0), ("a", "b", float("nan")), ("a", "b", float("nan"))]
    schema = "p string, q string, z double"
    deliveries.store(spark.createDataFrame(first, schema), home)
    assert deliveries.read(spark, home).count() == 6  # one delivery stays as it came
    deliveries.store(spark.createDataFrame([*first, ("x", "", 0.0), (None, None, None), (None, None, None)], schema), home)
    assert deliveries.read(spark, home).count() == 6 == deliveries.read(spark, home).distinct().count()
    deliveries.store(spark.createDataFrame([], schema), home)
    assert deliveries.read(spark, home).count() == 6


def test_a_delivery_neither_reads_nor_rewrites_old_rows(spark):
    home = scratch_path(spark, "deliveries")
    draw = lambda a, b: spark.range(a, b).select("id", F.md5(F.col("id").cast("string")).alias("v"))
    deliveries.store(draw(0, 20_000), home)
    part = os.listdir(f"{home}/rows")[0]
    os.rename(f"{home}/rows/{part}", f"{home}/aside")
    deliveries.store(draw(19_900, 20_100), home)  # the old rows are out of reach
    new = next(p for p in os.listdir(f"{home}/rows"))
    assert spark.read.parquet(f"{home}/rows/{new}").count() == 100
    os.rename(f"{home}/aside", f"{home}/rows/{part}")
    assert deliveries.read(spark, home).count() == 20_100


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_keyed_table_equals_plain_merges(spark):
    from retentia.operators import merge

    root = scratch_path(spark, "keyed")
    plain = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"), F.lit("x").alias("b"))
    table = keyed.create(plain, root, "k", buckets=8)

    def same():
        return rows(table.read()) == rows(plain)

    changes = spark.range(990, 1010).select(F.col("id").alias("k"), F.lit(None).cast("long").alias("a"), F.lit(1).alias("c"))
    table.upsert(changes)
    plain = merge.upsert(plain, changes, "k").checkpoint()
    assert same() and table.read().columns == ["k", "a", "b", "c"]
    before = table._entries()[-1]["number"]
    table.update_where(F.col("a") < 100, b=F.lit("low"))
    plain = merge.update_where(plain, F.col("a") < 100, b=F.lit("low")).checkpoint()
    table.delete_where(F.col("k") % 10 == 3)
    plain = merge.delete_where(plain, F.col("k") % 10 == 3).checkpoint()
    table.delete_keys(spark.createDataFrame([(5,), (5000,)], "k long"))
    plain = plain.filter("k <> 5").checkpoint()
    assert same() and table.read(before).count() == 1010
    assert table.compact(share=0.05) and same() and table.read(before).count() == 1010
    again = spark.createDataFrame([(5, 7, "back", 1), (5, 8, "last", 2)], "k long, a long, b string, t int")
    table.upsert(again, order=["t"])
    assert rows(keyed.open_table(spark, root).read().filter("k = 5").select("a", "b", "t")) == [(8, "last", 2)]
    with pytest.raises(ValueError):
        table.upsert(again)
    with pytest.raises(ValueError):
        keyed.create(spark.createDataFrame([(None,)], "k long"), root + "-null", "k")


def test_an_upsert_of_one_row_in_a_hundred_writes_as_much(spark):
    root = scratch_path(spark, "keyed")
    rows_ = spark.range(200_000).select(F.col("id").alias("k"), *[F.sha2(F.concat(F.col("id"), F.lit(i)), 256).alias(f"v{i}") for i in range(6)])
    table = keyed.create(rows_, root, "k", buckets=8)
    whole = size(root)
    table.upsert(rows_.filter("k % 100 = 7").select("k", F.lit("new").alias("v0")))
    assert size(root) - whole < 0.02 * whole
    # only the grown buckets are written anew
    few = table.read().filter(F.pmod(F.xxhash64("k"), F.lit(8)) == 3).select("k", F.lit("hot").alias("v1"))
    table.upsert(few)
    whole = size(root)
    assert table.compact() == [3] and size(root) - whole < 0.2 * whole
    assert table.read().filter("v1 = 'hot'").count() == few.count() and table.read().count() == 200_000


def test_newest_delivery_of_several_files(spark):
    landing = scratch_path(spark, "landing")
    df = spark.range(50).select("id", F.concat(F.lit("a,"), "id").alias("v")).repartition(4)
    with pytest.raises(Exception):
        files.read_latest_delivery(spark, landing, df.schema)
    tables.write_csv(df, f"{landing}/one")
    time.sleep(0.05)
    tables.write_csv(df.filter("id < 20"), f"{landing}/two")
    got = files.read_latest_delivery(spark, landing, df.schema)
    assert rows(got) == rows(df.filter("id < 20")) and len(got.inputFiles()) > 1


def test_headers_with_quoted_names(spark, tmp_path):
    put(tmp_path / "x", "a.csv", '"a ""b"", c",d,"",e\n1,2,3,4\n')
    put(tmp_path / "y", "b.csv", "one\n")
    got = {}
    for r in files.csv_headers(spark, str(tmp_path)).orderBy("file", "position").collect():
        got.setdefault(os.path.basename(r["file"]), []).append(r["name"])
    assert got == {"a.csv": ['a "b", c', "d", "", "e"], "b.csv": ["one"]}


def test_delete_tagged(spark):
    path = scratch_path(spark, "tags")
    a = tables.store_tagged(spark.range(3), path)
    b = tables.store_tagged(spark.range(2).withColumnRenamed("id", "k"), path)
    tables.delete_tagged(spark, path, a, path + "-new")
    assert a != b and spark.read.parquet(path + "-new").count() == 2


def test_ingest_job(spark):
    root = scratch_path(spark, "students")
    first = spark.createDataFrame([("1", "3.0"), ("2", "1.0"), ("", "2")], ["student ID", "currentGPA"])
    _, rejected = jobs.ingest_job(spark, first, root, "2024-01-01")
    jobs.ingest_job(spark, spark.createDataFrame([("2", "x")], ["Student ID", "currentGPA"]), root, "2024-01-02")
    assert rejected.count() == 1
    assert rows(tables.current(spark, root).select("student_id", "currentGPA", "dropout")) == [
        ("1", 3.0, False), ("2", None, False)]


def test_ingest_takes_the_last_row_of_a_file_and_both_spellings(spark):
    root = scratch_path(spark, "students")
    up = spark.createDataFrame([("s1", None, "zeta"), (None, "s1", "alpha"), ("s2", None, "x")],
                               ["student ID", "student_id", "gender"]).coalesce(1)
    jobs.ingest_job(spark, up, root, "2024-01-01", "spring.csv")
    assert rows(tables.current(spark, root).select("student_id", "gender")) == [("s1", "alpha"), ("s2", "x")]
    entry = spark.read.parquet(f"{root}/datasets").head()
    assert (entry["original_file_name"], entry["row_count"], entry["ingested_row_count"]) == ("spring.csv", 3, 3)


def test_csv_keeps_quotes_and_line_ends_and_empty_is_null(spark):
    path = scratch_path(spark, "csv")
    values = ['say "hi", ok', "two\nlines", "back\\slash \\\" end", "", None, ",", ' pad ', '"']
    df = spark.createDataFrame(list(enumerate(values)), "id int, text string")
    tables.write_csv(df, path)
    assert rows(files.read_csv(spark, path, df.schema)) == [(i, v or None) for i, v in enumerate(values)]


def test_records_that_do_not_fit_are_returned(spark, tmp_path):
    root = scratch_path(spark, "merge")
    schema = spark.createDataFrame([], "`Student ID` int, `Update Date` string, v int").schema
    put(tmp_path, "a.csv", "Student ID,Update Date,v\n1,01/01/2024 09:00,1\nx,,2\ny,,3\n4,,bad\n")
    _, rejected = jobs.merge_job(spark, str(tmp_path), root, schema)
    assert rejected.count() == 3 and tables.current(spark, root).count() == 1


def test_second_upload_of_a_name_keeps_the_first(spark):
    root = scratch_path(spark, "store")
    for n in (5, 2):
        tables.store_dataset(spark.range(n), root, "a", "8", False, "2024-01-01")
    assert spark.read.parquet(f"{root}/data").count() == 7
    assert rows(spark.read.parquet(f"{root}/datasets").select("record_count")) == [(2,), (5,)]


def test_stream_late_rows_lose_and_reruns_change_nothing(spark, tmp_path):
    landing, table = str(tmp_path / "in"), scratch_path(spark, "stream")
    schema = spark.createDataFrame([], "k int, at int, v string").schema
    run = lambda: incremental.run_incremental(spark, landing, table, schema, ["k"], ["at"], files_per_batch=1)
    read = lambda: rows(incremental.read_incremental(spark, table, ["k"], ["at"]))
    put(landing, "1.csv", "k,at,v\n1,5,new\n2,1,x\n")
    run()
    put(landing, "2.csv", "k,at,v\n1,3,late\n3,1,y\n")
    run()
    want = [(1, 5, "new"), (2, 1, "x"), (3, 1, "y")]
    assert read() == want
    incremental.compact(spark, table, ["k"], ["at"])
    run()
    assert read() == want
    put(landing, "3.csv", "k,at,v\n2,9,z\n")
    run()
    assert read() == [(1, 5, "new"), (2, 9, "z"), (3, 1, "y")]


def test_upload_scores_and_writes_back(spark):
    from retentia.schemas import CATEGORICAL_FEATURES, NUMERIC_FEATURES
    from pyspark.ml import PipelineModel

    up = spark.range(300).select(
        F.col("id").cast("string").alias("student_id"),
        *[(F.rand(i) * 10).alias(c) for i, c in enumerate(NUMERIC_FEATURES)],
        *[F.when(F.rand(50 + i) < 0.5, "Yes").otherwise("No").alias(c) for i, c in enumerate(CATEGORICAL_FEATURES)])
    up = up.withColumn("dropout", F.when(F.col("social_media_hours") > F.col("attendance"), "Yes").otherwise("No")).cache()
    root = scratch_path(spark, "up")
    with pytest.raises(ValueError):
        jobs.upload_and_train(up.drop("age"), root=root)
    run = jobs.upload_and_train(up, dataset="d", root=root, targets=["age", "exam_score"],
                                classifiers=["logistic_regression"]).head()
    assert len(run["details"]) == 3
    path = run["details"][0]["model_path"]
    students = up.select(
        F.col("student_id").alias("studentID"), F.lit("2003-05-10").cast("timestamp").alias("dateOfBirth"),
        F.when(F.col("student_id") != "7", F.struct(*[c for c in NUMERIC_FEATURES if c != "age"], *CATEGORICAL_FEATURES)).alias("ml_features"))
    out = jobs.score_population(students, PipelineModel.load(path), "d", "2024-05-10")
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain()
    assert "Scan" in text.getvalue() and "Exchange" not in text.getvalue()
    assert out.count() == 300 and out.filter("prediction is null").count() == 1
    assert out.filter("studentID = '1'").head()["prediction"]["recommendations"]
    again = jobs.score_population(out, PipelineModel.load(path), "e", "2024-05-11")
    assert again.filter("prediction.model_used = 'e'").count() == 299
