"""Files, sinks, versioned tables and incremental ingest, written below the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.functions.scalars import UPDATE_DATE_FORMAT, date_text, parse_update_date
from retentia.operators import merge
from retentia.operators.quality import schema_fingerprints
from retentia.plans import views as v
from retentia.plans.catalog.base import query
from retentia.plans.jobs import store_delivery as store_new
from retentia.session import scratch_path
from retentia.sources import deliveries, files, keyed, tables
from retentia.streaming import incremental


@query("csv_roundtrip", "SELECT * FROM documents")
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    rows = v.table(spark, sf, "documents")
    tables.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


@query("json_roundtrip", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type, value, props FROM events")
def json_roundtrip(spark, sf):
    path = scratch_path(spark, "json")
    events = v.table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type", "value", "props")
    events.write.json(path)
    return files.read_json(spark, path, events.schema)


@query("append_partitioned", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def append_partitioned(spark, sf):
    """Two appends to one partitioned table, read back and counted."""
    path = scratch_path(spark, "events")
    events = v.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    late = F.col("user_id") >= 50
    tables.append_rows(events.filter(~late), path, ["event_type"])
    tables.append_rows(events.filter(late), path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("store_dataset", """
SELECT 'orders' AS dataset_name, '8' AS user_id, true AS is_paid, count(*) AS record_count FROM orders
UNION ALL SELECT 'parts', '9', false, count(*) FROM part
""")
def store_dataset(spark, sf):
    """Datasets stored with their metadata rows."""
    root = scratch_path(spark, "store")
    tables.store_dataset(v.table(spark, sf, "orders"), root, "orders", "8", True, "2024-05-10")
    tables.store_dataset(v.table(spark, sf, "part"), root, "parts", "9", False, "2024-05-11")
    return spark.read.parquet(f"{root}/datasets").select("dataset_name", "user_id", "is_paid", "record_count")


@query("store_tagged", """
SELECT sha256('c_custkey,c_nationkey') AS hash, count(*) AS n FROM customer UNION ALL
SELECT sha256('c_nationkey,c_custkey'), count(*) FROM customer
""")
def store_tagged(spark, sf):
    """Rows stored under the fingerprint of their header; the column order matters."""
    path = scratch_path(spark, "tagged")
    rows = v.table(spark, sf, "customer")
    tables.store_tagged(rows.select("c_custkey", "c_nationkey"), path)
    tables.store_tagged(rows.select("c_nationkey", "c_custkey"), path)
    return spark.read.parquet(path).groupBy("hash").agg(F.count("*").alias("n"))


@query("versioned_merge", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'
""")
def versioned_merge(spark, sf):
    """A table changed from itself: a delete, then an update; each writes the rows it touches."""
    rows = v.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    table = keyed.create(rows, scratch_path(spark, "versions"), "c_custkey", buckets=16)
    table.delete_where(F.col("c_mktsegment") == "BUILDING")
    table.update_where(F.col("c_acctbal") < 0, c_acctbal=F.lit(0.0))
    return table.read().select("c_custkey", "c_acctbal")


@query("upsert_on_read", """
SELECT c_custkey, c_name, CASE WHEN o.c_custkey IS NOT NULL THEN o.c_acctbal ELSE c.c_acctbal END AS c_acctbal
FROM customer c FULL JOIN (
  SELECT o_custkey AS c_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS c_acctbal
  FROM orders WHERE o_orderpriority = '1-URGENT'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o USING (c_custkey)
WHERE c_custkey % 5 <> 0
""")
def upsert_on_read(spark, sf):
    """Balances changed by the last urgent order, compacted, then accounts deleted by key; read through the changes."""
    rows = v.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    table = keyed.create(rows, scratch_path(spark, "keyed"), "c_custkey", buckets=16)
    orders = v.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("c_acctbal"),
        "o_orderdate", "o_orderkey")
    last = merge.latest_per_key(orders, ["c_custkey"], ["o_orderdate", "o_orderkey"])
    table.upsert(last.select("c_custkey", "c_acctbal"))
    table.compact()
    table.delete_keys(table.read().filter(F.col("c_custkey") % 5 == 0))
    return table.read()


@query("store_delivery", """
SELECT DISTINCT text, lang, source, n_chars FROM documents
""")
def store_delivery(spark, sf):
    """Deliveries with one header merged without exact duplicates; each adds the rows that are new."""
    root = scratch_path(spark, "deliveries")
    docs = v.table(spark, sf, "documents").select("text", "lang", "source", "n_chars")
    store_new(docs.filter(F.col("lang") != "fr"), root)
    store_new(docs.filter(F.col("n_chars") > 0), root)
    return deliveries.read(spark, deliveries.home_of(docs, root))


@query("file_pick", "SELECT * FROM documents WHERE lang = 'en'")
def file_pick(spark, sf):
    """The newest delivery of a landing folder, as many files as its writer had tasks, then its rows."""
    landing = scratch_path(spark, "landing")
    docs = v.table(spark, sf, "documents")
    tables.write_csv(docs, f"{landing}/a")
    tables.write_csv(docs.filter(F.col("lang") == "en"), f"{landing}/b")
    return files.read_latest_delivery(spark, landing, docs.schema)


@query("file_listing", " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, true AS has_bytes" for t in (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations").split()))
def file_listing(spark, sf):
    """Names of the table files, sorted, without opening any."""
    return files.files_with_suffix(files.list_files(spark, sf), ["parquet"]).select(
        "name", (F.col("length") > 0).alias("has_bytes"))


@query("delivered_headers", """
SELECT sha256('doc_id,lang') AS fingerprint, lang AS delivery, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT sha256('doc_id,text,lang,source,n_chars,a "quoted, name"'), 'all', count(*) FROM documents
""")
def delivered_headers(spark, sf):
    """Fingerprints of the headers of all delivered CSV files, with the rows that came under each."""
    landing = scratch_path(spark, "headers")
    docs = v.table(spark, sf, "documents").withColumn('a "quoted, name"', F.lit(1))
    tables.write_csv(docs, f"{landing}/delivery=all")
    short = docs.select("doc_id", "lang", F.col("lang").alias("delivery"))
    short.write.options(**files.CSV_OPTIONS).mode("append").partitionBy("delivery").csv(landing)
    found = schema_fingerprints(files.csv_headers(spark, landing))
    deliveries_of = found.select(F.regexp_extract("file", "delivery=([^/]*)/", 1).alias("delivery"), "fingerprint").distinct()
    rows = spark.read.options(**files.CSV_OPTIONS, multiLine=True, recursiveFileLookup=True).schema("doc_id string").csv(
        landing).select(F.regexp_extract(F.col("_metadata.file_path"), "delivery=([^/]*)/", 1).alias("delivery"))
    return rows.groupBy("delivery").agg(F.count("*").alias("n")).join(deliveries_of, "delivery").select(
        "fingerprint", "delivery", "n")


@query("incremental_ingest", """
SELECT student_id, strftime(ts, '%Y-%m-%d') AS day, o_orderkey FROM (
  SELECT o_custkey AS student_id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS ts, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1
""")
def incremental_ingest(spark, sf):
    """Deliveries dropped as CSV files, taken in by a stream in two runs with a compaction between."""
    landing, table = scratch_path(spark, "landing"), scratch_path(spark, "table")
    rows = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("student_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "unknown")
        .otherwise(F.date_format("o_orderdate", UPDATE_DATE_FORMAT)).alias("update_date"), "o_orderkey", "o_orderstatus")
    schema = rows.drop("o_orderstatus").schema

    def deliver(part):
        part.drop("o_orderstatus").write.mode("append").option("header", True).csv(landing)
        incremental.run_incremental(
            spark, landing, table, schema, ["student_id"], ["ts", "o_orderkey"], files_per_batch=2,
            prepare=lambda b: b.withColumn("ts", parse_update_date(F.col("update_date"))))

    late = F.col("o_orderstatus") == "O"
    deliver(rows.filter(~late))
    incremental.compact(spark, table, ["student_id"], ["ts", "o_orderkey"])
    deliver(rows.filter(late))
    return incremental.read_incremental(spark, table, ["student_id"], ["ts", "o_orderkey"]).select(
        "student_id", date_text(F.col("ts")).alias("day"), "o_orderkey")
