"""Merging, changing and deleting rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.functions.scalars import UPDATE_DATE_FORMAT, date_text
from retentia.operators import merge, shaping
from retentia.operators.joins import lookup_join
from retentia.plans import views as v
from retentia.plans.catalog.base import query

_TIES = "l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC"


@query("latest_per_key", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
       l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax, l_returnflag, l_linestatus,
       strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_shipdate DESC, {_TIES}) AS rn FROM lineitem) WHERE rn = 1
""")
def latest_per_key(spark, sf):
    lines = v.table(spark, sf, "lineitem")
    old = lines.filter(F.col("l_shipdate") < F.lit("1998-01-01"))
    new = lines.filter(F.col("l_shipdate") >= F.lit("1998-01-01"))
    kept = merge.latest_per_key(merge.union_all(old, new), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return kept.withColumns({"l_shipdate": date_text(F.col("l_shipdate")),
                             "l_discount": F.col("l_discount") + 0.0, "l_tax": F.col("l_tax") + 0.0})


@query("merge_deliveries", """
SELECT student_id, update_date, strftime(ts, '%Y-%m-%d %H:%M') AS parsed, o_orderkey, o_totalprice
FROM (SELECT *, row_number() OVER (PARTITION BY student_id
        ORDER BY ts DESC NULLS LAST, src DESC, update_date DESC, o_orderkey DESC, o_totalprice DESC) AS rn
      FROM (SELECT o_custkey AS student_id,
                   CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE strftime(o_orderdate, '%m/%d/%Y %H:%M') END AS update_date,
                   CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS ts,
                   CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS src, o_orderkey, o_totalprice
            FROM orders)) WHERE rn = 1
""")
def merge_deliveries(spark, sf):
    rows = v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("Student ID"),
        F.when(F.col("o_orderpriority") == "5-LOW", "unknown")
        .otherwise(F.date_format("o_orderdate", UPDATE_DATE_FORMAT)).alias("Update Date"),
        "o_orderkey", "o_totalprice", "o_orderstatus")
    old = rows.filter(F.col("o_orderstatus") != "O").drop("o_orderstatus")
    new = rows.filter(F.col("o_orderstatus") == "O").drop("o_orderstatus")
    merged = merge.merge_deliveries(old, new)
    return merged.select(F.col("Student ID").alias("student_id"), F.col("Update Date").alias("update_date"),
                         F.date_format("Update_Date_ts", "yyyy-MM-dd HH:mm").alias("parsed"),
                         "o_orderkey", "o_totalprice")


@query("merge_exact_dedup", """
SELECT DISTINCT doc_id, text, lang, source, n_chars FROM (
  SELECT * FROM documents WHERE n_chars <= 1000
  UNION ALL SELECT * FROM documents WHERE n_chars >= 500 OR lang = 'en')
""")
def merge_exact_dedup(spark, sf):
    docs = v.table(spark, sf, "documents")
    return merge.union_distinct(docs.filter(F.col("n_chars") <= 1000),
                                docs.filter((F.col("n_chars") >= 500) | (F.col("lang") == "en")))


@query("merge_text_copies", "SELECT DISTINCT text, lang FROM documents")
def merge_text_copies(spark, sf):
    """Exact duplicate rows of a table without ids."""
    return merge.union_distinct(v.table(spark, sf, "documents").select("text", "lang"))


@query("union_two_shapes", """
SELECT 'customer' AS kind, c_name AS label, c_acctbal AS amount, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier
""")
def union_two_shapes(spark, sf):
    return merge.union_all(
        v.table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("label"),
                                              F.col("c_acctbal").alias("amount"),
                                              F.col("c_mktsegment").alias("segment")),
        v.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("amount"), F.lit("supplier").alias("kind"),
                                              F.col("s_name").alias("label")))


@query("upsert", """
, changes AS (
  SELECT customer_id, balance, status FROM (
    SELECT o_custkey AS customer_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS balance,
           o_orderstatus AS status,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT -s_suppkey - 1, s_acctbal, 'new', 1 FROM supplier) WHERE rn = 1)
SELECT coalesce(t.customer_id, c.customer_id) AS customer_id, t.name,
       CASE WHEN c.customer_id IS NOT NULL THEN c.balance ELSE t.balance END AS balance, c.status
FROM targets t FULL OUTER JOIN changes c ON t.customer_id = c.customer_id
""", ("targets AS (SELECT c_custkey AS customer_id, c_name AS name, c_acctbal AS balance FROM customer)",))
def upsert(spark, sf):
    """Urgent orders change their customers' balance (even to null); suppliers arrive as new keys."""
    target = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    orders = v.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("balance"),
        F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey")
    last = merge.latest_per_key(orders, ["customer_id"], ["o_orderdate", "o_orderkey"])
    arrivals = v.table(spark, sf, "supplier").select(
        (-F.col("s_suppkey") - 1).alias("customer_id"), F.col("s_acctbal").alias("balance"),
        F.lit("new").alias("status"))
    return merge.upsert(target, merge.union_all(last.drop("o_orderdate", "o_orderkey"), arrivals), "customer_id")


@query("update_where", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 'R' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority
FROM orders
""")
def update_where(spark, sf):
    orders = v.table(spark, sf, "orders")
    hit = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 100000)
    return merge.update_where(orders, hit, o_orderstatus=F.lit("R"), o_orderpriority=F.lit("1-URGENT")
                              ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("update_matching", """
SELECT _id, username, CASE WHEN _id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'verified' ELSE 'open' END AS state
FROM users
""", (v.USERS,))
def update_matching(spark, sf):
    """A flag set on every account with a matching key."""
    accounts = v.users(spark, sf).select("_id", "username").withColumn("state", F.lit("open"))
    seen = v.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("_id"))
    return merge.update_matching(accounts, seen, ["_id"], state=F.lit("verified"))


@query("delete_where", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 200000)")
def delete_where(spark, sf):
    orders = v.table(spark, sf, "orders")
    return merge.delete_where(orders, (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 200000)
                              ).select("o_orderkey", "o_custkey")


@query("delete_matching", """
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def delete_matching(spark, sf):
    gone = v.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("c_custkey"))
    return merge.delete_matching(v.table(spark, sf, "customer").select("c_custkey", "c_name"), gone, ["c_custkey"])


@query("array_push", """
SELECT _id, CAST(coalesce(n_details, 0) + (CASE WHEN is_paid THEN 1 ELSE 0 END) AS BIGINT) AS n_models,
       CASE WHEN is_paid THEN 'ensemble' WHEN n_details = 5 THEN 'gradient_boosting' END AS last_model
FROM registry
""", (v.REGISTRY,))
def array_push(spark, sf):
    """One more model pushed onto each paid run; an absent array is created."""
    extra = F.struct(F.lit("classification").alias("type"), F.lit("dropout").alias("target"),
                     F.lit("ensemble").alias("model_name"),
                     F.lit(None).cast("map<string,double>").alias("metrics"),
                     F.lit(None).cast("string").alias("model_path"))
    runs = shaping.push_element(v.registry(spark, sf), "details", extra, when=F.col("is_paid"))
    return runs.select("_id", F.coalesce(F.size(F.col("details")), F.lit(0)).cast("long").alias("n_models"),
                       F.try_element_at("details", F.lit(-1))["model_name"].alias("last_model"))


@query("nested_set", """
SELECT learner, floor(study_hours) AS age, 'updated' AS gender, "currentGPA" AS gpa FROM learners
""", (v.LEARNERS,))
def nested_set(spark, sf):
    """Two fields of a nested column set, a third kept."""
    rows = v.learners(spark, sf).select("learner", "study_hours",
                                        F.struct("gender", "currentGPA").alias("ml_features"))
    changed = shaping.set_nested(rows, "ml_features", age=F.floor("study_hours").cast("double"),
                                 gender=F.lit("updated"))
    return changed.select("learner", "ml_features.age", "ml_features.gender",
                          F.col("ml_features.currentGPA").alias("gpa"))


@query("reports_join", """
SELECT n_name, c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, c_mktsegment
""")
def reports_join(spark, sf):
    """Orders are summed per customer before the join, so it moves one row per customer."""
    sums = v.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    nation = v.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = lookup_join(sums.join(v.table(spark, sf, "customer"), "c_custkey"), nation, ["c_nationkey"])
    return rows.groupBy("n_name", "c_mktsegment").agg(F.sum("n").alias("n_orders"),
                                                      F.sum("s").cast("double").alias("total"))
