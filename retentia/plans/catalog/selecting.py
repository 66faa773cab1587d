"""Projections, filters, sorts, limits and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.operators import selection, shaping
from retentia.operators.features import sample_rows, top_per_row
from retentia.plans import views as v
from retentia.plans.catalog.base import query
from retentia.session import scratch_path
from retentia.sources import text_index


@query("project_columns", "SELECT o_orderkey AS order_id, o_custkey AS student_id, o_totalprice FROM orders")
def project_columns(spark, sf):
    """Fixed columns kept, others dropped (an absent one is ignored), two renamed."""
    rows = shaping.drop_columns(v.table(spark, sf, "orders"), "o_orderpriority", "no_such_column")
    kept = shaping.keep_columns(rows, ["o_orderkey", "o_custkey", "o_totalprice"])
    return shaping.rename_columns(kept, {"o_orderkey": "order_id", "o_custkey": "student_id", "gone": "here"})


@query("missing_columns", """
SELECT c_custkey, c_acctbal, CAST(NULL AS DOUBLE) AS "highSchoolGPA", false AS dropout FROM customer
""")
def missing_columns(spark, sf):
    rows = v.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return shaping.add_missing(rows, {"highSchoolGPA": ("double", None), "dropout": ("boolean", False),
                                      "c_acctbal": ("double", 0.0)})


@query("equality_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def equality_filter(spark, sf):
    return selection.matching(v.table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select(
        "o_orderkey", "o_totalprice")


@query("push_audience", """
SELECT _id, username FROM users WHERE role = '3' AND notifications_enabled AND push_subscription IS NOT NULL
""", (v.USERS,))
def push_audience(spark, sf):
    return selection.push_audience(v.users(spark, sf), "3").select("_id", "username")


@query("nested_exists", """
SELECT learner FROM learners WHERE attendance IS NOT NULL OR study_hours < 1
""", (v.LEARNERS,))
def nested_exists(spark, sf):
    """Rows where at least one of two nested paths holds a value."""
    rows = v.learners(spark, sf).select(
        "learner", F.struct(F.col("attendance").alias("probability")).alias("prediction"),
        F.struct(F.when(F.col("study_hours") < 1, 1).alias("first")).alias("predictions"))
    return rows.filter(selection.any_present("prediction.probability", "predictions.first")).select("learner")


@query("role_alerts", """
SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 4 <> 0
""")
def role_alerts(spark, sf):
    """Alerts whose target is an array or a single role."""
    events = v.table(spark, sf, "events").filter(F.col("event_type") == "error").withColumn(
        "target", F.when(F.col("user_id") % 4 == 0, "admin").otherwise("teacher"))
    rows = events.withColumn("targetEntityType", selection.as_array("target", events))
    return rows.filter(selection.role_in("targetEntityType", "teacher")).select("event_id")


@query("ci_lookup", "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('cUSTOMER#000000007')")
def ci_lookup(spark, sf):
    return v.table(spark, sf, "customer").filter(
        selection.equals_ignore_case("c_name", "cUSTOMER#000000007")).select("c_custkey", "c_name")


@query("expired_filter", """
SELECT event_id, user_id FROM events WHERE ts + INTERVAL 60 MINUTES >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 3600 SECONDS
""")
def expired_filter(spark, sf):
    """Codes valid for an hour, still kept one hour after they expire."""
    codes = v.table(spark, sf, "events").select(
        "event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 60 MINUTES")).cast("timestamp").alias("expires_at"))
    return selection.not_expired(codes, "2024-01-15 00:00:00", grace_seconds=3600).select("event_id", "user_id")


@query("complete_rows", """
SELECT learner, attendance, exam_score FROM learners WHERE attendance IS NOT NULL AND exam_score IS NOT NULL
""", (v.LEARNERS,))
def complete_rows(spark, sf):
    return selection.complete_rows(v.learners(spark, sf).select("learner", "attendance", "exam_score"))


@query("search_sort_page", """
SELECT p_partkey, p_name, p_brand, p_type FROM part
WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')
ORDER BY p_name, p_partkey LIMIT 25 OFFSET 25
""")
def search_sort_page(spark, sf):
    """Second page of the parts with the text in any column."""
    hits = selection.search(v.table(spark, sf, "part"), "RED").select("p_partkey", "p_name", "p_brand", "p_type")
    return selection.page(hits, ["p_name", "p_partkey"], 2, 25)


@query("search_text", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND lang = 'en'
""")
def search_text(spark, sf):
    """Substring search over whole texts with a status filter."""
    return selection.search(v.table(spark, sf, "documents"), "Tion", ["text"], "en", "lang").select("doc_id")


@query("search_indexed", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') AND lang = 'en'
""")
def search_indexed(spark, sf):
    """Substring search through an index of triples, built from two deliveries of all documents."""
    docs, home = v.table(spark, sf, "documents"), scratch_path(spark, "text-index")
    even = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    text_index.build(docs.filter(even).select("doc_id", "text", "lang"), home, ["text"], 1000)
    text_index.add(docs.filter(~even).select("doc_id", "text", "lang"), home)
    return text_index.search(spark, home, "Worthless", "en", "lang").select("doc_id")


@query("page_after", "SELECT p_partkey, p_name FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 50")
def page_after(spark, sf):
    return selection.page_after(v.table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 100, 50)


@query("sort_options", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100
""")
def sort_options(spark, sf):
    rows = selection.sorted_by(v.table(spark, sf, "orders"), "date-desc", "o_orderpriority", "o_orderdate", "o_orderkey")
    return rows.limit(100).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("newest_feedback", """
SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 20
""")
def newest_feedback(spark, sf):
    rows = selection.matching(v.table(spark, sf, "events"), event_type="purchase")
    return selection.newest_first(rows, "ts", "event_id", 20).select("event_id", "user_id")


@query("find_many", "SELECT doc_id, lang, source FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 100")
def find_many(spark, sf):
    return selection.find_many(v.table(spark, sf, "documents"), F.col("lang") == "de",
                               ["doc_id", "lang", "source"], ["doc_id"])


@query("top_features_long", """
SELECT l_orderkey, feature, value, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(value) DESC, feature) AS rn FROM (
    SELECT l_orderkey, 'price' AS feature, max(l_extendedprice) / 1000.0::DOUBLE AS value FROM lineitem GROUP BY 1
    UNION ALL SELECT l_orderkey, 'quantity', -max(l_quantity) FROM lineitem GROUP BY 1
    UNION ALL SELECT l_orderkey, 'tax', max(l_tax) * 100.0::DOUBLE + 0.0 FROM lineitem GROUP BY 1)) WHERE rn <= 2
""")
def top_features_long(spark, sf):
    """Two largest of three measures per order, from the long form."""
    wide = v.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        (F.max("l_extendedprice") / 1000.0).alias("price"), (-F.max("l_quantity")).alias("quantity"),
        (F.max("l_tax") * 100.0 + 0.0).alias("tax"))
    long = shaping.to_long(wide, ["l_orderkey"], ["price", "quantity", "tax"])
    return top_per_row(long, ["l_orderkey"], [F.abs("value").desc(), F.col("feature")], 2)


@query("sample500", "SELECT c_custkey, c_name FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey LIMIT 500")
def sample500(spark, sf):
    """A reproducible sample of at most 500 rows."""
    return sample_rows(v.table(spark, sf, "customer"), "c_custkey").select("c_custkey", "c_name")
