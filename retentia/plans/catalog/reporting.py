"""Dashboard aggregates, registry listings and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.operators import anomaly, notifications, registry, reports, selection, shaping
from retentia.plans import views as v
from retentia.plans.catalog.base import query
from retentia.schemas import SAVED_CHARTS
from retentia.sources.files import list_files


@query("avg_accuracy", """
SELECT CAST(printf('%.2f', avg(accuracy) * 100) AS DOUBLE) AS avg_accuracy FROM details WHERE accuracy IS NOT NULL
""", (v.REGISTRY,))
def avg_accuracy(spark, sf):
    return reports.average_accuracy(v.registry(spark, sf))


def _datasets(spark, sf):
    """Stored deliveries: one per document, its size as the record count."""
    return v.table(spark, sf, "documents").select(
        F.concat("source", F.lit("_"), "doc_id").alias("dataset_name"), F.col("n_chars").alias("record_count"),
        F.array(F.struct("doc_id", "lang", "n_chars")).alias("data"))


@query("total_records", "SELECT CAST(sum(n_chars) AS BIGINT) AS total_records FROM documents")
def total_records(spark, sf):
    return reports.total_records(_datasets(spark, sf))


@query("dataset_overview", """
SELECT CAST(sum(o_custkey) AS BIGINT) AS total_records, strftime(max(o_orderdate), '%Y-%m-%d') AS last_updated FROM orders
""")
def dataset_overview(spark, sf):
    return reports.dataset_overview(v.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("record_count"), F.col("o_orderdate").alias("uploaded_at")))


@query("unwind_first10", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def unwind_first10(spark, sf):
    return reports.dataset_sample(_datasets(spark, sf), ["doc_id"])


@query("unwind_all", "SELECT _id, CAST(pos AS BIGINT) AS pos, type, target, model_name, model_path FROM details", (v.REGISTRY,))
def unwind_all(spark, sf):
    return shaping.unwind(v.registry(spark, sf).select("_id", "details"), "details", "d", "pos").select(
        "_id", F.col("pos").cast("long").alias("pos"), "d.type", "d.target", "d.model_name", "d.model_path")


@query("quick_stats", """
SELECT (SELECT count(*) FROM learners WHERE attendance IS NOT NULL) AS analyzed_students,
       (SELECT CAST(printf('%.2f', avg(accuracy) * 100) AS DOUBLE) FROM details) AS avg_accuracy,
       (SELECT 1) AS files, (SELECT count(*) FROM registry) AS trained_models
""", (v.LEARNERS, v.REGISTRY))
def quick_stats(spark, sf):
    from retentia.plans.catalog.scalars import _scored

    return reports.home_statistics(_scored(spark, sf), v.registry(spark, sf),
                                   list_files(spark, f"{sf}/documents.parquet")).withColumn(
        "files", F.col("files").cast("int"))


@query("unread_share", """
SELECT count(*) AS total, count(*) FILTER (WHERE is_read) AS read,
       count(*) FILTER (WHERE NOT is_read) * 100.0::DOUBLE / count(*) AS unread_pct,
       strftime(max(created_at), '%Y-%m-%d') AS last_created FROM contacts
""", (v.CONTACTS,))
def unread_share(spark, sf):
    return reports.read_state(v.contacts(spark, sf))


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return reports.value_counts(v.table(spark, sf, "events"), "event_type")


@query("chart_series", """
SELECT o_orderdate::DATE::VARCHAR AS x, o_totalprice AS y FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50
""")
def chart_series(spark, sf):
    orders = v.table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date").cast("string"))
    return reports.chart_series(orders, "day", "o_totalprice", ["o_orderdate", "o_orderkey"], 50, "line")


@query("chart_pie", """
SELECT o_orderpriority AS x, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500) GROUP BY 1
""")
def chart_pie(spark, sf):
    orders = v.table(spark, sf, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)")).withColumn(
        "rank_key", -F.col("o_totalprice"))
    pie = reports.chart_series(orders, "o_orderpriority", "amount", ["rank_key", "o_orderkey"], 500, "pie")
    return pie.withColumn("y", F.col("y").cast("double"))


CHARTS = [("customer", "c_mktsegment", "c_acctbal", "bar", 20, "#636EFA"),
          ("orders", "o_orderpriority", "o_totalprice", "line", 30, "#636EFA"),
          ("orders", "o_orderstatus", "o_custkey", "bar", 10, "#EF553B")]


@query("saved_charts", """
SELECT 'customer' AS collection, 'c_mktsegment' AS x_axis, 'c_acctbal' AS y_axis, 'bar' AS chart_type, r AS "row", c_mktsegment AS x, CAST(c_acctbal AS DECIMAL(18,2)) AS y
FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r <= 20
UNION ALL SELECT 'orders', 'o_orderpriority', 'o_totalprice', 'line', r, o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2))
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 30
UNION ALL SELECT 'orders', 'o_orderstatus', 'o_custkey', 'bar', r, o_orderstatus, CAST(o_custkey AS DECIMAL(18,2))
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 10
""")
def saved_charts(spark, sf):
    series = reports.saved_chart_series(spark.createDataFrame(CHARTS, SAVED_CHARTS), {
        "customer": (v.table(spark, sf, "customer"), ["c_custkey"]),
        "orders": (v.table(spark, sf, "orders"), ["o_orderkey"])})
    return series.withColumn("y", F.col("y").cast("decimal(18,2)"))


_TITLE = {"random_forest": "Random Forest", "logistic_regression": "Logistic Regression",
          "gradient_boosting": "Gradient Boosting", "linear_regression": "Linear Regression"}
_NAME_CASE = "CASE model_name " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in _TITLE.items()) + " END"


@query("registry_first_regression", f"""
SELECT _id, dataset, CAST(pos AS BIGINT) AS pos, upper(type[1]) || type[2:] AS type, {_NAME_CASE} AS model_name,
       upper(target[1]) || target[2:] AS target
FROM (SELECT *, row_number() OVER (PARTITION BY _id, type ORDER BY pos) AS rn FROM details)
WHERE type = 'classification' OR rn = 1
""", (v.REGISTRY,))
def registry_first_regression(spark, sf):
    return registry.listed_models(v.registry(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query("registry_summary", """
SELECT _id AS id, dataset, strftime(created_at, '%Y-%m-%d') AS trained_at, user_id AS trained_by_user_id,
       CAST(coalesce(n_details, 0) AS BIGINT) AS n_models FROM registry
""", (v.REGISTRY,))
def registry_summary(spark, sf):
    out = registry.registry_summary(v.registry(spark, sf))
    return out.withColumns({"trained_at": F.date_format("trained_at", "yyyy-MM-dd"),
                            "n_models": F.col("n_models").cast("long")})


@query("registry_lookup", """
SELECT d.model_path, d._id, d.dataset, d.is_paid FROM details d
JOIN (SELECT DISTINCT 'models/' || CAST(l_orderkey AS VARCHAR) || '/dropout_random_forest' AS model_path
      FROM lineitem WHERE l_returnflag = 'R') p ON d.model_path = p.model_path
""", (v.REGISTRY,))
def registry_lookup(spark, sf):
    """Requested model paths resolved to the owning run."""
    asked = v.table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.concat(
        F.lit("models/"), F.col("l_orderkey").cast("string"), F.lit("/dropout_random_forest")).alias("model_path"))
    return registry.resolve_models(asked, v.registry(spark, sf))


@query("entitled_models", """
SELECT 'free' AS plan, count(*) AS n FROM registry WHERE NOT is_paid
UNION ALL SELECT 'premium', count(*) FROM registry
""", (v.REGISTRY,))
def entitled_models(spark, sf):
    runs = v.registry(spark, sf)
    counts = [selection.entitled(runs, plan).agg(F.count("*").alias("n")).select(F.lit(plan).alias("plan"), "n")
              for plan in ("free", "premium")]
    return counts[0].unionByName(counts[1])


@query("element_match", """
SELECT _id, dataset FROM registry r WHERE EXISTS (
  SELECT 1 FROM details d WHERE d._id = r._id AND d.model_name = 'gradient_boosting')
""", (v.REGISTRY,))
def element_match(spark, sf):
    return v.registry(spark, sf).filter(
        selection.any_element("details", "model_name", "gradient_boosting")).select("_id", "dataset")


@query("notify_fanout", """
SELECT u._id AS user_id, 'Notice for ' || n_name AS title, r_name AS body, '/nation/' || u.role AS url
FROM users u JOIN nation ON u.role = CAST(n_nationkey AS VARCHAR) JOIN region ON n_regionkey = r_regionkey
WHERE notifications_enabled AND push_subscription IS NOT NULL
""", (v.USERS,))
def notify_fanout(spark, sf):
    """One notice per nation, delivered to the reachable accounts of that nation."""
    nation, region = v.table(spark, sf, "nation"), v.table(spark, sf, "region")
    notices = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").cast("string").alias("role"),
        F.concat(F.lit("Notice for "), "n_name").alias("title"), F.col("r_name").alias("body"),
        F.concat(F.lit("/nation/"), F.col("n_nationkey").cast("string")).alias("url"))
    return notifications.fan_out(notices, v.users(spark, sf))


@query("notifications_union", """
SELECT 'notification' AS kind, event_type AS text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE user_id = 8 AND event_type <> 'error'
UNION ALL SELECT 'alert', 'error ' || CAST(event_id AS VARCHAR), strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events
WHERE event_type = 'error' AND user_id % 4 <> 0
""")
def notifications_union(spark, sf):
    """One account's inbox: its own notifications and the alerts addressed to its role."""
    events = v.table(spark, sf, "events")
    own = events.filter(F.col("event_type") != "error").select(
        "user_id", F.col("event_type").alias("title"), F.col("ts").alias("created_at"))
    alerts = events.filter(F.col("event_type") == "error").select(
        F.when(F.col("user_id") % 4 == 0, F.array(F.lit("admin")))
        .otherwise(F.array(F.lit("teacher"), F.lit("admin"))).alias("targetEntityType"),
        F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("message"),
        F.col("ts").alias("generatedAt"))
    return notifications.inbox(own, alerts, 8, "teacher").withColumn(
        "at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


FLAGGED = """scored AS (
  SELECT *, ("currentGPA" - 2.0::DOUBLE) / 4.0::DOUBLE AS anomaly_score,
         CASE WHEN ("currentGPA" - 2.0::DOUBLE) / 4.0::DOUBLE < 0 THEN -1 ELSE 1 END AS is_anomaly FROM learners)"""


def _flagged(spark, sf):
    """Learners with a fixed score; a low grade counts as strange."""
    score = (F.col("currentGPA") - 2.0) / 4.0
    return v.learners(spark, sf).withColumns({
        "anomaly_score": score, "is_anomaly": F.when(score < 0, -1).otherwise(1)})


@query("anomaly_insights", f"""
SELECT CASE WHEN count(*) FILTER (WHERE gender = 'Male') > 0 AND count(*) FILTER (WHERE gender = 'Female') > 0 THEN
         CASE WHEN count(*) FILTER (WHERE gender = 'Male') > 1.5 * count(*) FILTER (WHERE gender = 'Female') THEN '{reports.MALE_INSIGHT}'
              WHEN count(*) FILTER (WHERE gender = 'Female') > 1.5 * count(*) FILTER (WHERE gender = 'Male') THEN '{reports.FEMALE_INSIGHT}'
              ELSE '{reports.BALANCED_INSIGHT}' END END AS gender_insight,
       CASE WHEN count(*) = 0 THEN NULL WHEN count(*) FILTER (WHERE anomaly_score < -0.2) > count(*) / 2 THEN '{reports.VERY_LOW_INSIGHT}'
            ELSE '{reports.THRESHOLD_INSIGHT}' END AS score_insight,
       count(*) AS flagged, (SELECT count(*) FROM learners) AS total
FROM scored WHERE is_anomaly = -1
""", (v.LEARNERS, FLAGGED))
def anomaly_insights(spark, sf):
    return reports.anomaly_insights(_flagged(spark, sf))


_Z = ["currentGPA", "attendance", "exam_score", "study_hours"]
EXTREME = ("stats AS (SELECT " + ", ".join(
    f'avg("{c}") AS "m_{c}", stddev_pop("{c}") AS "s_{c}"' for c in _Z) + " FROM learners), z AS ("
    + " UNION ALL ".join(
        f'SELECT learner, {i} AS o, \'{c}\' AS feature, "{c}" AS value, abs("{c}" - "m_{c}") / "s_{c}" AS z, "{c}" < "m_{c}" AS low '
        f"FROM scored, stats WHERE is_anomaly = -1" for i, c in enumerate(_Z))
    + "), extreme AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY z DESC NULLS LAST, o) AS rn "
      "FROM z WHERE z IS NOT NULL) WHERE rn = 1)")


@query("extreme_feature", """
SELECT learner, feature, value, CASE WHEN low THEN 'Unusually low' ELSE 'Unusually high' END AS description FROM extreme
""", (v.LEARNERS, FLAGGED, EXTREME))
def extreme_feature(spark, sf):
    return anomaly.explain_flagged(_flagged(spark, sf), _Z).select("learner", "extreme.*")


@query("feature_frequency", "SELECT feature, count(*) AS n FROM extreme GROUP BY feature", (v.LEARNERS, FLAGGED, EXTREME))
def feature_frequency(spark, sf):
    return reports.feature_frequency(
        anomaly.explain_flagged(_flagged(spark, sf), _Z).select("extreme.feature"), "feature")
