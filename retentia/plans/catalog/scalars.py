"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.functions import scalars as s
from retentia.operators import ingest, notifications, quality, registry, reports, selection, shaping
from retentia.operators.ranking import category_codes as add_codes
from retentia.plans import views as v
from retentia.plans.catalog.base import query

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(c: str) -> str:
    return _STRIP.format(c)


@query("parse_update_date", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS parsed
FROM orders
""")
def parse_update_date(spark, sf):
    """Dates written as text, one status written in a form that does not parse."""
    text = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(
        F.date_format("o_orderdate", s.UPDATE_DATE_FORMAT))
    return v.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(s.parse_update_date(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("bool_normalise", f"""
SELECT line, coalesce(lower({_strip('part_time_job')}) IN ('yes','true','1'), false) AS job,
       coalesce(lower({_strip('extracurricular_activities')}) IN ('yes','true','1'), false) AS club
FROM upload
""", (v.UPLOAD,))
def bool_normalise(spark, sf):
    return v.upload(spark, sf).select("line", s.str_to_bool(F.col("part_time_job")).alias("job"),
                                      s.str_to_bool(F.col("extracurricular_activities")).alias("club"))


@query("bool_ingest", "SELECT line, lower(part_time_job) IN ('yes','true','1') AS job FROM upload", (v.UPLOAD,))
def bool_ingest(spark, sf):
    return v.upload(spark, sf).select("line", s.ingest_bool(F.col("part_time_job")).alias("job"))


@query("label_map", """
SELECT line, CASE WHEN dropout IN ('Yes','yes','True','true','1') THEN 1
                  WHEN dropout IN ('No','no','False','false','0') THEN 0 END AS label FROM upload
""", (v.UPLOAD,))
def label_map(spark, sf):
    return v.upload(spark, sf).select("line", s.label_map(F.col("dropout")).alias("label"))


@query("label_parse", """
SELECT line, CASE WHEN dropout IS NULL THEN NULL
                  WHEN try_cast(dropout AS DOUBLE) IS NOT NULL THEN abs(try_cast(dropout AS DOUBLE)) >= 1
                  ELSE lower(dropout) IN ('yes','true','1') END AS label FROM upload
""", (v.UPLOAD,))
def label_parse(spark, sf):
    return v.upload(spark, sf).select("line", s.label_parse(F.col("dropout")).alias("label"))


@query("safe_float", "SELECT line, try_cast(\"currentGPA\" AS DOUBLE) AS gpa FROM upload", (v.UPLOAD,))
def safe_float(spark, sf):
    return v.upload(spark, sf).select("line", s.safe_float(F.col("currentGPA")).alias("gpa"))


@query("blank_to_null", f"""
SELECT line, CASE WHEN {_strip('extracurricular_activities')} <> '' THEN extracurricular_activities END AS club,
       CASE WHEN {_strip('"student ID"')} <> '' THEN "student ID" END AS student_id FROM upload
""", (v.UPLOAD,))
def blank_to_null(spark, sf):
    rows = selection.empty_text_as_null(v.upload(spark, sf), ["extracurricular_activities", "student ID"])
    return rows.select("line", F.col("extracurricular_activities").alias("club"),
                       F.col("student ID").alias("student_id"))


@query("derived_label", """
SELECT learner, coalesce("currentGPA" < 2, false) OR coalesce(attendance < 70, false) AS dropout FROM learners
""", (v.LEARNERS,))
def derived_label(spark, sf):
    return v.learners(spark, sf).select(
        "learner", s.derived_label(F.col("currentGPA"), F.col("attendance")).alias("dropout"))


@query("age_years", """
SELECT o_orderkey, CAST(date_diff('year', o_orderdate, DATE '2024-05-10')
       - CASE WHEN strftime(DATE '2024-05-10', '%m%d') < strftime(o_orderdate, '%m%d') THEN 1 ELSE 0 END AS INTEGER) AS age
FROM orders
""")
def age_years(spark, sf):
    return v.table(spark, sf, "orders").select(
        "o_orderkey", s.age_years(F.col("o_orderdate"), F.lit("2024-05-10").cast("date")).alias("age"))


@query("login_history", """
SELECT strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%A') AS day,
       strftime(timestamp, '%I:%M %p') AS time, coalesce(username, 'N/A') AS username, coalesce(role, 'N/A') AS role
FROM logins
""", (v.LOGINS,))
def login_history(spark, sf):
    return reports.login_history(v.logins(spark, sf))


def _scored(spark, sf):
    """Learners with a prediction from a fixed rule; learners without orders are not scored."""
    rows = v.learners(spark, sf)
    p = F.least(F.lit(1.0), F.col("social_media_hours") / 8.0)
    return rows.withColumn("prediction", F.when(F.col("attendance").isNotNull(), F.struct(
        (p >= 0.5).cast("int").alias("class"), p.alias("probability"),
        F.array(F.col("segment")).alias("recommendations"), F.lit("fixed").alias("model_used"),
        F.col("last_order").alias("timestamp")))).withColumn("studentID", F.col("learner").cast("string"))


SCORED = """scored AS (
  SELECT *, least(1.0::DOUBLE, social_media_hours / 8.0::DOUBLE) AS p FROM learners WHERE attendance IS NOT NULL)"""


@query("iso_export", """
SELECT name AS student_name, CAST(learner AS VARCHAR) AS student_id, CAST(p >= 0.5 AS INTEGER) AS prediction_class,
       p AS prediction_probability, '["' || segment || '"]' AS recommendations,
       strftime(last_order, '%Y-%m-%dT%H:%M:%S') AS prediction_timestamp, 'fixed' AS model_used FROM scored
""", (v.LEARNERS, SCORED))
def iso_export(spark, sf):
    """Flat extract of scored entities for consumers, lists as JSON text."""
    return shaping.flatten_predictions(_scored(spark, sf)).withColumn(
        "recommendations", F.to_json("recommendations"))


@query("risk_breakdown", """
SELECT count(*) FILTER (WHERE p >= 0.5) AS high_risk, count(*) FILTER (WHERE p < 0.5 OR p IS NULL) AS low_risk FROM scored
""", (v.LEARNERS, SCORED))
def risk_breakdown(spark, sf):
    return reports.risk_breakdown(shaping.flatten_predictions(_scored(spark, sf)))


@query("risk_names", """
SELECT CAST(learner AS VARCHAR) AS student_id, CASE WHEN p >= 0.5 THEN 'High Risk' ELSE 'Low Risk' END AS risk,
       printf('%.2f', p * 100) || '%' AS chance, CAST(printf('%.2f', (1 - p) * 100) AS DOUBLE) AS stays_pct FROM scored
""", (v.LEARNERS, SCORED))
def risk_names(spark, sf):
    rows = shaping.flatten_predictions(_scored(spark, sf))
    p = F.col("prediction_probability")
    return rows.select("student_id", s.risk_name(F.col("prediction_class")).alias("risk"),
                       s.percent_text(p).alias("chance"), s.round_even((1 - p) * 100).alias("stays_pct"))


_TITLE = "list_aggregate(list_transform(string_split(replace({0}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"


@query("display_name", f"""
SELECT _id AS id, dataset, {_TITLE.format('model_name')} AS model_name,
       dataset || ' | Classification | ' || {_TITLE.format('model_name')}
         || coalesce(' | Acc: ' || printf('%.2f', accuracy * 100) || '%', '') AS combined_name,
       'Classification' AS model_type, model_path
FROM details WHERE type = 'classification'
""", (v.REGISTRY,))
def display_name(spark, sf):
    return registry.classification_summary(v.registry(spark, sf)).drop("trained_at")


_EMAIL = r"""CASE WHEN coalesce(regexp_replace(email, '^\s+|\s+$', '', 'g'), '') = '' THEN 'Email is required.'
            WHEN NOT regexp_matches(email, '^[\w\.-]+@[\w\.-]+\.\w+$') THEN 'Invalid email format.' END"""


def _blank_sql(c: str, text: str) -> str:
    return f"CASE WHEN coalesce({_strip(c)}, '') = '' THEN '{text}' END"


@query("validate_contacts", f"""
SELECT conv_id, turn, {_blank_sql('fullname', 'Full name is required.')} AS fullname_error, {_EMAIL} AS email_error,
       {_blank_sql('subject', 'Subject is required.')} AS subject_error,
       {_blank_sql('message', 'Message is required.')} AS message_error
FROM contacts
""", (v.CONTACTS,))
def validate_contacts(spark, sf):
    rows = v.contacts(spark, sf).withColumn("errors", quality.contact_errors())
    return rows.select("conv_id", "turn", *[F.col("errors")[f].alias(f"{f}_error")
                                            for f in ("fullname", "email", "subject", "message")])


@query("validate_feedback", f"""
SELECT count(*) AS rejected, count(rating_error) AS bad_rating, count(email_error) AS bad_email FROM (
  SELECT {_blank_sql('fullname', 'x')} AS name_error, {_EMAIL} AS email_error, {_blank_sql('message', 'x')} AS message_error,
         CASE WHEN coalesce(regexp_matches(rating, '^\\s*[+-]?\\d+\\s*$') AND trim(rating)::INT BETWEEN 1 AND 5, false)
              THEN NULL ELSE 'x' END AS rating_error FROM contacts)
WHERE name_error IS NOT NULL OR email_error IS NOT NULL OR message_error IS NOT NULL OR rating_error IS NOT NULL
""".replace("trim(rating)::INT", "try_cast(trim(rating) AS INT)"), (v.CONTACTS,))
def validate_feedback(spark, sf):
    _, bad = quality.split_valid(v.contacts(spark, sf).withColumnRenamed("fullname", "name"),
                                 quality.feedback_errors())
    return bad.agg(F.count("*").alias("rejected"), F.count(F.col("errors")["rating"]).alias("bad_rating"),
                   F.count(F.col("errors")["email"]).alias("bad_email"))


@query("category_codes", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1
  ELSE dense_rank() OVER (ORDER BY CASE WHEN c_acctbal >= 0 THEN c_mktsegment END NULLS LAST) - 1 END AS code FROM customer
""")
def category_codes(spark, sf):
    """Sorted position of each category, -1 where the category is missing."""
    rows = v.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("category"))
    return add_codes(rows, "category").select("c_custkey", "code")


@query("json_field", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id, event_type FROM events
""")
def json_field(spark, sf):
    return v.table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), "user_id", "event_type")


@query("map_field", """
SELECT _id, max(accuracy) FILTER (WHERE model_name = 'random_forest') AS forest_accuracy,
       max(mse) FILTER (WHERE target = 'age') AS age_mse FROM details GROUP BY _id
""", (v.REGISTRY,))
def map_field(spark, sf):
    """Metrics read from open maps inside the nested models, without leaving the row."""
    runs = v.registry(spark, sf).filter(F.size("details") > 0)
    return runs.select("_id", F.element_at("details", 1)["metrics"]["accuracy"].alias("forest_accuracy"),
                       F.element_at("details", 2)["metrics"]["mse"].alias("age_mse"))


@query("rounding", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CAST(printf('%.2f', l_extendedprice / 7.0::DOUBLE) AS DOUBLE) AS price_7,
       printf('%.1f', l_quantity / 4.0::DOUBLE) AS quarter FROM lineitem
""")
def rounding(spark, sf):
    """Ties go to the even digit, as the quarters show."""
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        s.round_even(F.col("l_extendedprice") / 7.0).alias("price_7"),
        s.fixed_text(F.col("l_quantity") / 4.0, 1).alias("quarter"))


@query("alert_targets", """
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'student' ELSE 'teacher' END AS role, t.target, count(*) AS n
FROM customer, unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN ['teacher','admin','analyst'] ELSE ['admin','analyst'] END) AS t(target)
GROUP BY ALL
""")
def alert_targets(spark, sf):
    """Alerts of all registrations, counted per role that hears about them."""
    accounts = v.users(spark, sf).select(
        F.when(F.col("push_subscription").isNull(), "student").otherwise("teacher").alias("role"),
        F.lit(None).cast("timestamp").alias("created_at"))
    alerts = notifications.registration_alerts(accounts)
    return alerts.select(F.col("userType").alias("role"), F.explode("targetEntityType").alias("target")).groupBy(
        "role", "target").agg(F.count("*").alias("n"))


@query("file_base_name", """
SELECT page_id, string_split(url, '/')[-1] AS base FROM pages
""")
def file_base_name(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", s.base_name(F.col("url")).alias("base"))


@query("ingest_typed", f"""
SELECT {_strip('"student ID"')} AS student_id, gender, try_cast("currentGPA" AS DOUBLE) AS gpa,
       try_cast(attendance AS DOUBLE) AS attendance,
       lower(part_time_job) IN ('yes','true','1') AS job,
       CASE WHEN dropout IS NULL THEN coalesce(try_cast("currentGPA" AS DOUBLE) < 2, false) OR coalesce(try_cast(attendance AS DOUBLE) < 70, false)
            WHEN try_cast(dropout AS DOUBLE) IS NOT NULL THEN abs(try_cast(dropout AS DOUBLE)) >= 1
            ELSE lower(dropout) IN ('yes','true','1') END AS dropout
FROM upload WHERE coalesce({_strip('"student ID"')}, '') <> ''
""", (v.UPLOAD,))
def ingest_typed(spark, sf):
    """The text delivery typed, labelled and nested; read back from the nested form."""
    typed, _ = ingest.ingest_students(v.upload(spark, sf), F.lit("2024-05-10"))
    return typed.select("student_id", "gender", F.col("currentGPA").alias("gpa"),
                        "ml_features.attendance", F.col("ml_features.part_time_job").alias("job"), "dropout")


@query("ingest_stats", f"""
SELECT count(*) AS rows_read, count(*) FILTER (WHERE coalesce({_strip('"student ID"')}, '') <> '') AS ingested,
       count(*) FILTER (WHERE coalesce({_strip('"student ID"')}, '') = '') AS rejected FROM upload
""", (v.UPLOAD,))
def ingest_stats(spark, sf):
    return ingest.ingest_counts(v.upload(spark, sf), "student ID")


@query("reject_blank_keys", f"""
SELECT line, "student ID" IS NULL AS missing FROM upload WHERE coalesce({_strip('"student ID"')}, '') = ''
""", (v.UPLOAD,))
def reject_blank_keys(spark, sf):
    _, rejected = selection.split_on_key(v.upload(spark, sf), "student ID")
    return rejected.select("line", F.col("student ID").isNull().alias("missing"))


@query("flatten_nested", """
SELECT learner, "currentGPA" AS gpa, attendance, 'N/A' AS nickname FROM learners WHERE attendance IS NOT NULL
""", (v.LEARNERS,))
def flatten_nested(spark, sf):
    """Features nested, entities without them skipped, then flattened with a fallback column."""
    rows = v.learners(spark, sf)
    nested = rows.select("learner", F.when(F.col("attendance").isNotNull(),
                                           F.struct("currentGPA", "attendance")).alias("ml_features"))
    flat = shaping.flatten(selection.with_features(nested), "ml_features")
    return flat.select("learner", F.col("currentGPA").alias("gpa"), "attendance",
                       shaping.first_present(flat, ["nickname", "alias"], "N/A").alias("nickname"))
