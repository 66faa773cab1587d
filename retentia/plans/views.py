"""Student-like views over the supplied tables, each with the same definition in SQL.

No student table is supplied; every view reads whole tables and keeps their size. The CASE branches
plant the messy values an uploaded file brings along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.schemas import MODEL_DETAIL


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(key: str, values: list[str | None]):
    """A text chosen by the remainder of an integer key."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        out = out.when(F.col(key) % len(values) == i, F.lit(v))
    return out


def _pick_sql(key: str, values: list[str | None]) -> str:
    arms = " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


JOB = ["Yes", " yes ", "TRUE", "no", "1", None]
CLUB = ["true", "No", "0", "YES", ""]
LEFT = ["Yes", "no", "1", "0", "maybe", None, "True", "0.9", "2"]
RATING = ["3", "0", "5", "6", "x", None, "3.0", " 4 "]
MAIL = ["a.b-c@d.org", "a@b", "a b@c.de", "", None, "x@y.z", "  "]


# ---- learners: customers with aggregates of their orders ------------------------------------------

def learners(spark, sf) -> DataFrame:
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    stats = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), price.alias("spent"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_failed"),
        F.max("o_orderdate").alias("last_order"))
    c = table(spark, sf, "customer")
    segment = F.col("c_mktsegment")
    return c.join(stats, c["c_custkey"] == stats["o_custkey"], "left").select(
        F.col("c_custkey").alias("learner"), F.col("c_name").alias("name"), segment.alias("segment"),
        F.when(segment.isin("BUILDING", "FURNITURE"), "Male")
        .when(segment.isin("MACHINERY", "HOUSEHOLD"), "Female").otherwise("Other").alias("gender"),
        ((F.col("c_acctbal") + 1000.0) / 2750.0).alias("currentGPA"),
        (100.0 * (F.col("n_orders") - F.col("n_failed")) / F.col("n_orders")).alias("attendance"),
        (F.col("spent") / F.col("n_orders") / 5000.0).alias("exam_score"),
        F.coalesce("n_orders", F.lit(0)).cast("double").alias("study_hours"),
        (8.0 * F.col("n_failed") / F.col("n_orders")).alias("social_media_hours"),
        F.col("last_order"))


LEARNERS = """order_stats AS (
  SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS n_failed, max(o_orderdate) AS last_order
  FROM orders GROUP BY o_custkey),
learners AS (
  SELECT c_custkey AS learner, c_name AS name, c_mktsegment AS segment,
         CASE WHEN c_mktsegment IN ('BUILDING','FURNITURE') THEN 'Male'
              WHEN c_mktsegment IN ('MACHINERY','HOUSEHOLD') THEN 'Female' ELSE 'Other' END AS gender,
         (c_acctbal + 1000.0::DOUBLE) / 2750.0::DOUBLE AS "currentGPA",
         100.0::DOUBLE * (n_orders - n_failed) / n_orders AS attendance,
         spent / n_orders / 5000.0::DOUBLE AS exam_score,
         CAST(coalesce(n_orders, 0) AS DOUBLE) AS study_hours,
         8.0::DOUBLE * n_failed / n_orders AS social_media_hours, last_order
  FROM customer LEFT JOIN order_stats ON c_custkey = o_custkey)"""


# ---- registry: one training run per order, its models nested in an array ---------------------------

def registry(spark, sf) -> DataFrame:
    price = F.col("o_totalprice")

    def detail(kind, target, name, metrics):
        pairs = [x for k, v in metrics.items() for x in (F.lit(k), v)]
        return F.struct(
            F.lit(kind).alias("type"), F.lit(target).alias("target"), F.lit(name).alias("model_name"),
            F.create_map(*pairs).alias("metrics"),
            F.concat(F.lit("models/"), F.col("o_orderkey").cast("string"), F.lit(f"/{target}_{name}"))
            .alias("model_path"))

    fit = {"mse": price / 1000.0, "r2_score": 1.0 - price / 1000000.0}
    details = F.array(
        detail("classification", "dropout", "random_forest", {"accuracy": 0.5 + price / 1000000.0}),
        detail("regression", "age", "linear_regression", fit),
        detail("classification", "dropout", "logistic_regression", {
            "accuracy": F.when(F.col("o_orderstatus") != "P", 0.4 + price / 1000000.0)}),
        detail("regression", "attendance", "linear_regression", fit),
        detail("classification", "dropout", "gradient_boosting", {"accuracy": 0.45 + price / 1000000.0}))
    empty = F.array().cast(T.ArrayType(MODEL_DETAIL))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("_id"),
        F.concat(F.lit("dataset_"), F.col("o_custkey").cast("string")).alias("dataset"),
        F.struct(F.col("o_custkey").cast("string").alias("userId"),
                 F.lit("trainer").alias("username")).alias("trained_by"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_paid"),
        F.when(F.col("o_orderpriority") == "5-LOW", empty)
        .when((F.col("o_orderpriority") != "4-NOT SPECIFIED") | (F.col("o_orderstatus") != "F"), details)
        .alias("details"),
        F.col("o_orderstatus").alias("status"))


def _detail_sql(pos, kind, target, name, accuracy="NULL", mse="NULL", r2="NULL") -> str:
    return (f"SELECT *, {pos} AS pos, '{kind}' AS type, '{target}' AS target, '{name}' AS model_name, "
            f"CAST({accuracy} AS DOUBLE) AS accuracy, CAST({mse} AS DOUBLE) AS mse, CAST({r2} AS DOUBLE) AS r2, "
            f"'models/' || _id || '/{target}_{name}' AS model_path FROM filled")


_MSE, _R2 = "price / 1000.0::DOUBLE", "1.0::DOUBLE - price / 1000000.0::DOUBLE"
REGISTRY = """registry AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS _id, 'dataset_' || CAST(o_custkey AS VARCHAR) AS dataset,
         CAST(o_custkey AS VARCHAR) AS user_id, o_orderdate AS created_at, o_totalprice AS price,
         o_orderpriority IN ('1-URGENT','2-HIGH') AS is_paid, o_orderstatus AS status,
         CASE WHEN o_orderpriority = '5-LOW' THEN 0
              WHEN o_orderpriority <> '4-NOT SPECIFIED' OR o_orderstatus <> 'F' THEN 5 END AS n_details
  FROM orders),
filled AS (SELECT * FROM registry WHERE n_details = 5),
details AS (
  """ + "\n  UNION ALL ".join([
    _detail_sql(0, "classification", "dropout", "random_forest", "0.5::DOUBLE + price / 1000000.0::DOUBLE"),
    _detail_sql(1, "regression", "age", "linear_regression", "NULL", _MSE, _R2),
    _detail_sql(2, "classification", "dropout", "logistic_regression",
                "CASE WHEN status <> 'P' THEN 0.4::DOUBLE + price / 1000000.0::DOUBLE END"),
    _detail_sql(3, "regression", "attendance", "linear_regression", "NULL", _MSE, _R2),
    _detail_sql(4, "classification", "dropout", "gradient_boosting",
                "0.45::DOUBLE + price / 1000000.0::DOUBLE")]) + ")"


# ---- upload: customers as a messy text delivery ----------------------------------------------------

def upload(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    balance = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    return table(spark, sf, "customer").select(
        F.when(key % 17 == 0, "  ").when(key % 19 != 0, F.concat(F.lit(" S"), key.cast("string"), F.lit(" ")))
        .alias("student ID"),
        F.when(key % 13 == 0, "n/a").when(key % 11 == 0, "").otherwise(balance).alias("currentGPA"),
        F.when(key % 7 != 0, (F.col("c_nationkey") * 4).cast("string")).alias("attendance"),
        F.col("c_mktsegment").alias("gender"),
        _pick("c_custkey", JOB).alias("part_time_job"),
        _pick("c_custkey", CLUB).alias("extracurricular_activities"),
        _pick("c_custkey", LEFT).alias("dropout"), key.alias("line"))


UPLOAD = f"""upload AS (
  SELECT CASE WHEN c_custkey % 17 = 0 THEN '  '
              WHEN c_custkey % 19 <> 0 THEN ' S' || CAST(c_custkey AS VARCHAR) || ' ' END AS "student ID",
         CASE WHEN c_custkey % 13 = 0 THEN 'n/a' WHEN c_custkey % 11 = 0 THEN ''
              ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS "currentGPA",
         CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey * 4 AS VARCHAR) END AS attendance,
         c_mktsegment AS gender, {_pick_sql('c_custkey', JOB)} AS part_time_job,
         {_pick_sql('c_custkey', CLUB)} AS extracurricular_activities,
         {_pick_sql('c_custkey', LEFT)} AS dropout, c_custkey AS line
  FROM customer)"""


# ---- contacts: messages of users -------------------------------------------------------------------

def contacts(spark, sf) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").filter(F.col("role") == "user").select(
        conv, turn, F.when(conv % 9 != 0, F.concat(F.lit("User "), conv.cast("string"))).alias("fullname"),
        _pick("conv_id", MAIL).alias("email"),
        F.when(turn == 0, "Hello").when(turn % 4 == 2, " ").otherwise("Follow-up").alias("subject"),
        F.col("text").alias("message"), _pick("conv_id", RATING).alias("rating"),
        F.when(turn % 4 == 0, True).when(turn % 4 != 3, False).alias("is_read"),
        F.timestamp_micros(F.lit(1704067200000000) + conv * 60000000).alias("created_at"))


CONTACTS = f"""contacts AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 9 <> 0 THEN 'User ' || CAST(conv_id AS VARCHAR) END AS fullname,
         {_pick_sql('conv_id', MAIL)} AS email,
         CASE WHEN turn = 0 THEN 'Hello' WHEN turn % 4 = 2 THEN ' ' ELSE 'Follow-up' END AS subject,
         text AS message, {_pick_sql('conv_id', RATING)} AS rating,
         CASE WHEN turn % 4 = 0 THEN true WHEN turn % 4 <> 3 THEN false END AS is_read,
         make_timestamp(1704067200000000 + conv_id * 60000000) AS created_at
  FROM conversations WHERE role = 'user')"""


# ---- users, logins, alerts -------------------------------------------------------------------------

def users(spark, sf) -> DataFrame:
    """Customers as accounts; the role is the home nation, so that an audience is a nation."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("_id"), F.col("c_name").alias("username"),
        F.col("c_nationkey").cast("string").alias("role"),
        (F.col("c_acctbal") >= 0).alias("notifications_enabled"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("push:"), "c_name")).alias("push_subscription"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "premium").otherwise("free").alias("plan"))


USERS = """users AS (
  SELECT c_custkey AS _id, c_name AS username, CAST(c_nationkey AS VARCHAR) AS role,
         c_acctbal >= 0 AS notifications_enabled,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN 'push:' || c_name END AS push_subscription,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'premium' ELSE 'free' END AS plan
  FROM customer)"""


def logins(spark, sf) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf, "events").filter(F.col("event_type") == "signup").select(
        "event_id", user, F.when(user % 10 != 0, F.concat(F.lit("user_"), user.cast("string"))).alias("username"),
        F.when(user % 3 == 0, "student").when(user % 3 == 1, "teacher").alias("role"),
        F.col("ts").alias("timestamp"))


LOGINS = """logins AS (
  SELECT event_id, user_id, CASE WHEN user_id % 10 <> 0 THEN 'user_' || CAST(user_id AS VARCHAR) END AS username,
         CASE WHEN user_id % 3 = 0 THEN 'student' WHEN user_id % 3 = 1 THEN 'teacher' END AS role,
         ts AS timestamp
  FROM events WHERE event_type = 'signup')"""


# ---- labelled documents ----------------------------------------------------------------------------

def n_words(text: str):
    """``size(split(text, ' '))`` as a double, of a missing text too, without a text for each word."""
    blanks = F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit("")))
    return F.coalesce(blanks + 1, F.size(F.lit(None).cast("array<string>"))).cast("double")


def labelled_docs(spark, sf) -> DataFrame:
    # measured before the join, so that no text is shuffled
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.length("text").cast("double").alias("text_len"),
        n_words("text").alias("n_words"), "lang", "source")
    return d.join(table(spark, sf, "labels"), "doc_id").select(*d.columns, "quality", "toxic")


LABELLED = """labelled AS (
  SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(length(text) AS DOUBLE) AS text_len,
         CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words, lang, source, quality, toxic
  FROM documents JOIN labels USING (doc_id))"""
