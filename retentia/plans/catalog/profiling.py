"""Data quality, feature statistics, encodings, splits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentia.operators import features, merge, metrics, quality, ranking
from retentia.operators.anomaly import flag_lowest
from retentia.operators.explain import contribution_array, long_contributions, recommendations, top_contributions
from retentia.operators import explain
from retentia.plans import views as v
from retentia.plans.catalog.base import query
from retentia.session import scratch_path
from retentia.sources import profiles

_CONTRACT = ["student ID", "currentGPA", "attendance", "gender", "dropout", "age"]


def _contract_row(c: str) -> str:
    if c == "age":
        return "SELECT 'age' AS \"column\", false AS present, count(*) AS rows, 0 AS filled, 0 AS castable FROM upload"
    good = f'try_cast("{c}" AS DOUBLE)' if c in ("currentGPA", "attendance") else f'"{c}"'
    return (f"SELECT '{c}' AS \"column\", true AS present, count(*) AS rows, count(\"{c}\") AS filled, "
            f"count({good}) AS castable FROM upload")


@query("contract_check", " UNION ALL ".join(_contract_row(c) for c in _CONTRACT), (v.UPLOAD,))
def contract_check(spark, sf):
    return quality.contract_report(v.upload(spark, sf), _CONTRACT)


def _catalog_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS collection, '{c}' AS field, count(*) AS rows, count({c}) AS filled, "
        f"count(DISTINCT {c}) AS distinct_values FROM {table}" for c in columns)


@query("field_catalog", _catalog_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
       + " UNION ALL " + _catalog_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]))
def field_catalog(spark, sf):
    return quality.field_catalog({t: v.table(spark, sf, t) for t in ("orders", "customer")}, exact=True)


_DELIVERED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("field_catalog_merged", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) AS rows, count({'CASE WHEN coalesce(o_orderkey % 4, 0) <> 3 THEN o_orderpriority END' if c == 'o_orderpriority' else c}) AS filled, "
    "true AS near FROM orders" for c in _DELIVERED))
def field_catalog_merged(spark, sf):
    """The catalogue of four deliveries from their sketches, the last one without a column, held against exact counts."""
    orders, home = v.table(spark, sf, "orders"), scratch_path(spark, "profiles")
    for n in range(4):
        part = orders.filter(F.coalesce(F.pmod("o_orderkey", F.lit(4)), F.lit(0)) == n).select(*_DELIVERED)
        profiles.record(part.drop("o_orderpriority") if n == 3 else part, home, "orders", n + 1)
    merged = profiles.catalogue(profiles.profiles(spark, home))
    exact = quality.field_catalog({"orders": orders.select(*_DELIVERED)}, exact=True).select(
        "field", F.col("distinct_values").alias("exact"))
    return merged.join(exact, "field").select("field", "rows", "filled", (
        F.abs(F.col("distinct_values") - F.col("exact")) <= F.greatest(F.lit(1), 0.05 * F.col("exact"))).alias("near"))


_HEADERS = """headers AS (
  SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS position, p_type AS name
  FROM (SELECT DISTINCT p_brand, p_type FROM part)),
prints AS (SELECT file, sha256(string_agg(name, ',' ORDER BY position)) AS fingerprint FROM headers GROUP BY file)"""


def _headers(spark, sf):
    """Headers of deliveries: the sorted types of each brand are its columns."""
    from pyspark.sql import Window

    pairs = v.table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("name")).distinct()
    return pairs.withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("name")) - 1)


@query("schema_fingerprint", "SELECT file, fingerprint FROM prints", (_HEADERS,))
def schema_fingerprint(spark, sf):
    return quality.schema_fingerprints(_headers(spark, sf))


@query("known_schemas", """
SELECT file FROM prints WHERE fingerprint IN (SELECT fingerprint FROM prints WHERE file = 'Brand#1')
""", (_HEADERS,))
def known_schemas(spark, sf):
    """Deliveries whose header is the same as the registered one."""
    prints = quality.schema_fingerprints(_headers(spark, sf))
    return quality.known_schemas(prints, prints.filter(F.col("file") == "Brand#1")).select("file")


_NULLS = ["currentGPA", "attendance", "exam_score", "social_media_hours"]


@query("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(*) FILTER (WHERE \"{c}\" IS NULL) AS nulls FROM learners" for c in _NULLS), (v.LEARNERS,))
def null_profile(spark, sf):
    return quality.null_profile(v.learners(spark, sf), _NULLS)


HOLEY = """holey AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS cust FROM orders)"""


def _holey(spark, sf):
    return v.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("double")).alias("cust"))


@query("impute_mean", """
SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM holey)), 4) AS price,
       round(coalesce(cust, (SELECT avg(cust) FROM holey)), 4) AS cust FROM holey
""", (HOLEY,))
def impute_mean(spark, sf):
    out = features.impute_means(_holey(spark, sf), ["price", "cust"])
    return out.withColumns({c: F.round(c, 4) for c in ("price", "cust")})


@query("impute_median", """
SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM holey)) AS price,
       coalesce(cust, (SELECT quantile_cont(cust, 0.5) FROM holey)) AS cust FROM holey
""", (HOLEY,))
def impute_median(spark, sf):
    rows = _holey(spark, sf)
    return features.impute_medians(rows, ["price", "cust"], ranking.exact_medians(rows, ["price", "cust"]))


@query("standardise", """
, filled AS (SELECT learner, "currentGPA" AS gpa, coalesce(attendance, (SELECT avg(attendance) FROM learners)) AS att FROM learners)
SELECT learner, round((gpa - (SELECT avg(gpa) FROM filled)) / (SELECT stddev_pop(gpa) FROM filled), 6) AS "currentGPA",
       round((att - (SELECT avg(att) FROM filled)) / (SELECT stddev_pop(att) FROM filled), 6) AS attendance FROM filled
""", (v.LEARNERS,))
def standardise(spark, sf):
    out = features.standardise(v.learners(spark, sf).select("learner", "currentGPA", "attendance"),
                               ["currentGPA", "attendance"])
    return out.withColumns({c: F.round(c, 6) for c in ("currentGPA", "attendance")})


_LANGS = ["de", "en", "es", "fr"]


@query("one_hot", "SELECT doc_id, " + ", ".join(
    f"CAST(coalesce(CASE WHEN n_chars >= 200 THEN lang END, 'missing') = '{x}' AS DOUBLE) AS lang_{x}"
    for x in [*_LANGS, "missing"]) + " FROM documents")
def one_hot(spark, sf):
    """One column per language; the language of short documents is treated as missing."""
    docs = v.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") >= 200, F.col("lang")).alias("lang"))
    return features.one_hot(docs, ["lang"])


@query("get_dummies", "SELECT doc_id, " + ", ".join(
    f"coalesce(CAST(CASE WHEN n_chars >= 200 THEN lang END = '{x}' AS DOUBLE), 0.0) AS lang_{x}" for x in _LANGS[1:])
       + " FROM documents")
def get_dummies(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") >= 200, F.col("lang")).alias("lang"))
    return features.dummies(docs, ["lang"])


@query("class_weights", """
SELECT quality, (SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * CAST(count(*) AS DOUBLE)) AS weight
FROM labels GROUP BY quality
""")
def class_weights(spark, sf):
    return metrics.class_weights(v.table(spark, sf, "labels"), "quality")


_BUCKET = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR) || ':42'), 1, 8) AS BIGINT)"


@query("plain_split", f"SELECT c_custkey, {_BUCKET.format('c_custkey')} % 100 < 20 AS is_test FROM customer")
def plain_split(spark, sf):
    return v.table(spark, sf, "customer").select(
        "c_custkey", features.in_holdout(F.col("c_custkey")).alias("is_test"))


@query("stratified_split", f"""
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_BUCKET.format('event_id')} % 2147483648)
   <= round(0.2 * count(*) OVER (PARTITION BY event_type)) AS is_test FROM events
""")
def stratified_split(spark, sf):
    """The exact share of every class, without a window over a class."""
    out = features.stratified_holdout(v.table(spark, sf, "events"), "event_id", "event_type")
    return out.select("event_id", "event_type", "is_test")


PREDICTED = """predicted AS (
  SELECT l_returnflag AS grp, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS label,
         CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS prediction, l_quantity / 50.0::DOUBLE AS p, l_extendedprice AS price FROM lineitem)"""


def _predicted(spark, sf):
    """A fixed rule as the model: quantity predicts the line status."""
    return v.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"), (F.col("l_linestatus") == "F").cast("int").alias("label"),
        (F.col("l_quantity") > 25).cast("int").alias("prediction"), (F.col("l_quantity") / 50.0).alias("p"),
        F.col("l_extendedprice").alias("price"))


@query("clf_metrics", """
, c AS (SELECT grp, count(*) FILTER (WHERE label = 1 AND prediction = 1)::DOUBLE AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1)::DOUBLE AS fp,
        count(*) FILTER (WHERE label = 1 AND prediction = 0)::DOUBLE AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0)::DOUBLE AS tn FROM predicted GROUP BY grp)
SELECT grp, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1_score FROM c
""", (PREDICTED,))
def clf_metrics(spark, sf):
    return metrics.classification_metrics(_predicted(spark, sf), by=["grp"])


_AUC = """, ranked AS (SELECT label, rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE AS r FROM predicted),
t AS (SELECT sum(r) FILTER (WHERE label = 1) AS rp, count(*) FILTER (WHERE label = 1)::DOUBLE AS np, count(*) FILTER (WHERE label = 0)::DOUBLE AS nn FROM ranked)
SELECT round((rp - np * (np + 1) / 2) / (np * nn), 10) AS roc_auc FROM t"""


@query("roc_auc", _AUC.format("p"), (PREDICTED,))
def roc_auc(spark, sf):
    """Few distinct scores, many ties."""
    return metrics.roc_auc(_predicted(spark, sf), score="p").select(F.round("roc_auc", 10).alias("roc_auc"))


@query("roc_auc_fine", _AUC.format("price"), (PREDICTED,))
def roc_auc_fine(spark, sf):
    """Nearly every row has a score of its own."""
    return metrics.roc_auc(_predicted(spark, sf), score="price").select(F.round("roc_auc", 10).alias("roc_auc"))


@query("reg_metrics", """
, m AS (SELECT l_returnflag AS grp, l_extendedprice AS y, l_quantity * 1000.0::DOUBLE AS p FROM lineitem)
SELECT grp, round(avg((y - p) * (y - p)), 2) AS mse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 8) AS r2_score FROM m GROUP BY grp
""".replace(", m AS", "WITH m AS"))
def reg_metrics(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * 1000.0).alias("prediction"))
    return metrics.regression_metrics(rows, by=["grp"]).select(
        "grp", F.round("mse", 2).alias("mse"), F.round("r2_score", 8).alias("r2_score"))


@query("metrics_union", """
SELECT 'accuracy' AS metric, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS value FROM predicted
UNION ALL SELECT 'rows', count(*)::DOUBLE FROM predicted
""", (PREDICTED,))
def metrics_union(spark, sf):
    """Result lists of different kinds put together."""
    rows = _predicted(spark, sf)
    acc = metrics.classification_metrics(rows).select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    n = rows.agg(F.count("*").cast("double").alias("value")).select(F.lit("rows").alias("metric"), "value")
    return merge.union_all(acc, n)


@query("simple_regression", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem
""")
def simple_regression(spark, sf):
    out = features.simple_regression(v.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("regression_impute", """
, fit AS (SELECT regr_slope(price, cust) AS b, regr_intercept(price, cust) AS a FROM holey)
SELECT o_orderkey, round(coalesce(price, a + b * cust, 0.0), 3) AS price FROM holey, fit
""", (HOLEY,))
def regression_impute(spark, sf):
    """Gaps filled by a one-feature regression, then by 0."""
    rows = _holey(spark, sf)
    fit = features.simple_regression(rows, "cust", "price").select(F.struct("slope", "intercept")).scalar()
    filled = rows.withColumn("_f", fit)
    return filled.select("o_orderkey", F.round(F.coalesce(
        "price", F.col("_f.intercept") + F.col("_f.slope") * F.col("cust"), F.lit(0.0)), 3).alias("price"))


@query("training_frame", """
SELECT round(sum(attendance), 2) AS attendance, round(sum("currentGPA"), 4) AS gpa, count(*) FILTER (WHERE job) AS jobs,
       count(*) FILTER (WHERE gender = 'missing') AS missing_gender, count(*) AS n FROM (
  SELECT coalesce(try_cast(attendance AS DOUBLE), (SELECT avg(try_cast(attendance AS DOUBLE)) FROM upload)) AS attendance,
         coalesce(try_cast("currentGPA" AS DOUBLE), (SELECT avg(try_cast("currentGPA" AS DOUBLE)) FROM upload)) AS "currentGPA",
         coalesce(lower(trim(part_time_job)) IN ('yes','true','1'), false) AS job,
         coalesce(CASE WHEN gender <> 'BUILDING' THEN gender END, 'missing') AS gender FROM upload)
""", (v.UPLOAD,))
def training_frame(spark, sf):
    """The prepared training table of the text delivery, reduced to its control sums."""
    from retentia.functions.scalars import safe_float

    rows = v.upload(spark, sf).select(
        F.when(F.col("gender") != "BUILDING", F.col("gender")).alias("gender"), "part_time_job",
        safe_float(F.col("attendance")).alias("attendance"), safe_float(F.col("currentGPA")).alias("currentGPA"))
    return features.training_frame(rows).agg(
        F.round(F.sum("attendance"), 2).alias("attendance"), F.round(F.sum("currentGPA"), 4).alias("gpa"),
        F.count_if("part_time_job").alias("jobs"), F.count_if(F.col("gender") == "missing").alias("missing_gender"),
        F.count("*").alias("n"))


@query("anomaly_threshold", """
, cut AS (SELECT quantile_cont(o_totalprice, 0.05) AS q FROM orders)
SELECT o_orderkey, round(o_totalprice - q, 4) AS anomaly_score, CASE WHEN o_totalprice - q < 0 THEN -1 ELSE 1 END AS is_anomaly FROM orders, cut
""".replace(", cut AS", "WITH cut AS"))
def anomaly_threshold(spark, sf):
    rows = v.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("raw_score"))
    return flag_lowest(rows).select("o_orderkey", F.round("anomaly_score", 4).alias("anomaly_score"), "is_anomaly")


# fixed weights of a linear score and the centre of each measure
WEIGHTS = {"social_media_hours": (0.9, 2.5), "attendance": (-0.05, 66.0), "currentGPA": (-0.7, 2.0),
           "study_hours": (-0.1, 10.0), "exam_score": (0.02, 50.0), "mental_health_score": (0.3, 1.0)}


def _contributions(spark, sf):
    rows = v.learners(spark, sf).withColumn("mental_health_score", F.length("segment") / 8.0).fillna(
        0.0, subset=["social_media_hours", "attendance", "exam_score"])
    return rows.select("learner", contribution_array(
        {n: (F.col(n) - c) * w for n, (w, c) in WEIGHTS.items()}).alias("contributions"))


CONTRIBUTIONS = "told AS (" + " UNION ALL ".join(
    f"SELECT learner, '{n}' AS feature, "
    + ("(length(segment) / 8.0::DOUBLE" if n == "mental_health_score" else f"(coalesce(\"{n}\", 0)")
    + f" - {c}::DOUBLE) * {w}::DOUBLE AS contribution FROM learners" for n, (w, c) in WEIGHTS.items()) + """),
top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY abs(contribution) DESC, feature) AS rn FROM told) WHERE rn <= 5)"""


@query("linear_contributions", "SELECT learner, feature, round(contribution, 6) AS contribution FROM told", (v.LEARNERS, CONTRIBUTIONS))
def linear_contributions(spark, sf):
    return long_contributions(_contributions(spark, sf), ["learner"]).withColumn(
        "contribution", F.round("contribution", 6))


@query("top5_contributions", "SELECT learner, string_agg(feature, ',' ORDER BY rn) AS features FROM top5 GROUP BY learner",
       (v.LEARNERS, CONTRIBUTIONS))
def top5_contributions(spark, sf):
    top = top_contributions(F.col("contributions"))
    return _contributions(spark, sf).select("learner", F.array_join(
        F.transform(top, lambda e: e["feature"]), ",").alias("features"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("recommendations", f"""
, ruled AS (SELECT learner, rn, CASE
    WHEN contribution > 0 THEN CASE WHEN contains(feature, 'social_media') THEN {_q(explain.SOCIAL_MEDIA)}
      WHEN contains(feature, 'mental_health_score') THEN {_q(explain.MENTAL_HEALTH)} WHEN feature = 'part_time_job_Yes' THEN {_q(explain.PART_TIME_JOB)} END
    WHEN contribution < 0 THEN CASE WHEN contains(feature, 'currentGPA') OR contains(feature, 'highSchoolGPA') THEN {_q(explain.GPA)}
      WHEN contains(feature, 'study_hours') THEN {_q(explain.STUDY_HOURS)} WHEN contains(feature, 'attendance') THEN {_q(explain.ATTENDANCE)} END END AS advice
  FROM top5),
firsts AS (SELECT learner, advice, min(rn) AS rn FROM ruled WHERE advice IS NOT NULL GROUP BY learner, advice)
SELECT l.learner, coalesce(string_agg(advice, '|' ORDER BY rn), {_q(explain.GENERAL)}) AS advice FROM learners l LEFT JOIN firsts f ON l.learner = f.learner GROUP BY l.learner
""", (v.LEARNERS, CONTRIBUTIONS))
def recommend(spark, sf):
    return _contributions(spark, sf).select(
        "learner", F.array_join(recommendations(F.col("contributions")), "|").alias("advice"))
