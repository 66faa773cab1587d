"""Training, scoring, explanation and anomaly detection with fitted models.

The fits have no SQL counterpart; tests hold them against invariants and brute force.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from retentia.operators import anomaly, encoding, scoring, selection
from retentia.operators.explain import ensemble_leaves, expected_value, tree_contributions
from retentia.operators.training import (
    class_one_probability, details_frame, feature_names, load_regressor, train_classifiers, train_regressors,
)
from retentia.plans import views as v
from retentia.plans.catalog.base import query
from retentia.plans.jobs import upload_and_train
from retentia.session import scratch_path

NUMERIC, CATEGORICAL = ["n_chars", "text_len", "n_words"], ["lang", "source"]


def _flat_details(details):
    return details.select("type", "target", "model_name", F.map_entries("metrics").alias("m")).select(
        "type", "target", "model_name", F.inline("m")).withColumnsRenamed({"key": "metric"})


@query("train_classifiers")
def classifiers(spark, sf):
    """Hold-out metrics of the three classifiers of document quality."""
    found = train_classifiers(v.labelled_docs(spark, sf), "doc_id", "quality", NUMERIC, CATEGORICAL, "docs",
                              scratch_path(spark, "models"))
    return _flat_details(details_frame(spark, found))


@query("train_regressors")
def regressors(spark, sf):
    """A linear regression per numeric column of the line items."""
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    found = train_regressors(_lines(spark, sf), "line", columns, columns, ["l_returnflag", "l_linestatus"],
                             "lines", scratch_path(spark, "models"))
    return _flat_details(details_frame(spark, found))


def _lines(spark, sf):
    return v.table(spark, sf, "lineitem").withColumn(
        "line", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query("train_all")
def train_all(spark, sf):
    """One upload trained in full: classifiers, regressors and the registry row."""
    rows = v.labelled_docs(spark, sf)
    run = upload_and_train(rows, "doc_id", "quality", NUMERIC, CATEGORICAL, NUMERIC, "docs",
                           scratch_path(spark, "run"), "8", "analyst", is_paid=False,
                           classifiers=["random_forest", "logistic_regression"])
    return run.select("dataset", "is_paid", F.explode("details").alias("d")).select(
        "dataset", "is_paid", "d.type", "d.target", "d.model_name")


def _scoring_rows(spark, sf):
    """All documents as entities to score, labelled or not."""
    d = v.table(spark, sf, "documents")
    return d.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                    F.length("text").cast("double").alias("text_len"),
                    v.n_words("text").alias("n_words"), "lang", "source")


def _fitted(spark, sf, name):
    found = train_classifiers(v.labelled_docs(spark, sf), "doc_id", "quality", NUMERIC, CATEGORICAL, "docs",
                              scratch_path(spark, "models"), [name])
    path = found[0]["model_path"]
    return PipelineModel.load(path), path


@query("score_all")
def score_all(spark, sf):
    """Every document scored in one pass by the logistic model, with advice per row."""
    model, _ = _fitted(spark, sf, "logistic_regression")
    scored = scoring.score_linear(_scoring_rows(spark, sf), model, "doc_id", "docs", F.lit("2024-05-10"))
    return scored.select("doc_id", "prediction.class", "prediction.probability",
                         F.array_join("prediction.recommendations", "|").alias("recommendations"))


@query("score_write_back")
def score_write_back(spark, sf):
    """Scores of entities with features written back into the whole table; the others keep none."""
    model, path = _fitted(spark, sf, "random_forest")
    docs = _scoring_rows(spark, sf).withColumn("ml_features", F.when(
        F.col("lang") != "es", F.struct(*NUMERIC, *CATEGORICAL))).select("doc_id", "ml_features")
    rows = selection.with_features(docs).select("doc_id", "ml_features.*")
    scored = scoring.score_trees(rows, model, path, "doc_id", "docs", F.lit("2024-05-10"))
    out = scoring.with_predictions(docs, scored, "doc_id")
    return out.select("doc_id", "prediction.class", "prediction.probability", "prediction.model_used")


@query("fill_missing")
def fill_missing(spark, sf):
    """Gaps in the line items filled by per-column regressions."""
    rows = _lines(spark, sf)
    columns = ["l_quantity", "l_extendedprice"]
    found = train_regressors(rows, "line", columns, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
                             ["l_returnflag"], "lines", scratch_path(spark, "models"))
    models = {f["target"]: load_regressor(spark, f["model_path"]) for f in found}
    holes = rows.withColumns({
        "l_quantity": F.when(F.col("l_linestatus") != "O", F.col("l_quantity")),
        "l_extendedprice": F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))})
    return scoring.fill_missing(holes, models).select("line", *columns)


@query("tree_contributions")
def boosted_contributions(spark, sf):
    """Additive contributions of the boosted trees for every document, in long form."""
    model, path = _fitted(spark, sf, "gradient_boosting")
    rows = model.transform(_scoring_rows(spark, sf))
    stage = model.stages[-1]
    leaves = ensemble_leaves(spark, f"{path}/stages/{len(model.stages) - 1}_{stage.uid}", list(stage.treeWeights), False)
    told = tree_contributions(rows, "doc_id", leaves, feature_names(rows))
    return told.select("doc_id", F.inline("contributions")).withColumn("base_value", F.lit(expected_value(leaves)))


@query("contributions_add_up", "SELECT doc_id, true AS adds_up FROM documents")
def contributions_add_up(spark, sf):
    """Base value and contributions of the boosted trees give every document's margin."""
    model, path = _fitted(spark, sf, "gradient_boosting")
    rows = model.transform(_scoring_rows(spark, sf))
    stage = model.stages[-1]
    leaves = ensemble_leaves(spark, f"{path}/stages/{len(model.stages) - 1}_{stage.uid}", list(stage.treeWeights), False)
    p = class_one_probability()
    told = tree_contributions(rows.withColumn("margin", F.log(p / (1 - p)) / 2), "doc_id", leaves, feature_names(rows),
                              carry=("margin",))
    total = F.aggregate("contributions", F.lit(expected_value(leaves)), lambda a, e: a + e["contribution"])
    return told.select("doc_id", (F.abs(total - F.col("margin")) < 1e-6).alias("adds_up"))


@query("scores_hold", "SELECT doc_id, true AS in_range, true AS class_fits FROM documents")
def scores_hold(spark, sf):
    """Every document has a probability, and its class is the likelier one."""
    model, _ = _fitted(spark, sf, "logistic_regression")
    scored = scoring.score(_scoring_rows(spark, sf), model, "doc_id")
    p = F.col("prediction_probability")
    return scored.select("doc_id", p.between(0, 1).alias("in_range"),
                         (F.col("prediction_class") == (p > 0.5).cast("int")).alias("class_fits"))


@query("anomaly_share", """
SELECT count(*) AS n, count(*) AS scored, true AS share_holds FROM customer
""")
def anomaly_share(spark, sf):
    """All accounts keep their row and score; those flagged are the rows below the quantile."""
    found = isolation_forest_table(spark, sf)
    flagged = F.count_if(F.col("is_anomaly") == -1)
    at = F.floor((F.count("*") - 1) * anomaly.CONTAMINATION)
    return found.agg(F.count("*").alias("n"), F.count("anomaly_score").alias("scored"),
                     (flagged <= at + 1).alias("share_holds"))


_HELD = "CAST(concat('0x', substr(md5(concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, ':42')), 1, 8)) AS BIGINT) % 100 < 20"
_BY_HAND = ["l_extendedprice", "l_discount", "l_tax", "l_suppkey"]


@query("regression_by_hand", f"""
WITH l AS ({' UNION ALL '.join(f"SELECT '{t}' AS target, l_quantity AS x, CAST({t} AS DOUBLE) AS y, {_HELD} AS test FROM lineitem" for t in _BY_HAND)}),
c AS (SELECT target, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM l WHERE NOT test GROUP BY target),
m AS (SELECT target, avg(y) AS m FROM l WHERE test GROUP BY target),
r AS (SELECT target, avg((y - a * x - b) ** 2) AS mse, 1 - sum((y - a * x - b) ** 2) / sum((y - m) ** 2) AS r2
      FROM l JOIN c USING (target) JOIN m USING (target) WHERE test GROUP BY target)
SELECT target, 'r2_score' AS metric, round(r2, 6) AS value FROM r UNION ALL SELECT target, 'rmse', round(sqrt(mse), 4) FROM r
""")
def regression_by_hand(spark, sf):
    """Regressions of four targets on the quantity, against least squares in closed form on the same split."""
    found = train_regressors(_lines(spark, sf), "line", _BY_HAND, ["l_quantity"], [], "lines", scratch_path(spark, "models"))
    value = F.when(F.col("metric") == "mse", F.round(F.sqrt("value"), 4)).otherwise(F.round("value", 6))
    return _flat_details(details_frame(spark, found)).select(
        "target", F.when(F.col("metric") == "mse", "rmse").otherwise(F.col("metric")).alias("metric"), value.alias("value"))


@query("fill_then_predict", f"""
WITH l AS (SELECT *, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS line, {_HELD} AS test FROM lineitem),
c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b
      FROM l WHERE NOT test AND l_linestatus <> 'O')
SELECT line, round(CASE WHEN l_linestatus <> 'O' THEN l_extendedprice ELSE a * l_quantity + b END, 3) AS l_extendedprice,
       CASE WHEN l_returnflag <> 'R' THEN l_tax ELSE 0 END AS l_tax, true AS scored
FROM l, c
""")
def fill_then_predict(spark, sf):
    """Gaps in the price filled by its regression, gaps in the tax, which has none, by 0; then every line is scored."""
    lines = _lines(spark, sf).withColumns({
        "l_extendedprice": F.when(F.col("l_linestatus") != "O", F.col("l_extendedprice")),
        "l_tax": F.when(F.col("l_returnflag") != "R", F.col("l_tax"))})
    folder = scratch_path(spark, "models")
    found = train_regressors(lines, "line", ["l_extendedprice"], ["l_quantity"], [], "lines", folder)
    models = {f["target"]: load_regressor(spark, f["model_path"]) for f in found}
    late = lines.withColumn("late", (F.col("l_shipdate") >= F.lit("1995-06-17")).cast("string"))
    numeric = ["l_quantity", "l_extendedprice", "l_tax"]
    path = train_classifiers(late, "line", "late", numeric, [], "lines", folder, ["logistic_regression"])[0]["model_path"]
    scored = scoring.fill_and_score(lines.select("line", *numeric), models, numeric, PipelineModel.load(path), "line", "lines",
                                    F.lit("2024-05-10"))
    return scored.select("line", F.round("l_extendedprice", 3).alias("l_extendedprice"), "l_tax",
                         F.col("prediction.probability").between(0, 1).alias("scored"))


@query("sparse_codes", """
WITH c AS (SELECT DISTINCT 'l_partkey' AS k, CAST(l_partkey AS VARCHAR) AS v FROM lineitem
           UNION SELECT 'flag', coalesce(CASE WHEN l_linenumber <> 2 THEN l_returnflag END, 'missing') FROM lineitem),
n AS (SELECT k, v, row_number() OVER (ORDER BY k, v) - 1 AS code FROM c)
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS line,
       concat(f.code, ',', p.code) AS codes
FROM lineitem JOIN n p ON p.k = 'l_partkey' AND p.v = CAST(l_partkey AS VARCHAR)
JOIN n f ON f.k = 'flag' AND f.v = coalesce(CASE WHEN l_linenumber <> 2 THEN l_returnflag END, 'missing')
""")
def sparse_codes(spark, sf):
    """Every line's places among all parts and flags, the flag of second lines treated as missing."""
    lines = _lines(spark, sf).select("line", "l_partkey", F.when(
        F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("flag"))
    columns = ["l_partkey", "flag"]
    coded = encoding.one_hot_sparse(lines, columns, encoding.fit_codes(lines, columns))
    return coded.select("line", F.concat_ws(",", F.transform("codes", lambda x: x.cast("string"))).alias("codes"))


@query("sparse_scores", """
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS line, true AS in_range,
       l_linestatus = 'O' AS late FROM lineitem
""")
def sparse_scores(spark, sf):
    """A linear classifier on the quantities, parts and status of all lines; the status tells the label in full."""
    lines = _lines(spark, sf).select("line", "l_quantity", "l_partkey", "l_linestatus", (
        F.col("l_linestatus") == "O").cast("string").alias("label_text"))
    found = encoding.train_sparse(lines, "line", "label_text", ["l_quantity"], ["l_partkey", "l_linestatus"],
                                  scratch_path(spark, "models"))
    p = F.col("probability")
    return encoding.score_sparse(lines, found["model_path"], ["line"]).select(
        "line", p.between(0, 1).alias("in_range"), (p > 0.5).alias("late"))


@query("isolation_forest_file")
def isolation_forest_file(spark, sf):
    """Anomalies of an uploaded table by age, total score, attendance and the coded gender."""
    rows = v.learners(spark, sf).select(
        "learner", F.col("study_hours").alias("age"), F.col("exam_score").alias("total_score"), "attendance", "gender")
    found = anomaly.detect_in_file(rows, "learner")
    return anomaly.explain_flagged(found, ["age", "total_score", "attendance"]).select(
        "learner", "anomaly_score", "is_anomaly", "extreme.*")


@query("isolation_forest_table")
def isolation_forest_table(spark, sf):
    """All accounts scored by their activity and home segment."""
    activity = v.table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(
        F.count("*").cast("double").alias("n_events"), F.avg("value").alias("avg_value"))
    rows = v.table(spark, sf, "customer").join(activity, "c_custkey", "left")
    return anomaly.detect_in_table(rows, "c_custkey", ["c_acctbal", "n_events", "avg_value"], ["c_mktsegment"]).select(
        "c_custkey", "anomaly_score", "is_anomaly")
