"""What the physical plans must and must not hold."""

import contextlib
import io

import pytest

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
WRITERS = {"csv_roundtrip", "json_roundtrip", "append_partitioned", "store_dataset", "store_tagged", "versioned_merge", "upsert_on_read",
           "file_pick", "file_listing", "store_delivery", "delivered_headers", "incremental_ingest"}
FITTED = {"train_classifiers", "train_regressors", "train_all", "score_all", "score_write_back", "fill_missing",
          "tree_contributions", "isolation_forest_file", "isolation_forest_table", "contributions_add_up", "scores_hold",
          "anomaly_share", "regression_by_hand", "fill_then_predict"}
CORPUS = {q for q in QUERIES if q == "pipeline" or q.startswith("op")}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS - FITTED - CORPUS))
def test_no_python_and_no_cartesian(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                 "FlatMapGroupsInPandas"):
        assert word not in text, word


def test_hot_keys_combine_before_the_shuffle(spark, sf):
    text = plan(QUERIES["latest_per_key"](spark, sf))
    assert "partial_max" in text and "Window" not in text


def test_scan_reads_only_what_is_used(spark, sf):
    text = plan(QUERIES["equality_filter"](spark, sf))
    assert "EqualTo(o_orderstatus,F)" in text and "o_orderdate" not in text.split("ReadSchema")[1].split("\n")[0]
    text = plan(QUERIES["avg_accuracy"](spark, sf))
    assert "o_orderdate" not in text.split("ReadSchema")[1].split("\n")[0]


def test_advice_needs_no_shuffle_of_its_own(spark, sf):
    one = plan(QUERIES["recommendations"](spark, sf)).count("Exchange hashpartitioning")
    base = plan(QUERIES["derived_label"](spark, sf)).count("Exchange hashpartitioning")
    assert one == base
