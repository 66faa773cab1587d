"""Additive feature contributions and the advice drawn from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators.joins import lookup_join
from retentia.session import scratch_path

# ---- fixed values: advice rules ------------------------------------------------------------------
TOP_FEATURES = 5
SOCIAL_MEDIA = "Consider reducing time spent on social media to improve focus and well-being."
MENTAL_HEALTH = "Seeking mental health support or wellness counseling could be beneficial."
PART_TIME_JOB = "Review your part-time work schedule to ensure it doesn't conflict with your studies."
GPA = "You are doing well academically. Continue to focus on your studies to maintain your GPA."
STUDY_HOURS = "Increasing your dedicated study hours could further reduce your risk."
ATTENDANCE = "Your strong attendance is a positive factor. Keep this up."
GENERAL = ("Your current profile is well-balanced. Continue with your current academic and personal "
           "habits.")
# --------------------------------------------------------------------------------------------------


def advice(feature: Column, contribution: Column) -> Column:
    """Advice for one feature; null where no rule applies. The first rule that fits counts."""
    raises = (F.when(feature.contains("social_media"), SOCIAL_MEDIA)
              .when(feature.contains("mental_health_score"), MENTAL_HEALTH)
              .when(feature == "part_time_job_Yes", PART_TIME_JOB))
    lowers = (F.when(feature.contains("currentGPA") | feature.contains("highSchoolGPA"), GPA)
              .when(feature.contains("study_hours"), STUDY_HOURS)
              .when(feature.contains("attendance"), ATTENDANCE))
    return F.when(contribution > 0, raises).when(contribution < 0, lowers)


def contribution_array(pairs: dict[str, Column]) -> Column:
    """``array<struct<feature, contribution>>`` from named columns."""
    return F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("contribution"))
                     for n, c in pairs.items()])


def top_contributions(contributions: Column, n: int = TOP_FEATURES) -> Column:
    """The ``n`` largest by magnitude, ties by name; sorted inside the row, so nothing is shuffled."""
    keyed = F.transform(contributions, lambda e: F.struct(
        (-F.abs(e["contribution"])).alias("k"), e["feature"].alias("feature"),
        e["contribution"].alias("contribution")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n),
                       lambda e: F.struct(e["feature"].alias("feature"),
                                          e["contribution"].alias("contribution")))


def recommendations(contributions: Column) -> Column:
    """Distinct advice for the top contributions in their order, or the general advice."""
    texts = F.transform(top_contributions(contributions),
                        lambda e: advice(e["feature"], e["contribution"]))
    found = F.array_distinct(F.filter(texts, lambda t: t.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(GENERAL)))


def linear_contributions(names: list[str], coefficients: list[float], means: list[float],
                         features: str = "features") -> Column:
    """Exact contributions of a linear model: coefficient times distance from the mean."""
    x = vector_to_array(features)
    return contribution_array({n: (x[i] - F.lit(float(means[i]))) * F.lit(float(coefficients[i]))
                               for i, n in enumerate(names)})


def long_contributions(df: DataFrame, keys: list[str], column: str = "contributions") -> DataFrame:
    """One row per (key, feature)."""
    return df.select(*keys, F.inline(column))


# ---- tree ensembles --------------------------------------------------------------------------------

def ensemble_leaves(spark: SparkSession, saved_model: str, tree_weights: list[float],
                    forest: bool) -> list[tuple[float, list[tuple]]]:
    """Leaves of a saved tree ensemble as ``(value, steps)``.

    A step is ``(feature, kind, test, cover)``: ``kind`` 'le'/'gt' compares with a threshold, 'in'/
    'out' with a set of categories; ``cover`` is the share of training weight that took the step.
    The node table is as large as the model settings allow, whatever the data.
    """
    nodes: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{saved_model}/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(r["treeID"], {})[r["id"]] = r
    leaves = []
    for tree, table in nodes.items():
        def weight(node) -> float:
            stats = node["impurityStats"]
            return float(sum(stats)) if forest else float(stats[0])

        pending = [(table[0], [])]
        while pending:
            node, steps = pending.pop()
            if node["leftChild"] < 0:
                stats = node["impurityStats"]
                value = stats[1] / sum(stats) / len(nodes) if forest else node["prediction"]
                leaves.append((value * (1.0 if forest else tree_weights[tree]), steps))
                continue
            split = node["split"]
            numeric = split["numCategories"] == -1
            test = split["leftCategoriesOrThreshold"][0] if numeric else tuple(
                split["leftCategoriesOrThreshold"])
            for child, kind in ((node["leftChild"], "le" if numeric else "in"),
                                (node["rightChild"], "gt" if numeric else "out")):
                share = weight(table[child]) / weight(node)
                pending.append((table[child], [*steps, (split["featureIndex"], kind, test, share)]))
    return leaves


def expected_value(leaves) -> float:
    """The ensemble's output averaged over the training rows."""
    return float(sum(v * np.prod([s[3] for s in steps]) for v, steps in leaves))


def _passes(x: np.ndarray, kind: str, test) -> np.ndarray:
    if kind == "le":
        return x <= test
    if kind == "gt":
        return x > test
    return np.isin(x, test) if kind == "in" else ~np.isin(x, test)


#: Rows that walk the trees together: a path of nodes holds a few arrays of this many rows.
_ROWS_AT_ONCE = 2_000


def shared_paths(leaves) -> tuple[list, int]:
    """(the leaves as a tree ``[value, {step: subtree}]``, most different features on one path).

    Leaves with the same first steps share them, so each is walked once.
    """
    root: list = [0.0, {}]
    widest = 1
    for value, steps in leaves:
        node = root
        for step in steps:
            node = node[1].setdefault(step, [0.0, {}])
        node[0] += value
        widest = max(widest, len({s[0] for s in steps}))
    return root, widest


def shapley_values(x: np.ndarray, leaves=None, paths: tuple[list, int] | None = None) -> np.ndarray:
    """Shapley values of a batch of rows: each leaf is a game among the features on its path.

    A feature outside the coalition counts with its cover share, one inside with 0 or 1. The Shapley
    value averages over a coalition chance t between 0 and 1; for one leaf this is the integral of a
    product of linear terms, one per feature, for which a Gauss-Legendre rule of half as many points is exact.
    The product is carried down the tree and the leaves' sums are carried up: a feature's share of all leaves
    below a step is settled at the step, less what an earlier step on the same feature has settled, so every
    step is paid once, not once per leaf.
    """
    root, widest = paths or shared_paths(leaves)
    points, weights = np.polynomial.legendre.leggauss((widest + 1) // 2)
    t, weights = (points + 1) / 2, weights / 2
    phi = np.zeros(x.shape)

    def walk(node: list, rows: np.ndarray, out: np.ndarray, product: np.ndarray, before: dict) -> np.ndarray:
        total = node[0] * product
        for (feature, kind, test, cover), child in node[1].items():
            last = before.get(feature)
            share, inside = cover, _passes(rows[:, feature], kind, test).astype(float)
            if last:
                share, inside = share * last[0], inside * last[1]
            term = np.maximum(share * (1 - t) + inside[:, None] * t, 1e-300)
            slope = (inside - share)[:, None] / term
            before[feature] = share, inside, term, slope
            below = walk(child, rows, out, product * (term / last[2] if last else term), before)
            if last:
                before[feature] = last
            else:
                del before[feature]
            out[:, feature] += (below * (slope - last[3] if last else slope)) @ weights
            total = total + below
        return total

    for at in range(0, len(x), _ROWS_AT_ONCE):
        rows = x[at:at + _ROWS_AT_ONCE]
        walk(root, rows, phi[at:at + _ROWS_AT_ONCE], np.ones((len(rows), len(t))), {})
    return phi


def tests_of(leaves) -> tuple[dict[int, list[float]], list[int]]:
    """({feature: its sorted thresholds}, features tested for categories) of an ensemble."""
    cuts, exact = {}, set()
    for _, steps in leaves:
        for feature, kind, test, _ in steps:
            if kind in ("le", "gt"):
                cuts.setdefault(feature, set()).add(test)
            else:
                exact.add(feature)
    return {feature: sorted(own) for feature, own in sorted(cuts.items())}, sorted(exact)


def cells(x: np.ndarray, tests: tuple[dict[int, list[float]], list[int]]) -> list[bytes]:
    """Names rows by the answers they give to all tests: rows of one cell walk every tree alike.

    A threshold test asks on which side of it a number lies, so the place among the feature's thresholds answers all of
    them; NaN lies on neither side. The value itself answers tests on categories.
    """
    cuts, exact = tests
    places = [np.where(np.isnan(x[:, f]), -1.0, np.searchsorted(own, x[:, f])) for f, own in cuts.items()]
    places += [x[:, f] + 0.0 for f in exact]  # 0 and -0 are one value
    return [row.tobytes() for row in np.column_stack([np.zeros(len(x)), *places])]


def tree_contributions(df: DataFrame, key: str, leaves, names: list[str], features: str = "features",
                       carry: tuple[str, ...] = (), judge: Callable[[DataFrame], DataFrame] | None = None,
                       judged: tuple[str, ...] = ()) -> DataFrame:
    """(key, contributions) for every row, with ``carry`` columns passed along.

    Rows that no test of the ensemble tells apart have equal contributions: each such cell is explained once, dealt over
    all cores, and its rows look it up. There are as many cells as the tests of the model allow, however many the rows.
    ``judge`` adds the ensemble's own outputs, the columns ``judged`` of doubles, to rows with ``features``; these too are
    equal within a cell, so the trees are walked for one row of each.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    every, shared = context.broadcast(tests_of(leaves)), context.broadcast(shared_paths(leaves))
    kept = [key, *carry]

    @F.pandas_udf("binary")
    def cell(x: pd.Series) -> pd.Series:
        return pd.Series(cells(np.vstack(x.to_numpy()), every.value) if len(x) else [], dtype=object)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                phi = shapley_values(np.vstack(batch["x"].to_numpy()), paths=shared.value)
                yield batch[["_cell", *judged]].assign(phi=list(phi))

    # written once and narrow: both sides of the lookup read it, and neither prepares the rows or scores them again
    rows = df.select(*kept, vector_to_array(features).alias("x")).withColumn("_cell", cell("x"))
    path = scratch_path(spark, "cells")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    each = rows.groupBy("_cell").agg(F.first("x").alias("x")).repartition(context.defaultParallelism)
    if judge:
        each = judge(each.withColumn(features, array_to_vector("x"))).select("_cell", "x", *judged)
    kind = ", ".join(["_cell binary", *(f"`{c}` double" for c in judged), "phi array<double>"])
    phi = lookup_join(rows.drop("x"), each.mapInPandas(explain, kind), ["_cell"])
    return phi.select(*kept, *judged, contribution_array({n: F.col("phi")[i] for i, n in enumerate(names)})
                      .alias("contributions"))
