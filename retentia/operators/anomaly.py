"""Isolation forest (Liu, Ting, Zhou 2008) over tables, with explanations and insights."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.operators.features import dummies
from retentia.operators.ranking import category_codes, exact_medians, exact_quantile
from retentia.schemas import ANOMALY_CODED, ANOMALY_NUMERIC
from retentia.session import checkpointed

# ---- fixed values: forest settings ---------------------------------------------------------------
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42
LOW, HIGH = "Unusually low", "Unusually high"
# --------------------------------------------------------------------------------------------------

_NODES = ("tree int, node int, feature int, threshold double, left int, right int, "
          "depth int, rows int")
_BUCKETS = 1 << 31


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def draw_samples(df: DataFrame, key: str, features: list[str], trees: int = TREES,
                 sample: int = SAMPLE, seed: int = SEED) -> tuple[DataFrame, int]:
    """(rows of each tree's sample, rows per tree).

    Every row takes part in the draw of every tree, by a hash of its key, its features and the tree; a tree keeps
    its ``sample`` smallest hashes. Only hashes below about twice the wanted share become rows, whatever the table
    size. Rows equal in key and features are drawn together.
    """
    total = df.count()
    per_tree = min(sample, total)
    rows = df.select(key, F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    chance = min(1.0, 2.0 * per_tree / max(total, 1) + 16.0 / max(total, 1))
    drawn = F.filter(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
            t.alias("tree"), F.pmod(F.xxhash64(F.col(key), F.col("x"), t, F.lit(seed)), F.lit(_BUCKETS)).alias("h"))),
        lambda d: d["h"] < int(_BUCKETS * chance))
    dealt = rows.withColumn("_d", F.explode(drawn)).select(key, "x", "_d.tree", F.col("_d.h").alias("_h"))
    # trees are small but slow to grow: spread them although their bytes would fit one task
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    ranked = dealt.repartition(tasks, "tree").withColumn(
        "_r", F.row_number().over(Window.partitionBy("tree").orderBy("_h", key)))
    return ranked.filter(F.col("_r") <= per_tree).select("tree", "x"), per_tree


def _grow(tree: int, x: np.ndarray, seed: int) -> list[tuple]:
    """One isolation tree: a random feature that still varies, cut at a random point."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    pending = [(x, 0, None, None)]
    while pending:
        rows, depth, parent, side = pending.pop()
        node = len(nodes)
        nodes.append([tree, node, -1, 0.0, -1, -1, depth, len(rows)])
        if parent is not None:
            nodes[parent][side] = node
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth == limit or len(rows) <= 1 or not len(varied):
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = rows[:, feature] <= cut
        nodes[node][2:4] = [feature, cut]
        pending += [(rows[~goes_left], depth + 1, node, 5), (rows[goes_left], depth + 1, node, 4)]
    return [tuple(n) for n in nodes]


def fit_forest(df: DataFrame, key: str, features: list[str], trees: int = TREES,
               sample: int = SAMPLE, seed: int = SEED) -> tuple[pd.DataFrame, int]:
    """(node table, rows per tree); each tree grows in its own task from at most ``sample`` rows.

    The node table has at most ``trees * 2 * sample`` rows, so it may visit the driver.
    """
    samples, per_tree = draw_samples(df, key, features, trees, sample, seed)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        x = np.vstack(sorted(group["x"], key=tuple))
        return pd.DataFrame(_grow(tree, x, seed), columns=[c.split()[0] for c in _NODES.split(", ")])

    return samples.groupBy("tree").applyInPandas(grow, _NODES).toPandas(), per_tree


def raw_score(df: DataFrame, features: Column, nodes: pd.DataFrame, per_tree: int) -> Column:
    """Minus 2 to the power of the relative mean path of an array of features; lower is stranger."""
    forest = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append((t["feature"].to_numpy(), t["threshold"].to_numpy(), t["left"].to_numpy(),
                       t["right"].to_numpy(), (t["depth"] + average_path(t["rows"])).to_numpy(),
                       int(t["depth"].max())))
    shared = df.sparkSession.sparkContext.broadcast(forest)
    scale = float(average_path(per_tree)) or 1.0

    @F.pandas_udf("double")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype="float64")
                continue
            x = np.vstack(batch.to_numpy())
            every = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, cut, left, right, length, depth in shared.value:
                at = np.zeros(len(x), dtype=int)
                for _ in range(depth):
                    f = feature[at]
                    down = np.where(x[every, f] <= cut[at], left[at], right[at])
                    at = np.where(f < 0, at, down)
                total += length[at]
            yield pd.Series(-np.exp2(-total / max(len(shared.value), 1) / scale))

    return walk(features)


def flag_lowest(scored: DataFrame, raw: str = "raw_score", share: float = CONTAMINATION) -> DataFrame:
    """Shift scores by their exact ``share`` quantile; below zero is an anomaly (-1), else 1."""
    cut = exact_quantile(scored, raw, share).scalar()
    shifted = scored.withColumn("anomaly_score", F.col(raw) - cut)
    return shifted.withColumn("is_anomaly", F.when(F.col("anomaly_score") < 0, -1).otherwise(1))


def extreme_feature(features: list[str], stats: Column) -> Column:
    """Struct (feature, value, description) of the largest z-score of a row; ties by feature order.

    ``stats`` is a one-row struct of (mean, std) per feature.
    """
    scored = F.array(*[F.struct(
        F.abs((F.col(c) - stats[c]["mean"]) / F.when(stats[c]["std"] == 0, 1.0).otherwise(stats[c]["std"]))
        .alias("z"), F.lit(-i).alias("order"), F.lit(c).alias("feature"),
        F.col(c).cast("double").alias("value"),
        F.when(F.col(c) < stats[c]["mean"], LOW).otherwise(HIGH).alias("description"))
        for i, c in enumerate(features)])
    best = F.array_max(F.filter(scored, lambda e: e["z"].isNotNull()))
    return F.struct(best["feature"].alias("feature"), best["value"].alias("value"),
                    best["description"].alias("description"))


def explain_flagged(df: DataFrame, features: list[str]) -> DataFrame:
    """Flagged rows with their most extreme feature, measured against the whole population."""
    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c)
                              for c in features])).scalar()
    return df.withColumn("_stats", stats).filter(F.col("is_anomaly") == -1).withColumn(
        "extreme", extreme_feature(features, F.col("_stats"))).drop("_stats")


def choose_features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numeric anomaly features present, plus codes of the category columns present."""
    numeric = [c for c in ANOMALY_NUMERIC if c in df.columns]
    if not numeric:
        raise ValueError("none of " + ", ".join(ANOMALY_NUMERIC) + " is present")
    coded = [c for c in ANOMALY_CODED if c in df.columns]
    for c in coded:
        df = category_codes(df, c, f"{c}_code")
    return df, numeric + [f"{c}_code" for c in coded]


def _filled(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Each feature with its gaps, null or NaN, filled by its median (0 without any value)."""
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    holes = df.agg(*[F.count_if(k.isNull()).alias(c) for c, k in known.items()]).head()
    gaps = [c for c in columns if holes[c]]
    medians = {r["feature"]: r["median"] for r in exact_medians(df, gaps).collect()} if gaps else {}
    return {c: F.coalesce(k, F.lit(medians.get(c) or 0.0)) if c in gaps else k for c, k in known.items()}


def detect(df: DataFrame, key: str, features: list[str], trees: int = TREES, sample: int = SAMPLE,
           share: float = CONTAMINATION, seed: int = SEED) -> DataFrame:
    """All rows of ``df``, as they are, with ``anomaly_score`` and ``is_anomaly``.

    A score depends on the features alone, their gaps filled by medians, so no row is joined by its key: null and
    repeated keys keep their rows. The features and the raw scores are each written once, narrow, to the shared folder.
    """
    narrow = checkpointed(df.select(key, *features))
    filled = _filled(narrow, features)
    nodes, per_tree = fit_forest(narrow.withColumns(filled), key, features, trees, sample, seed)

    def scored(rows: DataFrame) -> DataFrame:
        return rows.withColumn("raw_score", raw_score(rows, F.array(*filled.values()), nodes, per_tree))

    cut = exact_quantile(checkpointed(scored(narrow).select("raw_score")), "raw_score", share).head()["q"]
    shifted = scored(df).withColumn("anomaly_score", F.col("raw_score") - F.lit(cut))
    return shifted.withColumn("is_anomaly", F.when(F.col("anomaly_score") < 0, -1).otherwise(1)).select(
        *df.columns, "anomaly_score", "is_anomaly")


def detect_in_file(df: DataFrame, key: str, **settings) -> DataFrame:
    """Detection on an uploaded table, by its known numeric and category columns."""
    chosen, features = choose_features(df)
    return detect(chosen, key, features, **settings)


def detect_in_table(df: DataFrame, key: str, numeric: list[str], categorical: list[str],
                    **settings) -> DataFrame:
    """Detection on the entity table: declared numbers and one 0/1 column per category value."""
    wide = dummies(df.select(key, *numeric, *categorical), categorical)
    features = [c for c in wide.columns if c != key]
    return detect(wide, key, features, **settings).select(key, *features, "anomaly_score", "is_anomaly")
