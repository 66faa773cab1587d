"""Linear regressions of many targets from two passes over the rows, whatever their number.

The first pass takes centre, spread and category values of all columns in one aggregate. The second sums, for every
target, the products of all pairs of columns over its training and its test rows: gaps are a zero and a mark, so that
each target's own mean can be put in afterwards. From these sums every regression is solved in closed form, and its
test error is a quadratic form in the sums of its test rows, so nothing is fitted or scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators.features import MISSING, known_number

#: Most columns of the products; with more the caller has to fit iteratively.
WIDTH = 512
#: Directions with less than this share of the largest spread are left out of a solution.
FLAT = 1e-11
FOLDER = "linear_fits"


@dataclass(frozen=True)
class LinearFit:
    """``intercept`` plus weights: (mean for gaps, weight) of numbers, weight of each category value."""

    target: str
    intercept: float
    numbers: dict[str, tuple[float, float]]
    categories: dict[str, dict[str, float]] = field(default_factory=dict)

    def predicted(self, df: DataFrame) -> Column:
        """The prediction of a row; a gap counts as the training mean, an unknown value adds nothing."""
        out = F.lit(self.intercept)
        for c, (mean, weight) in self.numbers.items():
            out = out + F.coalesce(known_number(df, c).cast("double"), F.lit(mean)) * F.lit(weight)
        for c, weights in self.categories.items():
            if weights:
                table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
                out = out + F.coalesce(F.try_element_at(table, F.coalesce(F.col(c).cast("string"), F.lit(MISSING))), F.lit(0.0))
        return out


@dataclass(frozen=True)
class Layout:
    """Places of the columns among the products: 1, numbers, their gap marks, category values."""

    numeric: list[str]
    categories: dict[str, list[str]]
    centre: np.ndarray
    spread: np.ndarray

    @property
    def first_category(self) -> int:
        return 1 + 2 * len(self.numeric)

    @property
    def width(self) -> int:
        return self.first_category + sum(map(len, self.categories.values()))

    def rows(self, batch: pd.DataFrame) -> np.ndarray:
        """The rows of a batch in this layout; numbers centred and scaled."""
        x = (batch[self.numeric].to_numpy(dtype=np.float64) - self.centre) / self.spread
        gaps = np.isnan(x)
        out = np.zeros((len(batch), self.width))
        out[:, 0] = 1
        out[:, 1:1 + len(self.numeric)] = np.where(gaps, 0, x)
        out[:, 1 + len(self.numeric):self.first_category] = gaps
        at = self.first_category
        for c, values in self.categories.items():
            place = pd.Index(values).get_indexer(batch[c])
            known = np.flatnonzero(place >= 0)
            out[known, at + place[known]] = 1
            at += len(values)
        return out


def survey(rows: DataFrame, numeric: list[str], categorical: list[str], width: int = WIDTH) -> Layout | None:
    """Centre, spread and values of all columns from one aggregate; None if the values are too many for ``width``."""
    cells = [F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), F.col(c).alias("x")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.lit(None).cast("double").alias("x")) for c in categorical]
    found = (rows.select(F.inline(F.array(*cells))).groupBy("column", "value")
             .agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
             .orderBy(F.col("value").asc_nulls_first(), "column").limit(len(numeric) + width).collect())
    numbers = {r["column"]: r for r in found if r["value"] is None}
    layout = Layout(numeric, {c: sorted(r["value"] for r in found if r["column"] == c and r["value"] is not None) for c in categorical},
                    np.array([numbers[c]["m"] or 0.0 if c in numbers else 0.0 for c in numeric]),
                    np.array([numbers[c]["s"] or 1.0 if c in numbers else 1.0 for c in numeric]))
    return layout if layout.width <= width else None


def products(rows: DataFrame, layout: Layout, targets: list[str], test: str) -> dict[tuple[int, bool], np.ndarray]:
    """Sums of the products of all pairs of columns, by (target, whether test row), over rows that know the target.

    Tasks add up their own rows; what they send is summed by cell, so no task holds more than its own sums.
    """
    places = [layout.numeric.index(t) for t in targets]
    upper = np.triu_indices(layout.width)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(targets), 2, layout.width, layout.width))
        for batch in batches:
            x, in_test = layout.rows(batch), batch[test].to_numpy(dtype=bool)
            for k, place in enumerate(places):
                known = x[:, 1 + len(layout.numeric) + place] == 0
                for part in (0, 1):
                    own = x[known & (in_test == bool(part))]
                    total[k, part] += own.T @ own
        for k, part in np.ndindex(total.shape[:2]):
            v = total[k, part][upper]
            yield pd.DataFrame({"target": k, "test": bool(part), "i": upper[0], "j": upper[1], "v": v})[v != 0]

    sums = rows.mapInPandas(add, "target int, test boolean, i int, j int, v double").groupBy(
        "target", "test", "i", "j").agg(F.sum("v").alias("v")).toArrow().to_pandas()
    out = {(k, part): np.zeros((layout.width, layout.width)) for k in range(len(targets)) for part in (False, True)}
    for (k, part), cells in sums.groupby(["target", "test"]):
        own = out[k, bool(part)]
        own[cells["i"], cells["j"]] = own[cells["j"], cells["i"]] = cells["v"]
    return out


def solve(layout: Layout, target: str, features: list[str], train: np.ndarray, test: np.ndarray) -> tuple[LinearFit, dict]:
    """The least-squares fit with the smallest weights, and its mean squared error and R squared on the test rows."""
    p, y = len(layout.numeric), 1 + layout.numeric.index(target)
    used = [layout.numeric.index(c) for c in features]
    basis = np.zeros((layout.width, 1 + len(used) + layout.width - layout.first_category))
    basis[0, 0] = 1
    means = np.zeros(len(used))
    for k, j in enumerate(used):
        known = train[0, 0] - train[0, 1 + p + j]
        # a column without a known value counts as 0
        means[k] = train[0, 1 + j] / known if known else -layout.centre[j] / layout.spread[j]
        basis[1 + j, 1 + k], basis[1 + p + j, 1 + k] = 1, means[k]
    for k in range(layout.width - layout.first_category):
        basis[layout.first_category + k, 1 + len(used) + k] = 1
    scale = max(train[0, 0], 1)
    weights = np.linalg.pinv(basis.T @ train @ basis / scale, rcond=FLAT, hermitian=True) @ (basis.T @ train[:, y] / scale)
    unit, own = layout.spread[y - 1], [layout.spread[j] for j in used]
    numbers = {layout.numeric[j]: (float(means[k] * own[k] + layout.centre[j]), float(weights[1 + k] * unit / own[k]))
               for k, j in enumerate(used)}
    at, categories = 1 + len(used), {}
    for c, values in layout.categories.items():
        categories[c] = {v: float(w * unit) for v, w in zip(values, weights[at:at + len(values)])}
        at += len(values)
    shift = sum(weights[1 + k] * layout.centre[j] / own[k] for k, j in enumerate(used))
    fit = LinearFit(target, float(layout.centre[y - 1] + unit * (weights[0] - shift)), numbers, categories)
    n = test[0, 0]
    if not n:
        return fit, {}
    miss = -basis @ weights
    miss[y] += 1
    error, spread = max(float(miss @ test @ miss), 0.0), float(test[y, y] - test[0, y] ** 2 / n)
    metrics = {"mse": float(error / n * unit**2)}
    if spread > 0:
        metrics["r2_score"] = float(1 - error / spread)
    return fit, metrics


def save_fits(spark: SparkSession, fits: list[LinearFit], path: str) -> None:
    """All fits as one table; ``load_fit`` reads one of them."""
    rows = [(f.target, None, None, None, f.intercept) for f in fits]
    rows += [(f.target, c, None, mean, weight) for f in fits for c, (mean, weight) in f.numbers.items()]
    rows += [(f.target, c, v, None, w) for f in fits for c, own in f.categories.items() for v, w in own.items()]
    spark.createDataFrame(rows, "target string, column string, value string, mean double, weight double").coalesce(
        1).write.mode("overwrite").parquet(path)


def load_fit(spark: SparkSession, path: str) -> LinearFit:
    """The fit stored as ``<table>/<target>``."""
    table, _, target = path.rpartition("/")
    rows = spark.read.parquet(table).filter(F.col("target") == target).collect()
    intercept = next(r["weight"] for r in rows if r["column"] is None)
    numbers = {r["column"]: (r["mean"], r["weight"]) for r in rows if r["column"] is not None and r["value"] is None}
    categories: dict[str, dict[str, float]] = {}
    for r in rows:
        if r["value"] is not None:
            categories.setdefault(r["column"], {})[r["value"]] = r["weight"]
    return LinearFit(target, intercept, numbers, categories)
