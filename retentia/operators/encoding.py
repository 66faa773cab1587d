"""Category columns of any number of values: distributed codes, sparse vectors, a linear classifier on them.

The values of all category columns form one table (column, value, code): codes are the places of the values in
the vector, counted column by column in sorted order over ranges of values. No value becomes a column and none visits
the driver; rows get their codes by lookup joins. Columns with a declared list stay wide (``features.one_hot``).
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.operators.features import MISSING, known_number, stratified_holdout, z_score
from retentia.operators.joins import lookup_join
from retentia.operators.metrics import classification_metrics, roc_auc
from retentia.operators.ranking import accumulate, ranged
from retentia.operators.training import MAX_ITER, split_labelled, weighted

CODES = "column string, value string, code long"
#: Weights that the driver of a fit holds: the intercept, the numbers and columns of few values.
DENSE = 12
#: Rows whose fit is the start of the fit to all rows.
START_ROWS = 20_000
#: Rows of one value that one task adds up.
HOT_ROWS = 250_000
#: A fit ends where its next step gains less than this share of the loss.
TOLERANCE = 1e-8


def category_value(column: str) -> Column:
    """The text of a category; null is the category 'missing'."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING))


def fit_codes(df: DataFrame, columns: list[str], first: int = 0) -> DataFrame:
    """(column, value, code) of every value that occurs, null as 'missing'; codes run from ``first``, by column and value.

    A frequent value is one row after the map side of the aggregate.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), category_value(c).alias("value"))
                                          for c in columns])).alias("cell"))
    values = cells.groupBy("cell.column", "cell.value").agg(F.lit(1).cast("long").alias("one"))
    by = F.struct("column", "value")
    numbered = accumulate(ranged(values.withColumn("at", by), "at"), "at", ["one"])
    return numbered.select("column", "value", (F.col("one_before") + first).alias("code"))


def with_codes(df: DataFrame, columns: list[str], codes: DataFrame, carried: tuple[str, ...] = ("code",)) -> DataFrame:
    """Add ``_<carried>_<column>`` from the code table; a value the table lacks gives null.

    A lookup join per column: broadcast if the column's values are few, else skewed partitions are split.
    """
    for c in columns:
        name = F.col("value").alias(f"_value_{c}")
        own = codes.filter(F.col("column") == c).select(name, *[F.col(x).alias(f"_{x}_{c}") for x in carried])
        df = lookup_join(df.withColumn(f"_value_{c}", category_value(c)), own, [f"_value_{c}"], "left").drop(f"_value_{c}")
    return df


def one_hot_sparse(df: DataFrame, columns: list[str], codes: DataFrame, into: str = "codes") -> DataFrame:
    """The category columns replaced by the sorted places of their ones; unknown values have none."""
    places = F.array_sort(F.array_compact(F.array(*[F.col(f"_code_{c}") for c in columns])))
    coded = with_codes(df, columns, codes)
    return coded.withColumn(into, places).drop(*columns, *[f"_code_{c}" for c in columns])


def dummies_sparse(df: DataFrame, columns: list[str], codes: DataFrame, into: str = "codes") -> DataFrame:
    """As ``one_hot_sparse`` without the first sorted known value of each column; null gives no one.

    Codes are those of ``codes``, so that places do not move.
    """
    known = codes.filter(F.col("value") != MISSING)
    firsts = known.groupBy("column").agg(F.min("code").alias("code"))
    kept = known.join(F.broadcast(firsts), ["column", "code"], "left_anti")  # one row a column
    return one_hot_sparse(df, columns, kept, into)


def _scaled(df: DataFrame, scales: dict[str, tuple[float, float]]) -> list[Column]:
    return [z_score(F.coalesce(known_number(df, c).cast("double"), F.lit(m)), F.lit(m), F.lit(s)) for c, (m, s) in scales.items()]


def _scales(df: DataFrame, numeric: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each imputed number, from one aggregate."""
    if not numeric:
        return {}
    known = {c: known_number(df, c).cast("double") for c in numeric}
    stats = df.agg(*[F.struct(F.avg(k).alias("m"), F.sqrt(F.var_pop(k) * F.count(k) / F.count("*")).alias("s")).alias(c)
                     for c, k in known.items()]).head()
    return {c: (stats[c]["m"] or 0.0, stats[c]["s"] or 1.0) for c in numeric}


def train_sparse(df: DataFrame, key: str, label: str, numeric: list[str], categorical: list[str], path: str) -> dict:
    """A logistic regression over numbers and category columns of any number of values; returns metrics and the path.

    Fitted on the training share of a stratified hold-out with the penalty and class weights of the other classifiers.
    Stored are the codes and one weight per value (``weights``), the numbers' scales and the intercept (``numbers``).
    The driver holds the weights of the numbers and of few values (``DENSE``); those of columns with more values are
    tables throughout.
    """
    spark = df.sparkSession
    usable, _ = split_labelled(df, label)
    home = f"{path}/{uuid.uuid4().hex}"
    stratified_holdout(usable.select(key, "label", *numeric, *categorical), key, "label").write.parquet(f"{home}/rows")
    rows = spark.read.parquet(f"{home}/rows")
    train = rows.filter(~F.col("is_test"))
    scales = _scales(train, numeric)
    if categorical:
        fit_codes(train, categorical, len(numeric)).write.parquet(f"{home}/codes")
    else:
        spark.createDataFrame([], CODES).write.parquet(f"{home}/codes")
    codes = spark.read.schema(CODES).parquet(f"{home}/codes")
    coded = weighted(with_codes(train, categorical, codes))
    coded.select("label", "weight", *[z.alias(f"_x{i}") for i, z in enumerate(_scaled(coded, scales))],
                 *[F.col(f"_code_{c}") for c in categorical]).write.parquet(f"{home}/vectors")
    fitted, intercept, narrow, wide = fit_logistic(spark.read.parquet(f"{home}/vectors"), len(numeric), categorical, codes, home)
    numbers = [(c, m, s, fitted[i]) for i, (c, (m, s)) in enumerate(scales.items())]
    spark.createDataFrame([*numbers, (None, 0.0, 1.0, intercept)],
                          "column string, mean double, std double, weight double").write.parquet(f"{home}/numbers")
    few = spark.createDataFrame(sorted(narrow.items()), "code long, weight double").join(codes, "code")
    weights = reduce(DataFrame.unionByName, [w.join(codes.filter(F.col("column") == c), "code") for c, w in wide.items()], few)
    weights.select("column", "value", "code", "weight").write.parquet(f"{home}/weights")
    scored = score_sparse(rows.filter("is_test"), home, [key, "label"]).withColumnRenamed("probability", "p").withColumn(
        "prediction", (F.col("p") > 0.5).cast("double"))
    metrics = classification_metrics(scored).head().asDict()
    metrics["roc_auc"] = roc_auc(scored, score="p").head()["roc_auc"]
    return {"type": "classification", "target": label, "model_name": "sparse_logistic_regression", "model_path": home,
            "metrics": {k: v for k, v in metrics.items() if v is not None}}


def fit_logistic(rows: DataFrame, numbers: int, categorical: list[str], codes: DataFrame, home: str
                 ) -> tuple[list[float], float, dict[int, float], dict[str, DataFrame]]:
    """(weights of the numbers, intercept, {code: weight} of columns with few values, {column: (code, weight)}).

    Minimises the weighted logistic loss with the penalty ``1 / rows`` per unit of mean weight, the intercept free, by
    Newton's method. Given the dense weights, the weights of one column's values do not meet in any row, so their part of
    the Hessian is a diagonal: each value has its own sums, and the dense weights solve what is left, ``DENSE`` numbers
    wide. Columns with many values take turns until the loss stands still; one alone needs one turn.
    """
    spark = rows.sparkSession
    about = rows.agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("label").alias("a"), F.max("label").alias("b")).head()
    if not about["n"]:
        raise ValueError("no labelled rows to fit on")
    sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count("*").alias("n")).collect()}  # one row a column
    few: list[str] = []
    for c in sorted(categorical, key=lambda c: (sizes[c], c)):
        if numbers + sum(sizes[x] for x in [*few, c]) < DENSE:
            few.append(c)
    wide = [c for c in categorical if c not in few]
    places = [r["code"] for r in codes.filter(F.col("column").isin(few)).select("code").orderBy("code").collect()]  # DENSE
    zero = {c: codes.filter(F.col("column") == c).select("code", F.lit(0.0).alias("weight")) for c in wide}
    if about["a"] == about["b"]:
        return [0.0] * numbers, math.inf if about["b"] else -math.inf, dict.fromkeys(places, 0.0), zero
    of = {r["code"]: r["column"] for r in codes.filter(F.col("code").isin(places)).collect()}
    dense = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(numbers)],
             *[(F.col(f"_code_{of[k]}") == k).cast("double") for k in places]]
    d, strength = len(dense), about["w"] / about["n"]
    cells = rows.select("label", "weight", *[x.alias(f"x{j}") for j, x in enumerate(dense)],
                        *[F.col(f"_code_{c}").alias(f"v_{i}") for i, c in enumerate(wide)], F.lit(-1).cast("long").alias("v_"))
    some = cells.sample(min(1.0, START_ROWS / about["n"]), seed=42).select("label", "weight", *[f"x{j}" for j in range(d)]).toPandas()
    theta, squares, loss = _start(some.to_numpy(dtype=float), about["w"], strength), {}, math.inf
    weights: dict[str, DataFrame] = {}
    turns = [f"v_{i}" for i in range(len(wide))] or ["v_"]
    for _ in range(MAX_ITER):
        before = loss
        for own in turns:
            block = cells.withColumn("rest", F.lit(0.0))
            for other in weights:
                if other != own:
                    block = lookup_join(block, weights[other].withColumnsRenamed({"code": other, "weight": "_u"}), [other], "left"
                                        ).withColumn("rest", F.col("rest") + F.col("_u")).drop("_u")
            rest = sum(x for c, x in squares.items() if c != own)
            theta, weights[own], squares[own], loss = _newton(
                block.select("label", "weight", "rest", F.col(own).alias("code"), *[f"x{j}" for j in range(d)]),
                weights.get(own), theta, strength, rest, f"{home}/fit")
        if len(turns) == 1 or before - loss <= TOLERANCE * loss:
            break
    values = [float(x) for x in theta]
    return (values[1:numbers + 1], values[0], dict(zip(places, values[numbers + 1:])),
            {c: weights[f"v_{i}"] for i, c in enumerate(wide)})


def _start(some: np.ndarray, total: float, strength: float) -> np.ndarray:
    """Where the dense weights start: their fit to a few rows, weighted up to all, without the other columns.

    Only the number of rounds depends on it.
    """
    theta = np.zeros(some.shape[1] - 2)
    if not len(some):
        return theta
    y, x = some[:, 0], some[:, 2:]
    a = some[:, 1] * (total / some[:, 1].sum())
    fine = np.r_[0.0, np.full(len(theta) - 1, strength)]
    cost = lambda t: float(a @ (np.logaddexp(0, x @ t) - y * (x @ t)) + fine @ t**2 / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        slope = x.T @ (a * (p - y)) + fine * theta
        step = np.linalg.lstsq((x * (a * p * (1 - p))[:, None]).T @ x + np.diag(fine), -slope, rcond=None)[0]
        share, now = 1.0, cost(theta)
        while share > 1e-6 and not cost(theta + share * step) <= now:
            share /= 2
        if share <= 1e-6 or -slope @ step <= TOLERANCE * now:
            break
        theta = theta + share * step
    return np.clip(theta, -30, 30)  # a sample of one class alone has no finite intercept


def _newton(block: DataFrame, weights: DataFrame | None, theta: np.ndarray, strength: float, rest: float, home: str):
    """(dense weights, (code, weight), its sum of squares, loss) at the minimum over both, ``rest`` of the margin fixed.

    The rows are dealt by code once and stay where they are; a code of many rows is cut into slices. A round adds up the
    sums of each code in place, writes them, and the driver sees their totals in one row.
    """
    spark, d = block.sparkSession, len(theta)
    fine = np.r_[0.0, np.full(d - 1, strength)]
    hot = block.groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).select(
        "code", F.ceil(F.col("n") / HOT_ROWS).alias("slices"))
    hot.write.parquet(path := f"{home}/{uuid.uuid4().hex}")
    hot = F.broadcast(spark.read.schema("code long, slices long").parquet(path))  # at most rows / HOT_ROWS
    sliced = not hot.isEmpty()
    by = ["code", "slice"] if sliced else ["code"]
    if sliced:
        block = block.join(hot, "code", "left").withColumn("slice", F.pmod(F.xxhash64(
            F.monotonically_increasing_id()), F.coalesce("slices", F.lit(1)))).drop("slices")
    block = block.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).persist()
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    share, last, found = 1.0, None, None
    try:
        for _ in range(MAX_ITER):
            if weights is None:
                rows = block.withColumn("u", F.lit(0.0))
            else:
                own = weights.withColumnRenamed("weight", "u")
                if sliced:
                    own = own.join(hot, "code", "left").withColumn("slice", F.explode(F.sequence(
                        F.lit(0).cast("long"), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
                rows = block.join(own.hint("merge"), by)
            x = [F.col(f"x{j}") for j in range(d)]
            m = sum((F.lit(float(t)) * c for t, c in zip(theta, x)), F.col("u") + F.col("rest"))
            rows = rows.withColumn("m", m).withColumn("p", 1 / (1 + F.exp(-F.col("m"))))
            rows = rows.withColumns({
                "r": F.col("weight") * (F.col("p") - F.col("label")), "h": F.col("weight") * F.col("p") * (1 - F.col("p")),
                "l": F.col("weight") * (F.log1p(F.exp(-F.abs("m"))) + F.greatest("m", F.lit(0.0)) - F.col("label") * F.col("m"))})
            sums = {"g": F.col("r"), "q": F.col("h"), "l": F.col("l"), **{f"g{j}": F.col("r") * x[j] for j in range(d)},
                    **{f"b{j}": F.col("h") * x[j] for j in range(d)},
                    **{f"a{i}_{j}": F.col("h") * x[i] * x[j] for i, j in pairs}}
            each = rows.groupBy(*by).agg(F.max("u").alias("u"), *[F.sum(e).alias(c) for c, e in sums.items()])
            if sliced:
                each = each.groupBy("code").agg(F.max("u").alias("u"), *[F.sum(c).alias(c) for c in sums])
            each = each.withColumns({"g": F.col("g") + strength * F.col("u"), "q": F.col("q") + strength})
            b = [F.col(f"b{j}") / F.col("q") for j in range(d)]
            each.write.parquet(path := f"{home}/{uuid.uuid4().hex}")
            files = spark.read.schema(", ".join(["code long", *[f"{c} double" for c in ("u", *sums)]])).parquet(path)
            got = files.agg(
                F.sum("l").alias("l"), F.sum(F.col("u") ** 2).alias("u"), F.sum(F.col("g") ** 2 / F.col("q")).alias("gg"),
                *[F.sum(F.col(f"g{j}") - b[j] * F.col("g")).alias(f"g{j}") for j in range(d)],
                *[F.sum(F.col(f"a{i}_{j}") - b[i] * F.col(f"b{j}")).alias(f"a{i}_{j}") for i, j in pairs]).head()
            loss = got["l"] + strength / 2 * (got["u"] + rest) + float(fine @ theta**2) / 2
            if last is not None and not loss <= last[0] * (1 + 1e-9) and share > 1e-4:
                share /= 2  # too far: half the way
                theta, weights = found(share)
                continue
            matrix = np.diag(fine)
            for i, j in pairs:
                matrix[i, j] += got[f"a{i}_{j}"]
                matrix[j, i] = matrix[i, j]
            slope = np.array([got[f"g{j}"] for j in range(d)]) + fine * theta
            step = np.linalg.lstsq(matrix, -slope, rcond=None)[0]
            at = theta

            def found(part: float, at=at, step=step, files=files):
                move = sum((F.lit(float(t)) * F.col(f"b{j}") for j, t in enumerate(step)), F.col("g")) / F.col("q")
                return at + part * step, files.select("code", (F.col("u") - part * move).alias("weight"))

            share, last = 1.0, (loss,)
            theta, weights = found(share)
            if got["gg"] - float(slope @ step) <= TOLERANCE * loss:  # the step taken gains half of this
                break
    finally:
        block.unpersist()
    weights.write.parquet(path := f"{home}/{uuid.uuid4().hex}")
    weights = spark.read.schema("code long, weight double").parquet(path)
    return theta, weights, weights.agg(F.sum(F.col("weight") ** 2)).head()[0], loss


def score_sparse(df: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """(``keep``, probability) of every row by a stored model: no vector is built, each value's weight is looked up.

    Unknown values weigh nothing; gaps in numbers are the training mean.
    """
    spark = df.sparkSession
    stored = spark.read.parquet(f"{path}/numbers").collect()  # one row a number
    numbers = [r for r in stored if r["column"] is not None]
    intercept = next(r["weight"] for r in stored if r["column"] is None)
    scaled = _scaled(df, {r["column"]: (r["mean"], r["std"]) for r in numbers})
    weights = spark.read.parquet(f"{path}/weights")
    columns = [r["column"] for r in weights.select("column").distinct().collect()]  # one row a category column
    joined = with_codes(df, columns, weights, ("weight",))
    terms = [z * F.lit(r["weight"]) for z, r in zip(scaled, numbers)] + [
        F.coalesce(F.col(f"_weight_{c}"), F.lit(0.0)) for c in columns]
    margin = reduce(lambda a, b: a + b, terms, F.lit(intercept))
    return joined.select(*keep, (1 / (1 + F.exp(-margin))).alias("probability"))
