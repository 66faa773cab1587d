"""Exact top-k inner products by pivot-table elimination.

Vectors become integers. Adding one coordinate ``sqrt(M² - |x|²)`` to every candidate (0 to every query), with M the
largest norm, turns the largest inner product into the nearest neighbour, where the triangle inequality holds. A table
holds each candidate's distance to many pivots; ``max |d(q, p) - d(x, p)|`` bounds ``d(q, x)`` from below, so it bounds
the score from above. A query reads candidates in bound order and stops when the next bound is below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import checkpointed

#: Pivots, drawn by hash of the id: the only part fitted on a bounded sample. Every row is indexed against them.
PIVOTS = 32
SCALE = 256
#: Rows of a query block and of a candidate block; one task holds one of each.
QUERY_BLOCK, CANDIDATE_BLOCK = 2_048, 8_192
#: Candidates a query scores at once between two looks at its bound.
STEP = 64


def quantised(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, v array<long>, dim): floor(scale * x) of each component; null, empty and non-finite vectors are left out.

    Scores are exact while dim * max|v|² is below 2 ** 62.
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    return (df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), x.alias("x"))
            .filter((F.size("x") > 0) & F.coalesce(_usable("x"), F.lit(False)))
            .select("key", F.transform("x", lambda c: F.floor(c * scale)).alias("v"), F.size("x").alias("dim")))


def _usable(column: str) -> Column:
    return F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS, key: str = "key") -> tuple[DataFrame, dict, dict]:
    """(key, v, dim, dist array<double>): the distance of each augmented vector to the pivots of its dimension.

    Also the pivots and the largest squared norm by dimension, both of bounded size.
    """
    chosen = vectors.select("dim").distinct().collect()
    axes = {}
    for row in chosen:
        own = vectors.filter(F.col("dim") == row["dim"])
        some = own.orderBy(F.xxhash64(key), key).limit(pivots).collect()
        axes[row["dim"]] = np.array([r["v"] for r in some], dtype=np.float64)
    norms = {r["dim"]: float(r["m"]) for r in vectors.groupBy("dim").agg(F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("m")).collect()}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                x = np.array(part["v"].tolist(), dtype=np.float64)
                yield part.assign(dist=list(distances(x, axes[dim], norms[dim], candidate=True)))

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.mapInPandas(measure, f"{key} {kind}, v array<long>, dim int, dist array<double>"), axes, norms


def distances(x: np.ndarray, pivots: np.ndarray, most: float, candidate: bool) -> np.ndarray:
    """Distances in the augmented space; pivots are candidates, so they have the added coordinate."""
    lift = lambda v: np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0.0))
    extra = lift(x) if candidate else np.zeros(len(x))
    own = (x * x).sum(axis=1) + extra**2
    theirs = lift(pivots)
    squared = own[:, None] + most - 2 * (x @ pivots.T + extra[:, None] * theirs[None, :])
    return np.sqrt(np.maximum(squared, 0.0))


def best_of_block(q: np.ndarray, q_keys: np.ndarray, q_dist: np.ndarray, x: np.ndarray, x_keys: np.ndarray,
                  x_dist: np.ndarray, most: float, k: int) -> list[tuple]:
    """For each query its ``k`` best of the block, as (query, key, score): largest score, then smallest key."""
    out = []
    q_norm = (q * q).sum(axis=1).astype(np.float64)
    for i in range(len(q)):
        bound = np.zeros(len(x))
        for p in range(x_dist.shape[1]):
            np.maximum(bound, np.abs(x_dist[:, p] - q_dist[i, p]), out=bound)
        # |q|² + M² - d² over 2, with room for rounding
        upper = (q_norm[i] + most - bound * bound) / 2
        upper += 1e-9 * (q_norm[i] + most) + 1e-6
        order = np.argsort(-upper, kind="stable")
        scores, keys = np.empty(0, dtype=np.int64), np.empty(0, dtype=x_keys.dtype)
        for at in range(0, len(order), STEP):
            if len(scores) >= k and upper[order[at]] < scores[k - 1]:
                break
            some = order[at:at + STEP]
            some = some[x_keys[some] != q_keys[i]]
            scores = np.concatenate([scores, x[some] @ q[i]])
            keys = np.concatenate([keys, x_keys[some]])
            rank = np.lexsort((keys, -scores))[:k]
            scores, keys = scores[rank], keys[rank]
        out += [(q_keys[i], key, score) for key, score in zip(keys, scores)]
    return out


def top_k(candidates: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, scale: int = SCALE,
          pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank from 1, ``key``, score): each query's ``k`` largest integer inner products, ties to the
    smaller key; a query's own key is no candidate. ``key`` is an integer id. Rows of the same key and integer vector count
    once, as queries and as candidates; a key with several different vectors has each of them ranked.

    Queries and candidates are dealt into blocks and every pair of blocks meets in one task, which keeps ``k`` rows a
    query; the work is |queries| x |candidates| at most, the shuffle |candidates| x query blocks. Only vectors of the
    same dimension are compared. Rows without a usable vector take no part; no candidates, no rows.
    """
    vectors = quantised(candidates, key, vector, scale)
    indexed, axes, norms = pivot_table(vectors, pivots)
    indexed = checkpointed(indexed.dropDuplicates(["key", "v"]))
    asked = quantised(queries, key, vector, scale).filter(F.col("dim").isin(list(axes) or [0])).dropDuplicates(["key", "v"])
    n_queries, n = max(asked.count(), 1), max(indexed.count(), 1)
    across, down = -(-n_queries // QUERY_BLOCK), -(-n // CANDIDATE_BLOCK)
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    left = asked.withColumn("a", block(across)).withColumn("b", grid(down))
    right = indexed.withColumn("b", block(down)).withColumn("a", grid(across))

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "key": [], "score": []}).astype("int64")
        dim = int(x["dim"].iloc[0])
        qv = np.array(q["v"].tolist(), dtype=np.int64)
        xv = np.array(x["v"].tolist(), dtype=np.int64)
        found = best_of_block(qv, q["key"].to_numpy(), distances(qv.astype(float), axes[dim], norms[dim], False),
                              xv, x["key"].to_numpy(), np.array(x["dist"].tolist()), norms[dim], k)
        return pd.DataFrame(found, columns=["query_id", "key", "score"]).astype("int64")

    met = left.groupBy("dim", "a", "b").cogroup(right.groupBy("dim", "a", "b")).applyInPandas(
        meet, "query_id long, key long, score long")
    best = met.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("score"), "key"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("b.key").alias(key),
        (-F.col("b.score")).alias("score"))
