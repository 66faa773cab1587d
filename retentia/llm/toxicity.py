"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all other text is unlabelled: some of it is toxic too. A linear model over
hashed words and pieces of words minimises ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss: the second term is
the risk on negatives, estimated from unlabelled text by taking the positives' share out, and it may not turn
negative, which would mean that the model learns single examples by heart. Negative labels are used for one thing, the
class prior.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import stored

#: Most rows the model is fitted on: toxic examples and unlabelled texts, drawn by hash of the id.
POSITIVES, UNLABELLED = 3_000, 6_000
#: Hash space of the features and number of features that carry a weight.
BUCKETS, FEATURES = 1 << 18, 512
#: A document is predicted toxic from this score on.
THRESHOLD = 0.3
#: Share of toxic ones aimed at among the documents that are rejected, and models that are fitted to choose the cut.
PRECISION, FOLDS = 0.95, 3
#: Steps of the score in which the cut is chosen.
CUT_STEPS = 1_000
#: A feature counts if its document frequencies differ by so many standard errors.
LEAST_Z = 4
PRIOR = 0.1
_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def buckets(word: str) -> list[int]:
    """Hashed features of a word: itself, its beginnings of 2 to 5 letters and its runs of 3 and 4."""
    shown = f"<{word}>"
    parts = {f"={word}"} | {f"<{word[:k]}" for k in range(2, 6) if len(word) >= k}
    parts |= {shown[i:i + k] for k in (3, 4) for i in range(len(shown) - k + 1)}
    return [zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1) for x in parts]


class Features(dict):
    """Buckets of words, remembered."""

    def __missing__(self, word: str) -> array:
        if len(self) >= 100_000:
            self.clear()
        self[word] = own = array("i", buckets(word))
        return own

    def of(self, text: str | None) -> set[int]:
        return {b for w in words(text) for b in self[w]}


class Masks(dict):
    """The wanted buckets of words as bits of a whole number, remembered."""

    def __init__(self, wanted):
        super().__init__()
        self.place = {b: i for i, b in enumerate(wanted)}
        self.width = -(-len(self.place) // 8)

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        own = 0
        for b in buckets(word):
            if (i := self.place.get(b)) is not None:
                own |= 1 << i
        self[word] = own
        return own

    def of(self, text: str | None) -> bytes:
        """The buckets of a text, one bit each."""
        return reduce(or_, map(self.__getitem__, words(text)), 0).to_bytes(self.width, "little")

    def matrix(self, rows: list[bytes]) -> np.ndarray:
        """Rows of ``of`` as zeros and ones, a column a bucket."""
        packed = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), self.width)
        return np.unpackbits(packed, axis=1, count=len(self.place), bitorder="little")


@dataclass(frozen=True)
class Model:
    """Weights of hashed features and a bias; ``prior`` is the share of toxic texts it was fitted with."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scorer(self):
        """A function from texts to their scores, 0 to 1; it remembers the features of the words it has met."""
        masks = Masks(self.buckets.tolist())

        def score(texts: list[str | None]) -> np.ndarray:
            out = np.empty(len(texts))
            for at in range(0, len(texts), 1_000):
                on = masks.matrix([masks.of(t) for t in texts[at:at + 1_000]])
                out[at:at + 1_000] = self.bias + (on * self.weights).sum(axis=1)
            return 1 / (1 + np.exp(-np.clip(out, -50.0, 50.0)))

        return score


def scorer_of(models: list[Model]):
    """A function from texts and the numbers of their models to scores; words are remembered once for all models."""
    wanted = np.unique(np.concatenate([m.buckets for m in models]))
    masks = Masks(wanted.tolist())
    places = [np.searchsorted(wanted, m.buckets) for m in models]

    def score(texts: list[str | None], numbers: np.ndarray) -> np.ndarray:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 1_000):
            on = masks.matrix([masks.of(t) for t in texts[at:at + 1_000]])
            for i, (model, place) in enumerate(zip(models, places)):
                own = np.flatnonzero(numbers[at:at + 1_000] == i)
                features = np.ascontiguousarray(on[own][:, place])
                out[at + own] = model.bias + (features * model.weights).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -50.0, 50.0)))

    return score


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: int = FEATURES) -> Model:
    """Fit on lists of feature buckets. Without positives or unlabelled texts every score is ``prior``."""
    def frequency(rows: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), minlength=BUCKETS)

    chosen = telling(frequency(positive), len(positive), frequency(unlabelled), len(unlabelled), features)
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(chosen)), dtype=np.float32)
        for i, row in enumerate(rows):
            own = column[row]
            x[i, own[own >= 0]] = 1
        return x

    return descend(chosen, matrix(positive), matrix(unlabelled), prior)


def telling(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, features: int = FEATURES) -> np.ndarray:
    """The buckets whose document frequency differs most between positive and unlabelled texts, by the z value of the
    log ratio."""
    in_p, in_u = in_p + 0.5, in_u + 0.5
    z = np.log(in_p / (n_p + 1) * (n_u + 1) / in_u) / np.sqrt(1 / in_p + 1 / in_u)
    chosen = np.lexsort((np.arange(BUCKETS), -np.abs(z)))[:features]
    return np.sort(chosen[np.abs(z[chosen]) >= LEAST_Z])


def descend(chosen: np.ndarray, x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05,
            decay: float = 1e-2) -> Model:
    """Minimise the risk over rows of zeros and ones, a column for each of the buckets ``chosen``."""
    prior = float(np.clip(prior, 0.001, 0.5))
    at_rest = float(np.log(prior / (1 - prior)))
    n_p, n_u = len(x_p), len(x_u)
    if not n_p or not n_u:
        return Model(np.empty(0, np.int64), np.empty(0), at_rest, prior)
    theta, bias = np.zeros(len(chosen)), at_rest
    mean, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -50, 50)))
    for step in range(1, steps + 1):
        s_p, s_u = sigmoid(x_p @ theta + bias), sigmoid(x_u @ theta + bias)
        negative = np.mean(-np.log(1 - s_u + 1e-12)) - prior * np.mean(-np.log(1 - s_p + 1e-12))
        # loss gradients by score: (s - 1) as positive, s as negative
        g_negative_p, g_negative_u = -prior * s_p / n_p, s_u / n_u
        if negative >= 0:
            g_p, g_u = prior * (s_p - 1) / n_p + g_negative_p, g_negative_u
        else:  # step back from the negative risk until it is zero again
            g_p, g_u = -g_negative_p, -g_negative_u
        gradient = np.append(x_p.T @ g_p + x_u.T @ g_u + decay * prior * theta, g_p.sum() + g_u.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    return Model(chosen, theta, float(bias), prior)


def _known(labels: DataFrame, usable: Column, key: str, label: str) -> DataFrame:
    return (labels.filter(usable & F.col(key).isNotNull() & F.col(label).isNotNull())
            .groupBy(key).agg(F.max(F.col(label).cast("int")).alias("toxic_label")))


def _fold(key: str, folds: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fold")), F.lit(max(folds, 1))).cast("int")


def _drawn(docs: DataFrame, known: DataFrame, usable: Column, key: str, text: str, positives: int, unlabelled: int,
           folds: int) -> DataFrame:
    """(text, positive, fold): the samples, each different text once; written, so that it is read twice."""
    draw = F.xxhash64(F.col(key).cast("string"))
    toxic = known.filter(F.col("toxic_label") == 1).select(key).orderBy(draw, key).limit(positives)
    ids = docs.select(key).filter(usable & F.col(key).isNotNull()).distinct().orderBy(draw, key).limit(unlabelled)
    both = toxic.withColumn("positive", F.lit(True)).unionByName(ids.withColumn("positive", F.lit(False)))
    # the samples are bounded by the parameters, so their texts may be looked up by broadcast
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(both), key)
    return stored(rows.select("text", "positive", _fold(key, folds).alias("fold")).dropDuplicates(), "toxicity-sample")


def _frequencies(sample: DataFrame) -> dict[tuple[bool, int], tuple[int, np.ndarray]]:
    """(texts, texts with each bucket) by (positive, fold); one array of ``BUCKETS`` counts each reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, rows, total = Features(), {}, {}
        for batch in batches:
            for t, *group in zip(batch["text"], batch["positive"], batch["fold"]):
                group = tuple(group)
                if group not in total:
                    rows[group], total[group] = 0, np.zeros(BUCKETS, dtype=np.int32)
                rows[group] += 1
                total[group][list(features.of(t))] += 1
        yield pd.DataFrame([(p, f, n, total[p, f].tobytes()) for (p, f), n in rows.items()],
                           columns=["positive", "fold", "rows", "counts"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.int32) for c in parts["counts"])
        return parts.iloc[:1].assign(rows=parts["rows"].sum(), counts=[total.tobytes()])

    kind = "positive boolean, fold int, rows long, counts binary"
    parts = sample.mapInPandas(count, kind).groupBy("positive", "fold").applyInPandas(add, kind)
    return {(r["positive"], r["fold"]): (r["rows"], np.frombuffer(r["counts"], dtype=np.int32)) for r in parts.collect()}


def train_folds(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text",
                label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED,
                folds: int = 0) -> list[Model]:
    """The model of all sampled rows, then one without each of the ``folds`` parts of them.

    The samples are drawn once, with two scans of ``docs`` however many models. Features are chosen from counts of the
    tasks; the driver gets those counts and, for each sampled text, one bit for each feature that some model uses.
    """
    known = _known(labels, usable, key, label)
    counts = {r["fold"]: (r["n"], r["p"]) for r in known.groupBy(_fold(key, folds).alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic_label").alias("p")).collect()}
    sample = _drawn(docs, known, usable, key, text, positives, unlabelled, folds)
    seen = _frequencies(sample)
    left_out = [None, *range(folds)]

    def summed(positive: bool, out: int | None) -> tuple[int, np.ndarray]:
        own = [v for (p, f), v in seen.items() if p == positive and f != out]
        return sum(n for n, _ in own), sum((c for _, c in own), np.zeros(BUCKETS, dtype=np.int64))

    chosen = []
    for out in left_out:
        (n_p, in_p), (n_u, in_u) = summed(True, out), summed(False, out)
        chosen.append(telling(in_p, n_p, in_u, n_u))
    wanted = np.unique(np.concatenate(chosen))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = Masks(wanted.tolist())
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "fold": batch["fold"],
                                "bits": [masks.of(t) for t in batch["text"]]})

    rows = sorted(tuple(r) for r in sample.mapInPandas(describe, "positive boolean, fold int, bits binary").collect())
    on = Masks(wanted.tolist()).matrix([bytes(bits) for _, _, bits in rows])
    positive, fold = np.array([r[0] for r in rows], dtype=bool), np.array([r[1] for r in rows], dtype=np.int64)
    models = []
    for out, own in zip(left_out, chosen):
        x = on[:, np.searchsorted(wanted, own)].astype(np.float32)
        n, p = (sum(v[i] for f, v in counts.items() if f != out) for i in (0, 1))
        kept = fold != (-1 if out is None else out)
        models.append(descend(own, x[kept & positive], x[kept & ~positive], p / n if n and p < n else PRIOR))
    return models


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text",
          label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on rows where ``usable`` (an expression over ``key``) holds, at most ``positives`` toxic and ``unlabelled`` of all.

    A document with several labels is toxic if one says so; null labels and keys are ignored. The prior is the share
    of toxic documents among the labelled ones, ``PRIOR`` without negative labels. The unlabelled texts are drawn from
    all documents, whatever their label: the risk estimator takes the positives' share out of them.
    """
    return train_folds(docs, labels, usable, key, text, label, positives, unlabelled)[0]


def train_and_cut(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text",
                  label: str = "toxic", precision: float = PRECISION, folds: int = FOLDS) -> tuple[Model, float]:
    """The model and the lowest score, ``THRESHOLD`` at least, from which ``precision`` of the labelled rows are toxic.

    For the cut every labelled row where ``usable`` holds is scored by a model fitted without its part of the rows;
    held-out rows are not read. A precision of p can be told from 1 / (1 - p) rows or more: where no cut reaches it on
    that many rows the cut is infinite, so nothing is rejected whose rejection the labels cannot justify.
    """
    model, *others = train_folds(docs, labels, usable, key, text, label, folds=folds)
    fold = _fold(key, folds)

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of = scorer_of(others)
        for texts, numbers in batches:
            yield pd.Series(of(texts.tolist(), numbers.to_numpy()), dtype="float64")

    rows = docs.select(key, text).join(_known(labels, usable, key, label), key)
    rows = rows.select(scored(F.col(text), fold).alias("score"), "toxic_label").filter(F.col("score") >= THRESHOLD)
    # one count for each step of the score
    counts = rows.groupBy(F.floor(F.col("score") * CUT_STEPS).cast("int").alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic_label").alias("toxic")).collect()
    cut, n, toxic = math.inf, 0, 0
    for row in sorted(counts, reverse=True):
        n, toxic = n + row["n"], toxic + row["toxic"]
        if n >= 1 / (1 - precision) and toxic >= precision * n:
            cut = max(row["step"] / CUT_STEPS, THRESHOLD)
    return model, cut


def score(model: Model):
    """A Column function from texts to scores; null and empty texts get the score of a text without known words."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for batch in batches:
            yield pd.Series(of(batch.tolist()), dtype="float64")

    return scored
