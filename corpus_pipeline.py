"""From raw documents to sharded training data: each stage is one operator of ``retentia.llm``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import decontamination, jaccard, mixing, sharding, toxicity
from retentia.llm.common import bound_batches, name_beside, stored, table
from retentia.llm.queries import may_train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the score from which 95 % are toxic by cross-fitted training labels; texts without words score
    as clean. Where the labels are too few to show that precision, all documents stay."""
    bound_batches(spark)  # the texts of a batch are held several times by each worker
    model, cut = toxicity.train_and_cut(docs, table(spark, sf_dir, "labels"), may_train("doc_id"))
    score = name_beside(docs, "score")
    return docs.withColumn(score, toxicity.score(model)("text")).filter(F.col(score) < cut).drop(score)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, "doc_id", "text", size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    bound_batches(spark)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def as_one_column(docs: DataFrame) -> DataFrame:
    """All columns in the struct ``document``, so that no name of theirs meets one that an operator adds."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))


def tie() -> list[Column]:
    """Tells documents apart, those without an id by their text."""
    return [F.col("document.doc_id"), F.xxhash64("document.text")]


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, sources below their target weight repeated, rows in mixing order."""
    mixed = stored(mixing.pfair_mix(as_one_column(docs), F.col("document.source"), tie()), "mixed")
    return mixing.in_mixing_order(mixed).select("document.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ``shard`` and ``slot`` they are written to and their place ``curve`` on the curve; beside
    an input column of such a name the added one gets an underscore in front."""
    added = {c: name_beside(docs, c) for c in ("shard", "slot", "curve")}
    out = sharding.hilbert_shards(as_one_column(docs), sharding.document_dimensions("document."), tie())
    return out.select("document.*", *(F.col(c).alias(name) for c, name in added.items()))


STAGES = [("toxicity", drop_toxic), ("near_copies", one_of_near_copies), ("decontamination", without_benchmark),
          ("mix", mix), ("shard", shard)]

#: Several stages cannot be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
