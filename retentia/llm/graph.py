"""Connected components of links between ids, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import checkpointed


def connected(links: DataFrame) -> DataFrame:
    """(id, label) for every id of ``links`` (a, b); label is the smallest id reachable. Nulls are left out.

    Each round takes the smallest label of the neighbours, then follows labels once (pointer jumping), so a chain
    halves per round; labels and links stay distributed.
    """
    links = links.filter(F.col("a") != F.col("b"))
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    labels = checkpointed(labels)
    while True:
        seen = (both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near")))
        lower = (labels.join(seen, F.col("id") == F.col("a"), "left")
                 .select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("low")))
        jump = lower.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        moved = checkpointed(lower.join(jump, "low", "left").select(
            "id", "old", F.least("low", F.coalesce("lower", "low")).alias("label")))
        changed = not moved.filter(F.col("old") != F.col("label")).isEmpty()
        labels = moved.select("id", "label")
        if not changed:
            return labels
