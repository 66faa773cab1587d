"""Lookup joins that hold when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join of a large table with a lookup side; nothing runs while the plan is built.

    Spark measures the bytes of both sides when it runs: a lookup side below the broadcast threshold is broadcast,
    otherwise both sides are shuffled and every skewed partition of the large side, null keys included, is split
    over several tasks, each with its copy of the lookup rows of that partition (adaptive execution). The allowed
    join types are those in which the large side may be split.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} would see the copies of the lookup side")
    return big.join(small, on, how)
