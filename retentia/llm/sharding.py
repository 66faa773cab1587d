"""Shards as runs of a Hilbert curve through several metadata dimensions.

Each dimension is quantised to ``2 ** bits`` cells, every row gets the index of its cell on the curve, and the rows
in curve order are cut into shards whose row counts differ by one at most. Rows close in all dimensions lie close on
the curve, so each shard covers a small box and a predicate on any dimension skips most files. DataFrame operations
only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import name_beside, ranked

BITS = 5
LAW = "rows"


@dataclass(frozen=True)
class Dimension:
    """A column expression to shard by; ``kind`` is ``linear``, ``log`` (sizes) or ``category`` (hashed values)."""

    name: str
    value: Column
    kind: str = "linear"


def document_dimensions(prefix: str = "") -> list[Dimension]:
    """Source, language, size and id of documents; ``prefix`` names a struct that holds them."""
    source, lang, text, key = (F.col(prefix + c) for c in ("source", "lang", "text", "doc_id"))
    return [Dimension("source", source, "category"), Dimension("lang", lang, "category"),
            Dimension("size", F.octet_length(F.coalesce(text, F.lit(""))) + 1, "log"), Dimension("doc_id", key)]


def _rotate(x: int, by: int, n: int) -> int:
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


def curve_automaton(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each (state, cell) of the n-dimensional curve, flattened.

    A state is the entry corner and the direction of a sub-cube; both follow from Gray codes.
    """
    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def entry(i: int) -> int:
        return gray(2 * ((i - 1) // 2)) if i else 0

    def direction(i: int) -> int:
        odd = i - 1 if i % 2 == 0 else i
        return (((odd + 1) & -(odd + 1)).bit_length() - 1) % n if i else 0

    place = {gray(i): i for i in range(1 << n)}
    digits, states = [], []
    for corner in range(1 << n):
        for along in range(n):
            for cell in range(1 << n):
                digit = place[_rotate(cell ^ corner, n - (along + 1) % n, n)]
                digits.append(digit)
                states.append((corner ^ _rotate(entry(digit), along + 1, n)) * n
                              + (along + direction(digit) + 1) % n)
    return digits, states


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Index on the curve of a cell given by one integer of ``bits`` bits for each dimension."""
    n = len(cells)
    digits, states = (F.split(F.lit(",".join(map(str, t))), ",").cast("array<int>") for t in curve_automaton(n))

    def step(at: Column, level: Column) -> Column:
        return F.struct(
            (at["index"] * (1 << n) + F.get(digits, at["state"] * (1 << n) + level)).alias("index"),
            F.get(states, at["state"] * (1 << n) + level).alias("state"))

    levels = F.array(*[
        sum((F.shiftright(c, bit).bitwiseAND(1) * (1 << j) for j, c in enumerate(cells)), F.lit(0)).cast("int")
        for bit in reversed(range(bits))])
    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(levels, start, step)["index"]


def quantised(df: DataFrame, dimensions: Sequence[Dimension], bits: int) -> list[Column]:
    """A cell column for each dimension; one pass over the table takes the bounds of the numeric ones.

    Linear and log dimensions are cut into equal widths between their least and largest value; nulls and NaN go to
    cell 0. Categories go to a cell by hash, so equal values share a cell.
    """
    top = (1 << bits) - 1
    numeric = {}
    for d in dimensions:
        if d.kind != "category":
            x = F.nanvl(d.value.cast("double"), F.lit(None).cast("double"))
            numeric[d.name] = F.log2(F.greatest(x, F.lit(1.0))) if d.kind == "log" else x
    bounds = df.select(*[f(x).alias(f"{name}:{f.__name__}") for name, x in numeric.items() for f in (F.min, F.max)]
                       ).first() if numeric else {}
    cells = []
    for d in dimensions:
        if d.kind == "category":
            cells.append(F.pmod(F.xxhash64(F.coalesce(d.value.cast("string"), F.lit(""))), F.lit(top + 1)).cast("int"))
            continue
        low, high = bounds[f"{d.name}:min"], bounds[f"{d.name}:max"]
        if low is None or not low < high or high - low == float("inf"):
            cells.append(F.lit(0))
        else:
            part = F.floor((numeric[d.name] - F.lit(low)) / F.lit(high - low) * (top + 1))
            cells.append(F.coalesce(F.least(part, F.lit(top)), F.lit(0)).cast("int"))
    return cells


def hilbert_shards(df: DataFrame, dimensions: Sequence[Dimension], tie: list[Column], shards: int = 16,
                   bits: int = BITS) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1), ``slot`` (gapless from 0 inside a shard) and ``curve`` (Hilbert index).

    Law ``rows``: shard counts differ by one at most, for any skew. A hot cell is cut by a hash of ``tie``, which
    should tell rows apart. Null values take part as cell 0; an empty table gives an empty result. Columns of ``df``
    with one of the added names are replaced.
    """
    df = df.drop("shard", "slot", "curve")
    cell, coarse, place, total, first = (name_beside(df, n) for n in ("cell", "coarse", "place", "cell_rows", "first"))
    rows = df.withColumn(cell, hilbert_index(quantised(df, dimensions, bits), bits))
    # cells are at most 2 ** (bits * dimensions): their running count has two levels of at most the square root
    half = bits * len(dimensions) // 2
    counts = rows.groupBy(cell).agg(F.count(F.lit(1)).alias(total)).withColumn(coarse, F.shiftright(cell, half))
    tops = counts.groupBy(coarse).agg(F.sum(total).alias(place))
    n = df.count()
    running = Window.orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn(place, F.coalesce(F.sum(place).over(running), F.lit(0)))
    inner = Window.partitionBy(coarse).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = (counts.withColumn(first, F.coalesce(F.sum(total).over(inner), F.lit(0))).join(tops, coarse)
              .select(cell, (F.col(first) + F.col(place)).alias(first)))
    at = ranked(rows, [cell], tie, place, total).join(starts, cell).withColumn(place, F.col(place) + F.col(first))
    return (at.withColumn("shard", F.expr(f"cast(`{place}` * {shards} div {max(n, 1)} as int)"))
            .withColumn("slot", F.expr(f"`{place}` - (shard * {n}L + {shards - 1}) div {shards}"))
            .withColumn("curve", F.col(cell)).drop(cell, place, total, first))


def manifest(sharded: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """One row per shard: rows and the least and largest value of every dimension, for file pruning."""
    bounds = [f(d.value).alias(f"{d.name}_{f.__name__}") for d in dimensions for f in (F.min, F.max)]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *bounds)


def prune(shards: DataFrame, **ranges: tuple) -> DataFrame:
    """Rows of ``manifest`` that may hold a match: every named dimension meets its (low, high)."""
    for name, (low, high) in ranges.items():
        shards = shards.filter((F.col(f"{name}_max") >= F.lit(low)) & (F.col(f"{name}_min") <= F.lit(high)))
    return shards


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order, so files and row groups cover small boxes."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
