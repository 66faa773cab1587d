"""Mixing sources to target weights by Pfair scheduling.

Every source is a stream of equal blocks. With the exact normalised weight w, its block i may start at ``floor(i / w)``
and is due at ``ceil((i + 1) / w)``; among the blocks that may start, the earliest deadline goes first. The weights fill
every slot exactly, so every block meets its window and after any number of slots each source is less than one block
away from its target, however small its weight and however long the mix. Weights are whole numbers of a common unit, so
nothing is rounded. Earliest deadline first is sequential: the driver walks the slots, one step a block (not a row),
with memory for the sources and one chunk of slots; everything that touches rows is DataFrame operations.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm.common import kept, name_beside, ranked
from retentia.session import scratch_path

#: Slots in which ``share`` is stated; sources below one slot show the stream ''. The schedule does not depend on it.
CYCLE = 500
#: Rows of a block.
BLOCK = 16
#: Default target weight of a source: its number of rows to this power.
TEMPERATURE = 0.7
#: Slots the driver holds at a time.
CHUNK_SLOTS = 250_000


def earliest_deadline_first(weights: list[float], blocks: list[int]) -> Iterator[tuple[int, int]]:
    """(source, call) of slot 0, 1, ...: positions in the lists and how often the source was called before.

    Weights are positive and taken exactly. Ends when every source has been called ``blocks`` times (at least 1).
    """
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(w.denominator for w in exact)) if exact else 1
    sizes = [w.numerator * (unit // w.denominator) for w in exact]
    total, left = sum(sizes), len(sizes)
    done = [0] * left
    ready = [(-(-total // n), j) for j, n in enumerate(sizes)]
    heapq.heapify(ready)
    waiting: list[tuple[int, int]] = []
    now = 0
    while left:
        while waiting and waiting[0][0] <= now:
            j = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[j] + 1) * total // sizes[j]), j))
        j = heapq.heappop(ready)[1]  # the weights fill every slot, so some block may always start
        yield j, done[j]
        done[j] += 1
        left -= done[j] == blocks[j]
        heapq.heappush(waiting, (done[j] * total // sizes[j], j))
        now += 1


def _schedule(spark: SparkSession, sources: list, key: str, block: str) -> DataFrame:
    """(``key``, ``block``, epoch, slot): what each slot of the mix holds, from rows (source, weight, blocks).

    Kept as Parquet in the shared folder and written in chunks.
    """
    path = scratch_path(spark, "llm-mix")
    schema = f"`{key}` string, `{block}` long, epoch long, slot long"
    names, blocks = [r["source"] for r in sources], [r["blocks"] for r in sources]
    chunk: list[tuple] = []

    def write() -> None:
        frame = pd.DataFrame(chunk, columns=[key, block, "epoch", "slot"])
        spark.createDataFrame(frame, schema).write.mode("append").parquet(path)
        chunk.clear()

    for slot, (j, call) in enumerate(earliest_deadline_first([r["weight"] for r in sources], blocks)):
        chunk.append((names[j], call % blocks[j], call // blocks[j], slot))
        if len(chunk) == CHUNK_SLOTS:
            write()
    if chunk or not sources:
        write()
    kept(path)
    return spark.read.schema(schema).parquet(path)


def tempered_weights(df: DataFrame, source: Column, power: float = TEMPERATURE) -> DataFrame:
    """(source, weight) with weight the number of rows to ``power``; a null source counts as ''."""
    return (df.groupBy(F.coalesce(source.cast("string"), F.lit("")).alias("source"))
            .agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("weight")))


def pfair_mix(df: DataFrame, source: Column, tie: list[Column], weights: DataFrame | None = None,
              cycle: int = CYCLE, block: int = BLOCK) -> DataFrame:
    """Rows of ``df`` in mixing order: adds ``stream``, ``share``, ``cycle``, ``block``, ``epoch``, ``slot``, ``position``.

    ``weights`` has (source, weight), weights of one source add up; a source without a positive weight takes no part,
    and by default every source has its ``tempered_weights``. Targets are the weights over their sum for the sources
    that have rows. The mix ends when each source has given all its blocks once; until then sources that run out start
    again (``epoch`` counts from 0), so no document is dropped and each prefix of slots keeps the weights to less than
    one block. Inside a source the order is by a hash of ``tie``. The last block of a source may be short. ``share`` is
    the source's target in slots of ``cycle``, not rounded; ``stream`` names the source, or is '' for sources below one
    slot, which are scheduled like the others. An empty table gives an empty result; columns of ``df`` with one of the
    added names are replaced.
    """
    added = ["stream", "share", "cycle", "block", "epoch", "slot", "position"]
    df = df.drop(*added)
    key, place, rows = (name_beside(df, n) for n in ("mix_source", "place", "rows"))
    weights = tempered_weights(df, source) if weights is None else weights
    weights = (weights.filter((F.col("weight") > 0) & (F.col("weight") < float("inf")))
               .groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
               .agg(F.sum(F.col("weight").cast("double")).alias("weight")))
    keyed = df.withColumn(key, F.coalesce(source.cast("string"), F.lit("")))
    counts = keyed.groupBy(F.col(key).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    # one row a source
    sources = counts.join(weights, "source").select(
        "source", "weight", F.expr(f"(n + {block - 1}) div {block}").alias("blocks")).orderBy("source").collect()
    total = math.fsum(r["weight"] for r in sources) or 1.0
    slots = _schedule(df.sparkSession, sources, key, "block")

    # each block of a source meets one slot an epoch
    dealt = ranked(keyed, [key], tie, place, rows).withColumn("block", F.expr(f"`{place}` div {block}"))
    share = F.col("weight") * cycle / F.lit(total)
    shares = weights.select(F.col("source").alias(key), share.alias("share"), F.when(
        share >= 1, F.concat(F.lit("s:"), "source")).otherwise(F.lit("")).alias("stream"))
    return (dealt.join(shares, key).join(slots, [key, "block"])
            .withColumn("cycle", F.lit(cycle).cast("long"))
            .withColumn("position", F.expr(f"slot * {block} + `{place}` % {block}"))
            .drop(key, place, rows))


def in_mixing_order(mixed: DataFrame) -> DataFrame:
    """Dealt over tasks by position, sorted: written files follow the mix."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")
