"""A substring index: which rows may hold a text, by the triples of characters in it.

Rows are stored in blocks, beside postings (triple, ids, number of blocks) sorted by triple, so that a look-up reads the
row groups of its triples and the blocks of its candidates, not the table. A posting lists the rows of one batch that
hold the triple, so that sorting moves few rows. An id is a hash of the indexed texts: rows with equal
texts share it, and a collision only makes one more candidate, as every candidate row is compared with the text itself.
A delivery appends rows and postings; nothing is rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators import selection

#: Rows of a block, on average.
ROWS_A_BLOCK = 10_000
#: Characters of a gram; shorter texts are looked for in the rows themselves.
GRAM = 3
_ID, _BLOCK = "_text_id", "_block"
_META = "columns array<string>, rows_a_block long"
_POSTINGS = "gram string, ids array<long>, blocks long"


def grams_of(text: str) -> list[str]:
    """The triples of the text looked for."""
    text = text.lower()
    return sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})


def build(df: DataFrame, home: str, columns: list[str] | None = None, rows_a_block: int = ROWS_A_BLOCK) -> None:
    """Store ``df`` with an index of ``columns``, all text columns by default, in a new folder ``home``."""
    columns = columns or [f.name for f in df.schema if f.dataType.typeName() == "string"]
    df.sparkSession.createDataFrame([(columns, rows_a_block)], _META).write.json(f"{home}/meta")
    _write(df, home, columns, rows_a_block)


def add(df: DataFrame, home: str) -> None:
    """Store and index a further delivery with the columns of the first."""
    _write(df, home, *_meta(df.sparkSession, home))


def _meta(spark: SparkSession, home: str) -> tuple[list[str], int]:
    row = spark.read.schema(_META).json(f"{home}/meta").head()
    return list(row["columns"]), row["rows_a_block"]


def _write(df: DataFrame, home: str, columns: list[str], rows_a_block: int) -> None:
    """Rows dealt to blocks by their id; a block that equal texts make large is split by adaptive execution."""
    blocks = max(-(-df.count() // rows_a_block), 1)
    lowered = [F.lower(F.col(f"`{c}`")) for c in columns]
    told_apart = [x for c in lowered for x in (F.coalesce(c, F.lit("")), c.isNull())]
    rows = df.withColumn(_ID, F.xxhash64(*told_apart)).withColumn(_BLOCK, F.pmod(F.col(_ID), F.lit(blocks)))
    rows.hint("rebalance", _BLOCK).sortWithinPartitions(_BLOCK, _ID).write.mode("append").partitionBy(_BLOCK).parquet(
        f"{home}/rows")
    texts = rows.select(_ID, F.array(*lowered).alias("texts"))
    # few rows are sorted; a triple that every text holds makes a large partition, which adaptive execution splits
    postings = texts.mapInArrow(_postings, "gram string, ids array<long>").withColumn("blocks", F.lit(blocks).cast("long"))
    postings.hint("rebalance", "gram").sortWithinPartitions("gram").write.mode("append").parquet(f"{home}/postings")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per triple of a batch, with the ids of the rows that hold it."""
    for batch in batches:
        keys, owners = [], []
        for at, texts in enumerate(batch.column("texts").to_pylist()):
            own = [_keys(t) for t in texts if t is not None and len(t) >= GRAM]
            if own:
                keys.append(np.unique(np.concatenate(own)))
                owners.append(np.full(len(keys[-1]), at, dtype=np.int32))
        if not keys:
            continue
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        found, starts = np.unique(keys[order], return_index=True)
        ids = batch.column(_ID).to_numpy(zero_copy_only=False)[owners[order]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([_gram(k) for k in found.tolist()], pa.string()),
             pa.ListArray.from_arrays(pa.array([*starts.tolist(), len(ids)], pa.int32()), pa.array(ids, pa.int64()))],
            names=["gram", "ids"])


def _keys(text: str) -> np.ndarray:
    """The triples of a text as numbers of three times 21 bits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def _gram(key: int) -> str:
    return chr(key >> 42) + chr(key >> 21 & 0x1FFFFF) + chr(key & 0x1FFFFF)


def candidates(spark: SparkSession, home: str, text: str) -> DataFrame:
    """(id, block) of the rows in which every triple of ``text`` occurs, in one column or another."""
    wanted = grams_of(text)
    postings = spark.read.schema(_POSTINGS).parquet(f"{home}/postings").filter(F.col("gram").isin(wanted))
    found = postings.select("gram", "blocks", F.explode("ids").alias(_ID)).select(
        "gram", _ID, F.pmod(_ID, "blocks").alias("block"))
    # deliveries may hold one text twice, in blocks of their own
    return found.distinct().groupBy(_ID, F.col("block").alias(_BLOCK)).agg(F.count("*").alias("n")).filter(
        F.col("n") == len(wanted)).drop("n")


def search(spark: SparkSession, home: str, text: str, status: str | None = None, status_column: str = "status") -> DataFrame:
    """The rows ``selection.search`` finds in the stored table, found through the index.

    The driver sees the numbers of the blocks that hold a candidate, one a block; the scan leaves out all others. A text
    of less than three characters has no triple and is looked for in all rows.
    """
    columns, _ = _meta(spark, home)
    rows = spark.read.parquet(f"{home}/rows")
    if len(text.lower()) >= GRAM:
        some = candidates(spark, home, text).persist()
        try:
            blocks = [r[0] for r in some.select(_BLOCK).distinct().collect()]
            rows = rows.filter(F.col(_BLOCK).isin(blocks)) if blocks else rows.limit(0)
        finally:
            some.unpersist()
        rows = rows.join(some, [_ID, _BLOCK], "left_semi")
    return selection.search(rows, text, columns, status, status_column).drop(_ID, _BLOCK)
