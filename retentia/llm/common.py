"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retentia.session import scratch_path, shared_root

#: Rows one window task ranks at a time; larger groups are dealt over several slices.
SLICE_ROWS = 50_000
#: Bytes of a batch of rows for Python workers while intermediate tables are written.
BATCH_BYTES = 4 << 20
#: Longer words are hashed one by one.
LONG = 64
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """From now on Python workers of the session get batches of ``BATCH_BYTES``, whoever writes a result."""
    spark.conf.set(_BATCH, BATCH_BYTES)


@contextmanager
def small_batches(spark: SparkSession):
    """Python workers of the jobs started inside get batches of ``BATCH_BYTES``."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before) if before is not None else spark.conf.unset(_BATCH)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, so a lost executor costs a read.

    The files stay until ``release`` or until whoever owns the folder clears it. While they are written, Python workers get
    batches of ``BATCH_BYTES``, so that long texts do not add up in their memory.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    with small_batches(spark):
        df.write.parquet(path)
    kept(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


_PATHS: list[str] = []
_STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def kept(path: str) -> None:
    """Leave ``path`` to ``release``."""
    _PATHS.append(path)


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what ``stored`` has written, or only ``frames`` of it; results that still depend on it must have been written
    by then."""
    _delete(spark, [_STORED[frame] for frame in frames] if frames else list(_PATHS))


@contextmanager
def passing(spark: SparkSession):
    """Deletes in the end what was stored inside; results that leave it must be checkpointed."""
    before = set(_PATHS)
    try:
        yield
    finally:
        _delete(spark, [path for path in _PATHS if path not in before])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if path not in _PATHS:
            continue
        _PATHS.remove(path)
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a narrow or small frame; the context cleaner may remove its files."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _letters() -> np.ndarray:
    """A 64-bit number for every byte at every place of a word, and 0 for the blank after it."""
    x = np.arange(1, (LONG + 1) * 256 + 1, dtype=np.uint64) * _K[0]
    for k in _K[1:]:
        x = (x ^ (x >> np.uint64(31))) * k
    x ^= x >> np.uint64(32)
    x[ord(" ")::256] = 0
    return x


_LETTERS = _letters()


def word_hashes(own: list[bytes]) -> np.ndarray:
    """64-bit hashes of words without blanks: the sum of their bytes' numbers, all words at once."""
    if not own:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(own)
    if len(joined) > LONG * len(own):  # of long words only that they are long
        joined = b" ".join([w[:LONG + 2] for w in own])
    text = np.frombuffer(joined, dtype=np.uint8)
    blanks = np.flatnonzero(text == ord(" "))
    starts = np.concatenate([[0], blanks + 1])
    lengths = np.diff(starts, append=len(text) + 1)
    place = np.arange(len(text)) - np.repeat(starts, lengths)[:len(text)]
    out = np.add.reduceat(_LETTERS.take((place << 8) + text, mode="clip"), starts)  # clipped: only in long words
    for i in np.flatnonzero(lengths > LONG + 1):
        out[i] = xxhash.xxh3_64_intdigest(own[i])
    return out


def name_beside(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores in front, such that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, key: list[str], tie: list[Column], out: str, total: str,
           slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``out``, the row's 0-based place among the rows of equal ``key``, and ``total``, their number.

    The order is by slice, then by a hash of ``tie``, then ``tie``. All rows are dealt over hash slices, as many as
    bring a slice to about ``slice_rows`` rows if one key had all of them: rows are ranked inside their slice of
    their key and moved up by the rows of the slices before, so no key meets in one task, however hot, and the rows
    are shuffled once. Key columns must not be null. Rows equal in all of ``tie`` share a slice and get their places in
    any order.
    """
    piece, hashed, ahead = (name_beside(df, n) for n in ("slice", "tie_hash", "ahead"))
    slices = df.count() // slice_rows + 1
    rows = df.withColumn(hashed, F.xxhash64(*tie)).withColumn(
        piece, F.pmod(F.shiftright(hashed, 8), F.lit(slices)).cast("int"))
    of_key = Window.partitionBy(*key)
    before = of_key.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*key, piece).agg(F.count(F.lit(1)).alias(ahead)).select(
        *key, piece, F.coalesce(F.sum(ahead).over(before), F.lit(0)).alias(ahead), F.sum(ahead).over(of_key).alias(total))
    inside = Window.partitionBy(*key, piece).orderBy(hashed, *tie)
    return (rows.withColumn(out, F.row_number().over(inside) - 1).join(offsets, [*key, piece])
            .withColumn(out, F.col(ahead) + F.col(out)).drop(piece, hashed, ahead))
