"""Datasets that grow by deliveries, without exact duplicates and without reading what they hold.

Every stored row has a fingerprint of 128 bits, kept beside the rows in a table of its own, and sets two bits in a
Bloom filter stored by words of 64 bits. A delivery is made distinct by itself; its rows look their word up, and only
those whose bits are set meet the fingerprints. The rows of earlier deliveries are neither read nor shuffled, and what
is written is what is new.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators import merge
from retentia.operators.quality import header_fingerprint
from retentia.session import checkpointed
from retentia.sources.tables import read_log

#: Rows of a delivery that share a word of its filter, on average: two bits each of 64.
ROWS_A_WORD = 8
_PRINTS = ["_print_a", "_print_b"]
_LOG = "version int, name string, part string, words long"


def fingerprint(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a row as text; nulls, empty texts and the places of the values count."""
    cells = [x for c in df.columns for x in (F.coalesce(_text(df, c), F.lit("")), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(F.lit(seed), *cells).alias(name) for seed, name in zip((1, 2), _PRINTS)]


def _text(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType.typeName()
    if kind in ("double", "float"):  # 0 and -0 are one value
        return (c + F.lit(0.0)).cast("string")
    return F.to_json(F.struct(c)) if kind in ("array", "struct") else c.cast("string")


def _word(words: Column) -> Column:
    return F.pmod(F.col(_PRINTS[0]), words)


def _bits() -> Column:
    """The two bits of a fingerprint, as a 64-bit word."""
    at = (F.shiftright(F.col(_PRINTS[1]), n).bitwiseAND(63).cast("int") for n in (0, 6))
    first, second = (F.call_function("shiftleft", F.lit(1).cast("long"), x) for x in at)
    return first.bitwiseOR(second)


def store(new: DataFrame, home: str) -> str:
    """Add the rows of a delivery that the dataset at ``home`` does not hold; returns the name of the new version.

    The first delivery is kept as it came, with its repeated rows; from the second on the dataset has each row once.
    """
    spark = new.sparkSession
    log = read_log(spark, f"{home}/versions", _LOG)
    old = [] if log is None else sorted(log.collect())  # one line a delivery
    rows = new.groupBy(*[F.col(f"`{c}`") for c in new.columns]).agg(F.count("*").alias("_times"))
    rows = checkpointed(rows.select("*", *fingerprint(new)))
    maybe = None
    for r in old:
        filters = spark.read.parquet(f"{home}/filter/{r['part']}")
        hit = rows.withColumn("_word", _word(F.lit(r["words"]))).join(filters, "_word").filter(
            F.col("_set").bitwiseAND(_bits()) == _bits()).select(*_PRINTS)
        known = spark.read.parquet(f"{home}/prints/{r['part']}").join(hit, _PRINTS, "left_semi")
        maybe = known if maybe is None else maybe.union(known)
    fresh = rows if maybe is None else checkpointed(rows.join(maybe, _PRINTS, "left_anti"))
    number, part = len(old) + 1, uuid.uuid4().hex
    name = f"{'merged_dataset' if old else 'dataset'}_{number}"
    words = max(fresh.count() // ROWS_A_WORD, 1)
    fresh.drop(*_PRINTS).write.parquet(f"{home}/rows/{part}")
    fresh.select(*_PRINTS).write.parquet(f"{home}/prints/{part}")
    fresh.groupBy(_word(F.lit(words)).alias("_word")).agg(F.bit_or(_bits()).alias("_set")).write.parquet(f"{home}/filter/{part}")
    spark.createDataFrame([(number, name, part, words)], _LOG).write.mode("append").json(f"{home}/versions")
    return name


def read(spark: SparkSession, home: str) -> DataFrame | None:
    """The dataset at ``home``, or None before the first delivery."""
    log = read_log(spark, f"{home}/versions", _LOG)
    if log is None:
        return None
    parts = [spark.read.parquet(f"{home}/rows/{r['part']}") for r in sorted(log.collect())]
    if len(parts) == 1:
        return parts[0].withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_copy", "_times")
    return merge.union_all(*parts).drop("_times")


def home_of(df: DataFrame, root: str) -> str:
    """Deliveries with one header share a folder."""
    return f"{root}/{header_fingerprint(df)}"
