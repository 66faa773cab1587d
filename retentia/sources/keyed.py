"""Keyed tables that merge on read.

A table is a base, dealt into buckets by a hash of the key, and numbered changes. A change holds the whole new row of
every key it touches, or a mark that the key is gone, dealt into the same buckets, so a change to one row in a hundred
writes one row in a hundred. A reader takes the base rows whose key no later change names, and the latest change of the
others. ``compact`` writes those buckets anew whose changes have grown, and leaves the files of all others in place.

A log of JSON lines says which folder holds which buckets of the base and which changes came after; it is appended to
last, so a job that dies half-way leaves the table as it was. One writer at a time. Nothing is overwritten: every number
in the log can be read as the table it was then.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.operators import merge
from retentia.sources.tables import read_log

BUCKETS = 64
#: Share of changed rows from which ``compact`` writes a bucket anew.
GROWN = 0.1
_BUCKET, _GONE, _NUMBER = "_bucket", "_gone", "_number"
_LOG = "number int, kind string, path string, key string, buckets array<int>, count int, fields string"


@dataclass(frozen=True)
class KeyedTable:
    """The table below ``root``; ``key`` is unique and not null, of ``count`` buckets."""

    spark: SparkSession
    root: str
    key: str
    count: int

    def _entries(self, number: int | None = None) -> list:
        log = read_log(self.spark, f"{self.root}/log", _LOG)
        rows = log.collect() if log is not None else []  # one line an operation
        return sorted((r for r in rows if number is None or r["number"] <= number), key=lambda r: r["number"])

    def _place(self, df: DataFrame) -> DataFrame:
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.count)).cast("int"))

    def _write(self, rows: DataFrame, kind: str, buckets: list[int] | None = None) -> int:
        """Write rows, one file a bucket, then tell the log."""
        entries = self._entries()
        number = max((r["number"] for r in entries), default=0) + 1
        path = f"{kind}_{number}"
        fields = T.StructType([f for f in rows.schema.fields if f.name not in (_BUCKET, _GONE)]).json()
        self._place(rows).repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.root}/{path}")
        self.spark.createDataFrame([(number, kind, path, self.key, buckets, self.count, fields)], _LOG).write.mode(
            "append").json(f"{self.root}/log")
        return number

    def _part(self, entry, buckets: set[int], change: bool) -> DataFrame:
        fields = T.StructType.fromJson(json.loads(entry["fields"])).fields
        extra = [T.StructField(_GONE, T.BooleanType())] * change + [T.StructField(_BUCKET, T.IntegerType())]
        rows = self.spark.read.schema(T.StructType([*fields, *extra])).parquet(f"{self.root}/{entry['path']}")
        return rows if len(buckets) == self.count else rows.filter(F.col(_BUCKET).isin(sorted(buckets)))

    def _parts(self, number: int | None, wanted: set[int]) -> tuple[list[DataFrame], list[DataFrame]]:
        """(base parts, changes that are newer than the base of their buckets), each with its bucket."""
        entries = self._entries(number)
        newest = {b: r for r in entries if r["kind"] == "base" for b in r["buckets"]}
        bases, changes = [], []
        for r in entries:
            if r["kind"] == "base":
                own = {b for b in wanted if newest[b]["number"] == r["number"]}
                if own:
                    bases.append(self._part(r, own, False))
            else:
                own = {b for b in wanted if newest[b]["number"] < r["number"]}
                if own:
                    changes.append(self._part(r, own, True).withColumn(_NUMBER, F.lit(r["number"])))
        return bases, changes

    def _merged(self, number: int | None, wanted: set[int]) -> DataFrame:
        bases, changes = self._parts(number, wanted)
        base = merge.union_all(*bases)
        if not changes:
            return base
        changed = merge.union_all(*changes)
        # the base is only read past: adaptive execution broadcasts the changed keys while they are few
        kept = base.join(changed.select(self.key), self.key, "left_anti")
        last = changed.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in changed.columns if c != self.key]), _NUMBER).alias("_last"))
        last = last.select(self.key, "_last.*").filter(~F.col(_GONE)).drop(_GONE, _NUMBER)
        return merge.union_all(kept, last)

    def read(self, number: int | None = None) -> DataFrame:
        """The table now, or as it was after operation ``number``."""
        return self._merged(number, set(range(self.count))).drop(_BUCKET)

    def upsert(self, changes: DataFrame, order: list[str] | None = None) -> int:
        """Update matching keys, insert new ones (``merge.upsert``); writes the rows of the changed keys only.

        A key that changes more than once needs ``order`` to say which row counts last.
        """
        changes = merge.latest_per_key(changes, [self.key], order) if order else changes
        _check_key(changes, self.key)
        named = [f for f in changes.schema.fields if f.name != self.key]
        old = self.read()
        whole = set(old.columns) <= {self.key, *(f.name for f in named)}
        if whole:  # nothing of the old rows stays
            return self._write(changes.withColumn(_GONE, F.lit(False)), "change")
        old = old.join(changes.select(self.key), self.key, "left_semi")
        return self._write(merge.upsert(old, changes, self.key).withColumn(_GONE, F.lit(False)), "change")

    def update_where(self, condition: Column, **values: Column) -> int:
        """Set columns where the condition holds; writes the rows for which it does."""
        return self._write(merge.update_where(self.read().filter(condition), F.lit(True), **values).withColumn(
            _GONE, F.lit(False)), "change")

    def delete_where(self, condition: Column) -> int:
        """Delete the rows for which the condition holds; writes their keys."""
        return self._write(self.read().filter(condition).select(self.key).withColumn(_GONE, F.lit(True)), "change")

    def delete_keys(self, keys: DataFrame) -> int:
        """Delete the rows with one of these keys; writes those of them that exist."""
        gone = self.read().select(self.key).join(keys.select(self.key), self.key, "left_semi")
        return self._write(gone.withColumn(_GONE, F.lit(True)), "change")

    def grown_buckets(self, share: float = GROWN) -> list[int]:
        """Buckets whose changes since their base are ``share`` of its rows or more; counted, not read."""
        bases, changes = self._parts(None, set(range(self.count)))
        if not changes:
            return []
        size = lambda parts, name: merge.union_all(*[p.select(_BUCKET) for p in parts]).groupBy(_BUCKET).agg(
            F.count("*").alias(name))
        sizes = size(changes, "changed").join(size(bases, "held"), _BUCKET, "left")
        grown = sizes.filter(F.col("changed") >= share * F.coalesce("held", F.lit(0)))
        return sorted(r[_BUCKET] for r in grown.select(_BUCKET).collect())  # at most one a bucket

    def compact(self, share: float = GROWN) -> list[int]:
        """Write the grown buckets anew, without their changes; the others keep their files. Returns those written."""
        grown = self.grown_buckets(share)
        if grown:
            self._write(self._merged(None, set(grown)).drop(_BUCKET), "base", grown)
        return grown


def _check_key(df: DataFrame, key: str) -> None:
    rows, keys = df.agg(F.count("*"), F.count_distinct(key)).head()
    if rows != keys:
        raise ValueError(f"{key} must be unique and not null")


def create(df: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
    """A new table with the rows of ``df``; ``key`` must be unique and not null."""
    _check_key(df, key)
    table = KeyedTable(df.sparkSession, root, key, buckets)
    table._write(df, "base", list(range(buckets)))
    return table


def open_table(spark: SparkSession, root: str) -> KeyedTable:
    """The table that ``create`` has made."""
    log = read_log(spark, f"{root}/log", _LOG)
    if log is None:
        raise FileNotFoundError(f"no keyed table in {root}")
    first = log.filter("number = 1").head()
    return KeyedTable(spark, root, first["key"], first["count"])
