"""Token counts of whole texts, huge documents in overlapping chunks that are spliced at stable boundaries.

A document longer than a chunk is cut into chunks that overlap. The byte-level tokenizer first splits text into words
(its pretokens) from left to right, without memory: from the end of one word on, the split depends on the text that
follows alone. So a word start that both chunks of an overlap have, outside the reach of the left chunk's cut and past
the right chunk's first word, is a boundary of the whole text, and both chunks agree from there on. Each chunk then
counts its tokens from the splice on its left to the splice on its right. Where an overlap has no common start, the
document goes round again with wider overlaps.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import checkpointed

#: Characters of a chunk and of its first overlap with the next one.
CHUNK, OVERLAP = 65_536, 1_024
#: Characters at the end of a chunk whose split may depend on what follows: contractions need 3, white space 1,
#: special strings are found whole; their length is added.
REACH = 8


#: Characters whose class is the same in every Unicode table, so that the split below is the library's own.
PLAIN = re.compile("[\t\n\r -~À-ſ]*")
#: The split of the byte-level tokenizer, letters and digits spelt out for plain characters.
LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")
#: Words whose token count a task remembers.
REMEMBERED = 1_000_000


class Counter(dict):
    """Token counts of texts by one tokenizer file; maps a word to its number of tokens.

    A text of plain characters is split here and each distinct word is encoded once; every other text, and every text
    with a special string, goes to the library as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the split is that of a byte-level tokenizer with the usual pattern and no normaliser
        settings = json.loads(self.tokenizer.to_str())
        split = settings["pre_tokenizer"] or {}
        self.splits = (settings["normalizer"] is None and split.get("type") == "ByteLevel"
                       and split.get("use_regex") and not split.get("add_prefix_space"))

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = len(self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0])
        return n

    def count(self, text: str) -> int:
        if self.splits and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return sum(map(self.__getitem__, WORD.findall(text)))
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])


def word_starts(encoding) -> tuple[np.ndarray, np.ndarray]:
    """(character, tokens before it) of each word's first token."""
    words = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    offsets = encoding.offsets  # the library builds this list anew on every access
    return np.array([offsets[i][0] for i in first], dtype=np.int64), first


def chunk_edges(tokenizer, text: str, start: int, overlap: int, last: bool) -> tuple[int, list, list, list, list]:
    """Tokens of a chunk and its candidate boundaries (character, tokens before) in its first and last overlap."""
    encoding = tokenizer.encode(text, add_special_tokens=False)
    at, before = word_starts(encoding)
    reach = REACH + max([len(t.content) for t in tokenizer.get_added_tokens_decoder().values()], default=0)
    head = (at > 0) & (at < overlap)
    tail = np.zeros(len(at), bool) if last else (at >= len(text) - overlap) & (at <= len(text) - reach)
    return (len(encoding.ids), (at[head] + start).tolist(), before[head].tolist(),
            (at[tail] + start).tolist(), before[tail].tolist())


def count_tokens(df: DataFrame, key: str, text: str, path: str, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """(``key``, n_tokens) of each row, see ``count_bytes_and_tokens``."""
    return count_bytes_and_tokens(df, key, text, path, chunk, overlap).drop("n_bytes")


def count_bytes_and_tokens(df: DataFrame, key: str, text: str, path: str, chunk: int = CHUNK,
                           overlap: int = OVERLAP) -> DataFrame:
    """(``key``, n_bytes, n_tokens): UTF-8 bytes and what the tokenizer file at ``path`` gives for each whole text.

    No begin, end or added special tokens, no truncation; special strings in a text are read as the library reads them
    by default. Null and empty texts have 0 of both. ``path`` must exist on every executor. One row for each row of
    ``df``: ``key`` is carried along and may be null or repeated, in texts of any length. Texts longer than ``chunk``
    characters are named by their SHA-256; equal ones are counted once.
    """
    kind = df.schema[key].dataType.simpleString()
    full = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.octet_length(full).cast("long").alias("n_bytes"), full.alias("text"))
    short = rows.filter(F.length("text") <= chunk)
    named = rows.filter(F.length("text") > chunk).withColumn("id", F.sha2("text", 256))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            # keys stay in Arrow: pandas would turn integers beside nulls into floats
            n = pa.array([counter.count(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), n],
                                             names=["key", "n_bytes", "n_tokens"])

    done, long = [], named.select("id", "text")
    while True:
        spliced = checkpointed(_spliced(long, path, chunk, overlap))
        done.append(spliced.filter(~F.col("failed")).select("id", "n_tokens"))
        failed = spliced.filter("failed").select("id")
        if failed.isEmpty():
            break
        # an overlap without a common boundary: widen, and keep chunks at least twice as long as their overlap
        overlap *= 4
        chunk = max(chunk, 2 * overlap)
        long = long.join(failed, "id", "left_semi")
    counts = reduce(DataFrame.unionByName, done)
    return (short.mapInArrow(whole, f"key {kind}, n_bytes long, n_tokens long")
            .unionByName(named.drop("text").join(counts, "id").drop("id"))
            .withColumnRenamed("key", key))


def _spliced(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(id, n_tokens, failed) of texts longer than a chunk, from (id, text); rows of one id have the same text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, text in zip(batch["id"], batch["text"]):
                # one chunk a frame: an input batch of huge texts never doubles in memory
                for k, start in enumerate(range(0, len(text), chunk)):
                    yield pd.DataFrame({"id": [name], "k": [k], "start": [start],
                                        "last": [start + chunk + overlap >= len(text)],
                                        "piece": [text[start:start + chunk + overlap]]})
                    if start + chunk + overlap >= len(text):
                        break

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = Counter(path).tokenizer
        for batch in batches:
            for name, k, start, last, piece in batch.itertuples(index=False):
                total, *lists = chunk_edges(tokenizer, piece, start, overlap, last)
                yield pd.DataFrame({"id": [name], "k": [k], "last": [last], "total": [total], "head": [lists[0]],
                                    "head_before": [lists[1]], "tail": [lists[2]], "tail_before": [lists[3]]})

    pieces = long.mapInPandas(cut, "id string, k int, start long, last boolean, piece string")
    # chunks of one document spread over the tasks; those of equal texts become one, on the map side first
    pieces = pieces.dropDuplicates(["id", "k"])
    parts = checkpointed(pieces.mapInPandas(
        edges, "id string, k int, last boolean, total long, head array<long>, head_before array<long>, "
               "tail array<long>, tail_before array<long>"))
    right = parts.select("id", (F.col("k") - 1).alias("k"), "head", "head_before")
    joined = parts.drop("head", "head_before").join(right, ["id", "k"], "left")
    splice = F.array_min(F.array_intersect("tail", "head"))
    at = lambda where, value: F.element_at(value, F.array_position(where, F.col("splice")).cast("int"))
    counted = joined.withColumn("splice", splice).select(
        "id", (~F.col("last") & F.col("splice").isNull()).alias("failed"),
        F.when(F.col("last"), F.col("total")).otherwise(
            at(F.col("tail"), F.col("tail_before")) - at(F.col("head"), F.col("head_before"))).alias("n"))
    return counted.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.max("failed").alias("failed"))
