"""Repeated passages, found by Aho-Corasick automata over recurring phrases.

A run of ``window`` words that starts earlier elsewhere is repeated; every word of it is removed. In each window the
phrase of ``PHRASE`` words with the smallest hash stands for it: equal windows have the same phrase at the same place,
so a repeated window has a phrase that recurs. Documents are dealt over shards, and each shard works on its own texts:

1. the phrases that stand for windows are counted over all documents; those that recur are confirmed;
2. every shard compiles an automaton of its recurring phrases and streams its documents through it, which locates
   every occurrence; only documents with one are looked at further. The windows that one occurrence stands for form a
   block;
3. blocks are compared as wholes, first inside their shard, then the first ones of all shards: all windows of a block
   whose words occurred earlier are repeated. Where a phrase has different blocks, the windows of each block's first
   occurrence are compared one by one;
4. the words covered by repeated windows go, per shard.

Documents whose word sequence occurred earlier are decided by that alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import stored, word_hashes

WINDOW, PHRASE = 20, 5
#: Bytes of text of one shard.
SHARD_BYTES = 8_000_000
#: Words that are hashed side by side.
LOT_WORDS = 200_000
#: Stands for a null key; such documents come after all others.
LAST_KEY = (1 << 63) - 1
_M = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8", "replace").split() if text else []


def digest(own: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(own)) - (1 << 63)


def hashes_of(own: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, ``LOT_WORDS`` at a time, however long a document is."""
    return np.concatenate([word_hashes(own[i:i + LOT_WORDS]) for i in range(0, max(len(own), 1), LOT_WORDS)])


def runs(hashes: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
    """A hash of each run of ``size`` words, that depends on their order."""
    total = np.full(max(len(hashes) - size + 1, 0), size, dtype=np.uint64)
    for i in range(size if len(total) else 0):
        total = (total ^ hashes[i:len(hashes) - size + 1 + i]) * by
        total ^= total >> np.uint64(31)
    return total


def half(hashes: np.ndarray) -> np.ndarray:
    """31 bits of each hash."""
    return (hashes >> np.uint64(33)).astype(np.int32)


def representatives(hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> np.ndarray:
    """For each window the place of its phrase of smallest hash, the leftmost of equals."""
    if len(hashes) < window:
        return np.empty(0, dtype=np.int64)
    of = runs(hashes, phrase, _M[0])
    seen = np.lib.stride_tricks.sliding_window_view(of, window - phrase + 1)
    return np.arange(len(seen)) + seen.argmin(axis=1)


def blocks(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of the runs of windows with the same phrase."""
    if not len(places):
        return places, places
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    return first, np.diff(np.r_[first, len(places)])


def block_hash(own: np.ndarray, first: np.ndarray, length: np.ndarray, by: np.uint64) -> np.ndarray:
    """A hash of the windows (hashes ``own``) of each block; the blocks cover all windows."""
    weight = np.cumprod(np.full(int(length.max(initial=1)), _M[0] | np.uint64(1), dtype=np.uint64))
    place = np.arange(len(own)) - np.repeat(first, length)
    total = np.add.reduceat(own * weight[place], first) if len(first) else own[:0]
    return (total ^ length.astype(np.uint64)) * by


def _first_of_each(values: np.ndarray, with_them: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values and what goes with the first of each."""
    different, at = np.unique(values, return_index=True)
    return different, with_them[at]


class Lot:
    """Documents (name, words, spelled words if any) side by side, so that one array operation serves many."""

    def __init__(self, documents: list[tuple], window: int):
        self.names = [name for name, *_ in documents]
        self.words = [w for _, own, *_ in documents for w in own]
        self.spelled = "".join([text for _, _, *given in documents for text in given])
        self.hashes = hashes_of(self.words)
        lengths = np.array([len(own) for _, own, *_ in documents])
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.places = representatives(self.hashes, window)
        # windows that reach into the next document stand for nothing
        inside = np.arange(len(self.places)) + window <= np.repeat(self.ends, lengths)[:len(self.places)]
        self.places[~inside] = -1

    def phrase_hashes(self) -> np.ndarray:
        return runs(self.hashes, PHRASE, _M[0]).view(np.int64)

    def blocks(self, window: int, hashes: int) -> tuple:
        """(first window, windows, place of the phrase, so many hashes of the words) of all blocks, and the hashes of all
        windows."""
        first, length = blocks(self.places)
        own = [runs(self.hashes, window, by) for by in _M[1:1 + hashes]]
        real = self.places[first] >= 0
        named = [block_hash(w, first, length, by)[real].view(np.int64) for w, by in zip(own, _M[1:])]
        return first[real], length[real], self.places[first[real]], named, own

    @staticmethod
    def of(documents: Iterator[tuple], window: int) -> Iterator[Lot]:
        waiting, size = [], 0
        for document in documents:
            waiting.append(document)
            size += len(document[1])
            if size >= LOT_WORDS:
                yield Lot(waiting, window)
                waiting, size = [], 0
        if waiting:
            yield Lot(waiting, window)


def _groups(side: pd.DataFrame) -> dict:
    return {k: g for k, g in side.groupby(["key", "dig"])} if len(side) else {}


def repeated(df: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(``key``, text, spans, n_words, n_removed, kept_sha256) for every row of ``df``.

    ``text`` is what is kept, words joined by one space; ``spans`` are the removed runs [first word, end) in the whole
    text. Windows are judged on the input; earlier means a smaller key, or an earlier start in the same document. Rows
    equal in key and text count as one document, rows with a null key come after all others. ``key`` is an integer.
    Null and empty texts have no words.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("own_key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST_KEY)).alias("key"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    shards = size // SHARD_BYTES + 1
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "text"), F.lit(shards)).cast("int"))

    @F.pandas_udf("struct<dig:long,n:int>")
    def name(texts: pd.Series) -> pd.DataFrame:
        split = [words(t) for t in texts]
        return pd.DataFrame({"dig": [digest(s) for s in split], "n": np.array([len(s) for s in split], dtype="int32")})

    # the first document of each word sequence; 64 bits of the sequence and its length name it
    named = stored(rows.withColumn("d", name("text")).select("shard", "key", "d.dig", "d.n"), "substrings-names")
    firsts = named.groupBy("dig", "n").agg(F.min("key").alias("first"))
    copies = stored(named.join(firsts, ["dig", "n"]).filter(F.col("key") != F.col("first"))
                    .select("shard", "key", "dig").distinct(), "substrings-copies")
    docs = rows.groupBy("shard")

    def originals(own: pd.DataFrame, later: set) -> Iterator[tuple]:
        """((key, digest), words) of the documents of a shard that hold a window and are no later copies."""
        for k, t in _distinct(own):
            split = words(t)
            if len(split) >= window and (name := (k, digest(split))) not in later:
                yield name, split

    kind_of_phrase = "phrase binary, shard int, low long, twice boolean, differ boolean"

    def phrases(copy: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """The phrases of a shard, the least hash of the blocks of each, whether there are two of them and whether they
        differ."""
        made, text = [], {}
        for lot in Lot.of(originals(own, set(zip(copy["key"], copy["dig"]))), window):
            first, length, place, (b1,), _ = lot.blocks(window, 1)
            ph = lot.phrase_hashes()[place]
            made.append(pd.DataFrame({"ph": ph, "b1": b1}))
            for i, p in zip(*(x.tolist() for x in _first_of_each(ph, place))):
                if i not in text:
                    text[i] = b" ".join(lot.words[p:p + PHRASE])
        if not made:
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in kind_of_phrase.split(", ")})
        found = pd.concat(made).groupby("ph")["b1"].agg(["size", "min", "max"])
        return pd.DataFrame({"phrase": [text[i] for i in found.index.tolist()], "shard": int(own["shard"].iloc[0]),
                             "low": found["min"].to_numpy(), "twice": (found["size"] > 1).to_numpy(),
                             "differ": (found["min"] != found["max"]).to_numpy()})

    counted = copies.groupBy("shard").cogroup(docs).applyInPandas(phrases, kind_of_phrase)
    # over the shards of a phrase, at most one row each
    everywhere = Window.partitionBy("phrase")
    recurring = counted.select(
        "shard", "phrase", (F.max("twice").over(everywhere) | (F.count(F.lit(1)).over(everywhere) > 1)).alias("recurs"),
        (F.max("differ").over(everywhere) | (F.min("low").over(everywhere) != F.max("low").over(everywhere))).alias("several")).filter("recurs").drop("recurs")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    side = recurring.select("shard", "phrase", "several", nothing("long", "key"), nothing("long", "dig")).unionByName(
        copies.select("shard", nothing("binary", "phrase"), nothing("boolean", "several"), "key", "dig"))
    kind_of_block = ("shard int, key long, dig long, start int, length int, ph long, b1 long, b2 int, again boolean, "
                     "w1 array<long>, w2 array<int>")

    def locate(side: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        patterns = side[side["phrase"].notna()]
        copy = side[side["phrase"].isna()]
        out = []
        if len(own) and len(patterns):
            automaton = Phrases(patterns["phrase"], patterns["several"].astype(bool))
            found = automaton.holding(originals(own, set(zip(copy["key"].astype("int64"), copy["dig"].astype("int64")))))
            for lot in Lot.of(found, window):
                out.append(automaton.blocks(lot, window))
        if not out:
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in kind_of_block.split(", ")})
        made = pd.concat(out, ignore_index=True).sort_values(["key", "dig", "start"], kind="stable")
        # what is not the shard's first block of its words is repeated whatever the other shards hold
        made["again"] = made.duplicated(["ph", "b1", "b2"])
        made.loc[made["again"], ["w1", "w2"]] = None
        made = made.astype({"ph": "Int64", "b1": "Int64", "b2": "Int32"})
        made.loc[made["again"], ["ph", "b1", "b2"]] = pd.NA
        return made.assign(shard=int(own["shard"].iloc[0]))[[c.split()[0] for c in kind_of_block.split(", ")]]

    block = stored(side.groupBy("shard").cogroup(docs).applyInPandas(locate, kind_of_block), "substrings-blocks")
    at = F.struct("key", "dig", "start")
    place = ["shard", "key", "dig", "start", "length"]
    ahead = block.filter("not again")  # one a shard
    first = ahead.groupBy("ph", "b1", "b2").agg(F.min(at).alias("first"))
    judged = ahead.join(first, ["ph", "b1", "b2"]).withColumn("again", at != F.col("first"))
    # windows are there where a phrase has several blocks
    apart = judged.filter("not again").filter(F.col("w1").isNotNull()).select(
        "shard", "key", "dig", "start", F.posexplode(F.arrays_zip("w1", "w2")).alias("at", "w"))
    each = stored(apart.select("shard", "key", "dig", (F.col("start") + F.col("at")).alias("start"), "w.w1", "w.w2"),
                  "substrings-windows")
    earliest = each.groupBy("w1", "w2").agg(F.min(at).alias("first"))
    single = each.join(earliest, ["w1", "w2"]).filter(at != F.col("first"))
    gone = (block.filter("again").select(place).unionByName(judged.filter("again").select(place))
            .unionByName(single.select("shard", "key", "dig", "start", F.lit(1).alias("length")))
            .unionByName(copies.select("shard", "key", "dig", F.lit(0).alias("start"), F.lit(-1).alias("length"))))

    def remove(side: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        marks, out = _groups(side), []
        keys = {k for k, _ in marks}
        for shown, k, t in zip(own["own_key"], own["key"], own["text"]):
            split = words(t)
            part = marks.get((k, digest(split))) if k in keys else None
            spans = removed_spans(part, len(split), window) if part is not None else []
            kept, end = [], 0
            for a, b in spans:
                kept += split[end:a]
                end = b
            kept = b" ".join(kept + split[end:])
            out.append((shown, kept.decode("utf-8"), [list(map(int, s)) for s in spans], len(split),
                        sum(int(b - a) for a, b in spans), hashlib.sha256(kept).hexdigest()))
        made = pd.DataFrame(out, columns=["k", "text", "spans", "n_words", "n_removed", "kept_sha256"])
        return made.astype({"k": "Int64"})

    done = gone.groupBy("shard").cogroup(docs).applyInPandas(
        remove, f"k {kind}, text string, spans array<array<int>>, n_words long, n_removed long, kept_sha256 string")
    return done.withColumnRenamed("k", key)


def _distinct(own: pd.DataFrame) -> Iterator[tuple]:
    """(key, text) of a shard, once for rows that are equal in both."""
    return zip(*(own.drop_duplicates(["key", "text"])[c] for c in ("key", "text")))


class Phrases:
    """An automaton of phrases. Words are numbered and spelled by three characters of three alphabets, so that few
    branches leave a node, an occurrence starts at a word, and unknown words never match."""

    BASE = 120

    def __init__(self, phrases, several):
        import ahocorasick

        self.spelling: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        marked = []
        for phrase, many in zip(phrases, several):
            split = bytes(phrase).split(b" ")
            self.automaton.add_word("".join([self.spelled(w) for w in split]))
            if many:
                marked += split
        self.automaton.make_automaton()
        #: hashes of the phrases whose blocks differ
        self.several = runs(hashes_of(marked), PHRASE, _M[0])[::PHRASE].view(np.int64)

    def spelled(self, word: bytes) -> str:
        if (own := self.spelling.get(word)) is None:
            high, low = divmod(len(self.spelling), self.BASE)
            high, middle = divmod(high, self.BASE)
            own = self.spelling[word] = chr(1 + low) + chr(0x100 + middle) + chr(0x200 + high)
        return own

    def text(self, split: list[bytes]) -> str:
        spelled = self.spelling.get
        return "".join([spelled(w, "\0\0\0") for w in split])

    def holding(self, documents: Iterator[tuple]) -> Iterator[tuple]:
        """The documents (name, words) in which any phrase occurs, with their words spelled."""
        for name, split in documents:
            text = self.text(split)
            if next(self.automaton.iter(text), None) is not None:
                yield name, split, text

    def starts(self, text: str) -> np.ndarray:
        """For each word of a spelled text whether a phrase starts there."""
        found = np.zeros(len(text) // 3, dtype=bool)
        ends = np.fromiter((end for end, _ in self.automaton.iter(text)), dtype=np.int64)
        found[ends // 3 - PHRASE + 1] = True
        return found

    def blocks(self, lot: Lot, window: int) -> pd.DataFrame:
        """The blocks of a lot that occurrences stand for, with the hashes of their words and windows."""
        found = self.starts(lot.spelled)
        first, length, place, hashes, (w1, w2) = lot.blocks(window, 2)
        take = found[place]
        first, length, place = first[take], length[take], place[take]
        ph, doc = lot.phrase_hashes()[place], np.searchsorted(lot.ends, first, "right")
        compared = np.isin(ph, self.several).tolist()
        w1, w2 = w1.view(np.int64), half(w2)
        parts = list(zip(first.tolist(), length.tolist(), compared))
        return pd.DataFrame({
            "key": np.array([k for k, _ in lot.names], dtype=np.int64)[doc],
            "dig": np.array([d for _, d in lot.names], dtype=np.int64)[doc], "start": first - lot.starts[doc], "length": length,
            "ph": ph, "b1": hashes[0][take], "b2": half(hashes[1][take].view(np.uint64)),
            "w1": pd.Series([w1[a:a + n] if c else None for a, n, c in parts], dtype=object),
            "w2": pd.Series([w2[a:a + n] if c else None for a, n, c in parts], dtype=object)})


def removed_spans(part: pd.DataFrame, n: int, window: int) -> list[tuple[int, int]]:
    """Merged runs of words covered by repeated windows; length -1 means the whole text, if it holds a window."""
    if (part["length"] < 0).any():
        return [(0, n)] if n >= window else []
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, part["start"].to_numpy(), 1)
    np.add.at(change, part["start"].to_numpy() + part["length"].to_numpy() + window - 1, -1)
    inside = np.r_[False, np.cumsum(change[:-1]) > 0, False].astype(np.int8)
    edges = np.diff(inside)
    return list(zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)))
