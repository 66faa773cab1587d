"""Benchmark passages in documents, by CGK embedding and bit sampling.

Texts are sequences of lower-cased words. The CGK walk reads a sequence with one random bit for each (step, word): it
writes the word it stands on and moves on if the bit is set, so that sequences a few edits apart fall into step again
and their outputs differ in few places. Sampling a few output places gives an LSH key; repeating it reaches the target
recall. Each window of an item's size takes part that could match at all: a match of at least ``similarity`` keeps so
many of the item's words that the window has as many words known from the items. What shares a key is verified by
exact word edit distance.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import stored

#: Least similarity of a match: 1 - edits / words of the item.
SIMILARITY = 0.8
#: Sampled places of a key, the share of matches to be found, and independent repetitions at least.
PLACES, RECALL, REPEATS = 2, 0.97, 32
#: Chance that two sampled places agree at the most edits, times the root of the item's words. Measured: a repetition finds
#: a window 20 % of whose words are edited with probability 0.08 at 300 words and 0.058 at 600; the walks drift apart like
#: a random walk.
IN_STEP = 1.3
#: Bytes of random bits kept between walks.
BITS_KEPT = 64_000_000
#: Bytes of item texts searched in one pass; larger benchmarks are searched in blocks.
ITEM_BYTES = 16_000_000
#: Words of documents that are compared at once.
AT_ONCE = 500_000
#: A word in at most this share of the items is rare.
RARE = 0.02
#: Windows that walk side by side.
WINDOWS = 5_000
_BITS = 256
_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; everything in ASCII but letters and digits separates them."""
    return text.lower().encode("utf-8", "replace").translate(_SPACE).split() if text else []


def repetitions(length: int, places: int = PLACES, recall: float = RECALL, least: int = REPEATS) -> int:
    """Repetitions that find an item of ``length`` words with probability ``recall`` at the most edits."""
    chance = min(IN_STEP / math.sqrt(length), 0.5) ** (places / PLACES)
    return max(least, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


class Items:
    """The items of one block, their words numbered from 1, and the LSH tables by item length."""

    def __init__(self, rows: Iterable[tuple], similarity: float = SIMILARITY, places: int = PLACES,
                 recall: float = RECALL, seed: int = 7):
        self.vocabulary: dict[bytes, int] = {}
        by_length = defaultdict(list)
        for item, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                by_length[len(ids)].append((item, ids))
        # words of few items; an item found has all of its rare words but as many as there are edits
        spread = np.zeros(len(self.vocabulary) + 1, dtype=np.int64)
        for items in by_length.values():
            for _, ids in items:
                spread[np.unique(ids)] += 1
        rare = spread <= max(1, RARE * sum(map(len, by_length.values())))
        self.longest = max(by_length, default=0)
        self.repeats = {n: repetitions(n, places, recall) for n in by_length}
        self.seed, self.kept = seed, {}
        self.at = np.random.default_rng(seed).random((max(self.repeats.values(), default=0), places))
        self.classes, self.bands = [], []
        for length, edits, needed, items in self._classes(by_length, rare, similarity):
            matrix = np.array([ids for _, ids in items], dtype=np.int32)
            keys = self.keys(matrix.ravel(), np.arange(len(items)) * length, length)
            order = np.argsort(keys, axis=1, kind="stable")
            self.classes.append((length, edits, [i for i, _ in items], matrix,
                                 np.take_along_axis(keys, order, axis=1), order, needed,
                                 own := np.unique(matrix), rare[own]))
            # classes of like length and need are looked for together: (shortest length, need, words, rare words, classes)
            last = self.bands[-1] if self.bands else None
            if not last or length > 1.25 * last[0] or length < last[0] or (needed > 0) != (last[1] > 0):
                last = [length, needed, *np.zeros((2, len(rare)), dtype=bool), []]
                self.bands.append(last)
            last[1] = min(last[1], needed)
            last[2][matrix.ravel()] = True
            last[3][matrix.ravel()] = rare[matrix.ravel()]
            last[4].append(len(self.classes) - 1)

    @staticmethod
    def _classes(by_length: dict, rare: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int, list]]:
        """(words, edits, rare words that stay at least, items); items that may lose all rare words stand apart."""
        parts = []
        for length, items in by_length.items():
            edits = int(length * (1 - similarity) + 1e-9)
            stay = [int(rare[ids].sum()) - edits for _, ids in items]
            for some in (True, False):
                own = [(n, i) for n, i in zip(stay, items) if (n > 0) == some]
                if own:
                    parts.append((length, edits, max(min(n for n, _ in own), 0), [i for _, i in own]))
        return iter(sorted(parts, key=lambda p: (p[2] > 0, p[0])))

    def keys(self, ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """LSH keys (repeat, window) of the windows of ``length`` words at ``starts``.

        All walks go on side by side; a key takes up the walk's output at its sampled places.
        """
        places = (self.at[:self.repeats[length]] * 2 * length).astype(int)
        sampled = defaultdict(list)
        for repeat, place in np.ndindex(places.shape):
            sampled[places[repeat, place]].append(repeat)
        at = np.zeros((len(places), len(starts)), dtype=np.int32)
        key = np.full(at.shape, length, dtype=np.uint64)
        for step in range(places.max(initial=-1) + 1):
            inside = at < length
            word = np.where(inside, ids[starts + np.where(inside, at, 0)], -1)
            for repeat in sampled.get(step, ()):
                own = key[repeat] * np.uint64(0x9E3779B97F4A7C15) + word[repeat].astype(np.uint64) + np.uint64(step)
                key[repeat] = own ^ (own >> np.uint64(29))
            at += np.take_along_axis(self.bits(step)[:len(places)], word & (_BITS - 1), axis=1)
        return key

    def bits(self, step: int) -> np.ndarray:
        """Random bits (repeat, word) of one step of the walks."""
        if (own := self.kept.get(step)) is None:
            draw = np.random.Generator(np.random.Philox(key=[self.seed, step]))
            own = draw.integers(0, 2, size=(len(self.at), _BITS), dtype=np.int8)
            if (len(self.kept) + 1) * own.size <= BITS_KEPT:
                self.kept[step] = own
        return own

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item number in its class, class, start, edits) of all matches in a sequence of word numbers.

        ``ids`` ends in ``longest`` zeros, as does every document inside it. A match starts with a word of its item:
        leaving out a first word costs as much as changing it.
        """
        for shortest, needed, vocabulary, rare, members in self.bands:
            known = np.concatenate([[0], np.cumsum(vocabulary[ids], dtype=np.int32)])
            scarce = np.concatenate([[0], np.cumsum(rare[ids], dtype=np.int32)])
            most = max(self.classes[c][1] for c in members)
            longest = min(max(self.classes[c][0] for c in members), len(ids))
            ahead = np.concatenate([scarce[longest:], np.full(longest - shortest, scarce[-1])])
            near = np.flatnonzero((known[shortest:] - known[:-shortest] >= shortest - most)
                                  & (ahead - scarce[:len(ahead)] >= needed) & vocabulary[ids[:len(ids) - shortest + 1]])
            for c in members:
                length, edits, needed = self.classes[c][0], self.classes[c][1], self.classes[c][6]
                starts = near[near <= len(ids) - length]
                starts = starts[(known[starts + length] - known[starts] >= length - edits)
                                & (scarce[starts + length] - scarce[starts] >= needed)]
                for some in np.array_split(starts, len(starts) // WINDOWS + 1):
                    yield from self._verified(ids, some, c)

    def _verified(self, ids: np.ndarray, starts: np.ndarray, c: int) -> Iterator[tuple[int, int, int, int]]:
        """The matches among windows of one class that share a key with an item."""
        length, edits, _, matrix, keys, order, needed, own, rare = self.classes[c]
        # the words of the band have been counted; now those of the class
        window = ids[starts[:, None] + np.arange(length)]
        place = np.minimum(np.searchsorted(own, window), len(own) - 1)
        held = own[place] == window
        starts = starts[(held.sum(axis=1) >= length - edits) & ((held & rare[place]).sum(axis=1) >= needed)]
        if not len(starts):
            return
        pairs = []
        for table, which, own in zip(keys, order, self.keys(ids, starts, length)):
            low, high = np.searchsorted(table, own, "left"), np.searchsorted(table, own, "right")
            hit = np.flatnonzero(high > low)
            if len(hit):
                times = (high - low)[hit]
                each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                pairs.append(np.repeat(starts[hit], times) * len(matrix) + which[np.repeat(low[hit], times) + each])
        if not pairs:
            return
        pairs = np.unique(np.concatenate(pairs))
        for some in np.array_split(pairs, len(pairs) // WINDOWS + 1):
            start, which = some // len(matrix), some % len(matrix)
            found = edit_distances(matrix[which], ids, start, edits)
            for i in np.flatnonzero(found <= edits):
                yield int(which[i]), c, int(start[i]), int(found[i])


def edit_distances(items: np.ndarray, ids: np.ndarray, starts: np.ndarray, edits: int) -> np.ndarray:
    """Least word edit distance of each item to a run of words from its start on; 0 in ``ids`` equals no word."""
    n, length = items.shape
    width = length + edits
    place = starts[:, None] + np.arange(width)
    texts = np.where(place < len(ids), ids[np.minimum(place, len(ids) - 1)], 0)
    across = np.arange(width + 1)
    row = np.broadcast_to(across, (n, width + 1)).astype(np.int32)
    for i in range(length):
        up = row[:, 1:] + 1
        diagonal = row[:, :-1] + (texts != items[:, i:i + 1])
        row = np.concatenate([np.full((n, 1), i + 1, np.int32), np.minimum(up, diagonal).astype(np.int32)], axis=1)
        row = np.minimum.accumulate(row - across, axis=1) + across
    return row.min(axis=1)


def search(items: Items, texts: Iterable[str | None]) -> Iterator[list[tuple]]:
    """For each text its matches (item, first word, words of the item, edits): the best one for each item."""

    def flush(waiting: list[np.ndarray]) -> list[list[tuple]]:
        found = [{} for _ in waiting]
        ends = np.cumsum([len(w) for w in waiting])
        for which, c, start, edits in items.matches(np.concatenate(waiting)):
            doc = int(np.searchsorted(ends, start, "right"))
            first = start - int(ends[doc] - len(waiting[doc]))
            length, _, names = items.classes[c][:3]
            best = found[doc].get((c, which))
            if best is None or (edits, first) < (best[3], best[1]):
                found[doc][c, which] = (names[which], first, length, edits)
        return [sorted(f.values(), key=lambda m: (m[1], str(m[0]))) for f in found]

    waiting, size = [], 0
    number = items.vocabulary.get
    for text in texts:
        ids = [number(w, 0) for w in words(text)]
        waiting.append(np.array(ids + [0] * max(items.longest, 1), dtype=np.int32))
        size += len(waiting[-1])
        if size >= AT_ONCE:
            yield from flush(waiting)
            waiting, size = [], 0
    if waiting:
        yield from flush(waiting)


def item_blocks(items: DataFrame, key: str, text: str, block_bytes: int = ITEM_BYTES) -> Iterator[tuple[list[tuple], bool]]:
    """The items in lists of about ``block_bytes`` bytes, one at a time, each with whether it is the last; null texts have no
    words and are left out."""
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    size = rows.agg(F.sum(F.octet_length("t") + 64).alias("s")).first()["s"] or 0
    blocks = size // block_bytes + 1
    part = F.pmod(F.xxhash64("k", "t"), F.lit(blocks))
    for b in range(blocks):
        yield sorted(((r["k"], r["t"]) for r in rows.filter(part == b).collect()), key=str), b == blocks - 1


def benchmark_matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                      item_key: str = "item_id", item_text: str = "text",
                      similarity: float = SIMILARITY) -> DataFrame:
    """(``key``, ``item_key``, first_word, n_words, edits, similarity): items that a document holds, at their best place.

    ``similarity`` is 1 - edits / words of the item, in word edits. Null or empty texts match nothing, an item without
    words is in no document, equal items match each for itself; repeated documents are reported each time.
    """
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"d {kinds[0]}, i {kinds[1]}, first_word long, n_words int, edits int"
    rows = docs.select(F.col(key).alias("d"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    out = None
    for block, last in item_blocks(items, item_key, item_text):
        def scan(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            held = Items(block, similarity)
            for batch in batches:
                hits = search(held, batch["t"])
                found = [(d, *m) for d, own in zip(batch["d"], hits) for m in own]
                yield pd.DataFrame(found, columns=["d", "i", "first_word", "n_words", "edits"])

        part = rows.mapInPandas(scan, schema)
        if not last:  # written, so that the driver and the plan hold one block of items
            part = stored(part, "benchmark-matches")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("d").alias(key), F.col("i").alias(item_key), "first_word", "n_words", "edits",
                      (1 - F.col("edits") / F.col("n_words")).alias("similarity"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item; no join, so rows without a key are judged like all others."""
    for block, last in item_blocks(items, item_key, item_text):
        docs = docs.filter(_clean(block, similarity)(F.col(text)))
        docs = docs if last else stored(docs, "decontaminated")
    return docs


def _clean(block: list[tuple], similarity: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = Items(block, similarity)
        for batch in batches:
            yield pd.Series([not own for own in search(held, batch)], dtype=bool)

    return clean
