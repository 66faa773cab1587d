"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIMS`` signs, drawn from its code point. Three letters in a row are bound into one
vector: the first letter's vector rotated twice, the second's rotated once and the third's are multiplied. A text is the
bundle (sum) of the vectors of all its letter triples, runs of other characters being one blank. A language's prototype
bundles the unit vectors of its training texts, and a text belongs to the prototype of largest cosine.

Bundles are integer sums and prototypes sums of rounded unit vectors, so neither depends on the order or the
partitioning of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1024
#: Predicted for texts without a letter, and by a model without languages.
UNKNOWN = "und"
BLANK = ord(" ")
#: Characters turned into letter triples at a time, texts bundled at a time, triples bound at a time.
PIECE, TEXTS, GRAMS = 1 << 18, 128, 8_192
#: Unit vectors become integers in these steps before they are summed.
STEPS = 1 << 30
#: Partial prototypes a task holds, and groups in which those of a language are summed first.
HELD, GROUPS = 512, 256
_BITS, _MASK = 21, (1 << 21) - 1


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@cache
def letter_vector(code: int, dims: int) -> np.ndarray:
    draw = np.random.Generator(np.random.Philox(key=code))
    return (draw.integers(0, 2, dims, dtype=np.int8) * 2 - 1).astype(np.int8)


def triples(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(different letter triples, their counts) of a whole text; empty without a letter."""
    found, carry, any_letter = [], np.array([BLANK], dtype=np.uint32), False
    shown = text.lower()
    for at in range(0, len(shown), PIECE):
        own = np.frombuffer(shown[at:at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters()[own]
        any_letter = any_letter or bool(is_letter.any())
        own = np.r_[carry, np.where(is_letter, own, np.uint32(BLANK))]
        if at + PIECE >= len(shown):
            own = np.r_[own, np.uint32(BLANK)]
        own = own[np.r_[True, (own[1:] != BLANK) | (own[:-1] != BLANK)]].astype(np.int64)
        found.append(np.unique(own[:-2] << 2 * _BITS | own[1:-1] << _BITS | own[2:], return_counts=True))
        carry = own[-2:].astype(np.uint32)
    if not any_letter:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if len(found) == 1:
        return found[0]
    codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(place, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def bound(codes: np.ndarray, dims: int) -> np.ndarray:
    """The vector of each letter triple."""
    parts = [codes >> 2 * _BITS, codes >> _BITS & _MASK, codes & _MASK]
    used, place = np.unique(np.concatenate(parts), return_inverse=True)
    table = np.stack([letter_vector(c, dims) for c in used.tolist()])
    a, b, c = place.reshape(3, -1)
    return np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]


def bundles(texts: list[str | None], dims: int) -> np.ndarray:
    """The bundle of each text, zero without letters."""
    own = [triples(t or "") for t in texts]
    out = np.zeros((len(texts), dims))
    codes, place = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
    counts = np.concatenate([n for _, n in own])
    row = np.repeat(np.arange(len(own)), [len(c) for c, _ in own])
    # partial sums stay below a text's number of triples, so single precision is exact below 2 ** 24
    kind = np.float32 if max((n.sum() for _, n in own), default=0) < 1 << 24 else np.float64
    for at in range(0, len(codes), GRAMS):
        here = (place >= at) & (place < at + GRAMS)
        matrix = np.zeros((len(texts), min(GRAMS, len(codes) - at)), dtype=kind)
        matrix[row[here], place[here] - at] = counts[here]
        out += matrix @ bound(codes[at:at + GRAMS], dims).astype(kind)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


@dataclass(frozen=True)
class Profiles:
    """Languages in alphabetical order and their prototypes, one unit vector a row."""

    languages: tuple[str, ...]
    prototypes: np.ndarray

    def classify(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The place of each text's language, -1 if it is unknown, and the cosine with its prototype."""
        own = bundles(texts, self.prototypes.shape[1])
        known = own.any(axis=1) & (len(self.languages) > 0)
        if not known.any():
            return np.full(len(texts), -1), np.zeros(len(texts))
        cosine = unit(own) @ self.prototypes.T
        best = cosine.argmax(axis=1)
        return np.where(known, best, -1), np.where(known, np.clip(cosine[np.arange(len(own)), best], 0, 1), 0.0)


def train(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", dims: int = DIMS) -> Profiles:
    """Prototypes of all rows where ``usable`` holds and ``lang`` is not null; texts without letters add nothing.

    Tasks sum their own rows and send one vector a language. The driver gets one vector of ``dims`` numbers for each
    language, so ``lang`` must be a label with few values, such as a language code.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, sums = TaskContext.get().partitionId() % GROUPS, {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"lang": pd.Series(list(sums), dtype=object), "part": group,
                                "total": pd.Series([s.tobytes() for s in sums.values()], dtype=object)})
            sums.clear()
            return out

        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                some = batch.iloc[at:at + TEXTS]
                own = np.rint(unit(bundles(some["text"].tolist(), dims)) * STEPS).astype(np.int64)
                for language, places in some.groupby("lang").indices.items():
                    total = own[places].sum(axis=0)
                    if language in sums:
                        sums[language] += total
                    else:
                        sums[language] = total
                if len(sums) > HELD:
                    yield flush()
        yield flush()

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(t, dtype=np.int64) for t in rows["total"])
        return pd.DataFrame({"lang": pd.Series([rows["lang"].iloc[0]], dtype=object), "part": rows["part"].iloc[:1].to_numpy(),
                             "total": [total.tobytes()]})

    kind = "lang string, part int, total binary"
    parts = (docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
             .select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInPandas(add, kind))
    # first within a group of tasks, then over the groups: a language in every row of a large table stays cheap
    for keys in (["lang", "part"], ["lang"]):
        parts = parts.groupBy(*keys).applyInPandas(combine, kind)
    rows = sorted((r["lang"], r["total"]) for r in parts.collect())
    sums = np.array([np.frombuffer(t, dtype=np.int64) for _, t in rows], dtype=np.float64).reshape(len(rows), dims)
    able = sums.any(axis=1)
    return Profiles(tuple(name for (name, _), k in zip(rows, able) if k), unit(sums[able]))


def predict(profiles: Profiles):
    """A Column function from texts to struct<lang, score>; score is the cosine with the language's prototype, from 0.

    Null texts and texts without a letter are ``UNKNOWN`` with score 0, and so is every text if no language was
    learnt. Of prototypes at equal cosine the alphabetically first language counts.
    """

    @F.pandas_udf("struct<place:int,score:double>")
    def classified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = [profiles.classify(batch.iloc[at:at + TEXTS].tolist()) for at in range(0, len(batch), TEXTS)]
            places, scores = (np.concatenate([np.empty(0, kind), *x])
                              for x, kind in zip(zip(*some) if some else ((), ()), ("int32", "float64")))
            yield pd.DataFrame({"place": places.astype("int32"), "score": scores})

    names = F.array(*(F.lit(name) for name in (UNKNOWN, *profiles.languages)))

    def predicted(text) -> Column:
        found = classified(text)
        return F.struct(F.element_at(names, found["place"] + 2).alias("lang"), found["score"].alias("score"))

    return predicted
