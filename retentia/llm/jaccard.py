"""Exact Jaccard join of shingle sets in metric space.

1 - J is a metric. Pivot documents divide the others into regions, and the triangle inequality says which documents
near a border must be seen from both sides. In shingle space nearly all documents are at distance 1 from any given
pivot, where no window cuts anything off; pivots therefore are chosen inside neighbourhoods that must contain every
link: two sets with J >= t share one of their first ``n - ceil(t n) + 1`` shingles in any common order, here rarest
first. The documents with a common first shingle are a region. In each region, round by round:

* the documents of smallest hash are its pivots, one, then more each round, and all others are measured against them;
  a document's home is the pivot it is linked to, and everything linked to one pivot is one component;
* pairs that are in one component already need no further look, nor do pairs whose distances to the region's first
  pivot differ by more than the join distance (triangle inequality), nor pairs whose sizes or parities in 256 cells
  differ too much; documents in the window go on to the next round;
* pivots have met everything in their region and leave it. A region ends when one component is left.

A measurement first compares sizes, then parity bitmaps (the sets differ in at least as many shingles as their bitmaps
in bits), then the sets themselves. Documents of equal word sequence are one class throughout, so copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retentia.llm.common import checkpointed, name_beside, passing, release, small_batches, stored, word_hashes
from retentia.llm.graph import connected

#: Cells of the table of shingle counts that orders shingles, rarest first. Any order gives the same links.
CELLS = 1 << 18
#: Class names that are broadcast; more are joined by a shuffle.
CARRIED = 200_000
#: In round k a region has up to PIVOTS ** (k - 1) pivots.
PIVOTS = 32
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def digest(own: list[bytes]) -> bytes:
    """Names a word sequence; equal for texts of equal words."""
    return xxhash.xxh3_128_digest(b" ".join(own))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words; a shorter sequence is one shingle, an empty one none."""
    if not len(hashes):
        return hashes
    run = min(size, len(hashes))
    total = np.full(len(hashes) - run + 1, run, dtype=np.uint64)
    for i in range(run):
        total = (total ^ hashes[i:len(hashes) - run + 1 + i]) * _K[0]
        total ^= total >> np.uint64(29)
    total *= _K[1]
    total ^= total >> np.uint64(32)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def cells_of(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(46)).astype(np.int64)


def first_shingles(own: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, of which two linked sets share one."""
    keep = len(own) - -(-percent * len(own) // 100) + 1
    if keep >= len(own):
        return own
    count = rarity[cells_of(own)]
    return own[np.lexsort((own, count))[:keep]]


def bitmap(own: np.ndarray) -> bytes:
    """Parity of the number of shingles in each cell; 2 ** k >= n / 2 cells, 64 at least."""
    cells = max(64, 1 << max(0, (len(own) // 2 - 1).bit_length()))
    return np.packbits(np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1,
                       bitorder="little").tobytes()


#: Cells of the parity word that every row of a region carries.
PARITY = 256


def parity(own: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of ``PARITY`` cells, as 64-bit numbers."""
    odd = np.bincount((own >> np.uint64(32) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_link(nx, np_, difference, percent: int):
    """Sets of these sizes that differ in ``difference`` shingles at least may be as similar as asked.

    |x & p| <= (nx + np - difference) / 2.
    """
    return 100 * (nx + np_ - difference) >= percent * (nx + np_ + difference)


def least_difference(a: bytes, b: bytes) -> int:
    """Two sets differ in at least so many shingles; the longer bitmap is folded to the cells of the shorter."""
    x, y = (np.frombuffer(m, dtype=np.uint64) for m in (a, b))
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def class_name():
    """A Column function from texts to the names of their classes; null without words."""

    @F.pandas_udf("binary")
    def names(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(own) if own else None for own in map(words, texts)], dtype=object)

    return names


def count_cells(df: DataFrame, text: str, size: int) -> np.ndarray:
    """Number of documents' shingles in each of ``CELLS`` cells, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for t in batch["t"]:
                np.add.at(total, cells_of(shingles(word_hashes(words(t)), size)), 1)
        parts = total.reshape(-1, 1 << 10)
        yield pd.DataFrame({"part": np.arange(len(parts)), "n": [p.tobytes() for p in parts]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(n, dtype=np.int64) for n in parts["n"])
        return pd.DataFrame({"part": parts["part"].iloc[:1], "n": [total.tobytes()]})

    counts = (df.select(F.col(text).alias("t")).mapInPandas(count, "part int, n binary")
              .groupBy("part").applyInPandas(add, "part int, n binary"))
    out = np.zeros((CELLS >> 10, 1 << 10), dtype=np.int64)
    with small_batches(df.sparkSession):
        rows = counts.collect()  # CELLS numbers
    for row in rows:
        out[row["part"]] = np.frombuffer(row["n"], dtype=np.int64)
    return out.ravel()


def classes(df: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """(id, n, firsts array<long>, bits, parity, sample): one row per word sequence and task, with what the regions need.

    ``sample`` is the digest of one text of the class.
    """
    rarity = df.sparkSession.sparkContext.broadcast(count_cells(df, text, size))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            rows = []
            for t, sample in zip(batch["t"], batch["sample"]):
                own = words(t)
                if not own or (name := digest(own)) in seen:
                    continue
                seen.add(name)
                sets = shingles(word_hashes(own), size)
                rows.append((name, len(sets), first_shingles(sets, rarity.value, percent).view(np.int64), bitmap(sets),
                             parity(sets), sample))
            yield pd.DataFrame(rows, columns=["id", "n", "firsts", "bits", "parity", "sample"])

    return df.select(F.col(text).alias("t"), text_digest(text).alias("sample")).mapInPandas(
        describe, "id binary, n int, firsts array<long>, bits binary, parity array<long>, sample binary")


def text_digest(text: str) -> Column:
    return F.unhex(F.md5(text))


def sets_of(df: DataFrame, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """(id, items array<long>) of the classes in ``wanted`` (id, sample; each once).

    Their texts are found by the digest, so Python sees no other text.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "items": [shingles(word_hashes(words(t)), size).view(np.int64)
                                                             for t in batch["t"]]})

    if wanted.count() <= CARRIED:  # 32 bytes a class; the texts then need no shuffle to find them
        wanted = F.broadcast(wanted)
    one = (df.select(F.col(text).alias("t")).filter(F.col("t").isNotNull()).withColumn("sample", text_digest("t"))
           .join(wanted, "sample").select("id", "t").dropDuplicates(["id"]))
    return one.mapInPandas(build, "id binary, items array<long>")


def similar_enough(a: str, b: str, percent: int):
    """Sizes allow a link: the smaller set has ``percent`` of the larger one."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def measure(pairs: DataFrame, bits: DataFrame, sets, percent: int) -> DataFrame:
    """(x, p, linked, low, high) with bounds of the distance, from pairs (x, p, nx, np)."""

    @F.pandas_udf("int")
    def differ(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([least_difference(x, y) for x, y in zip(a, b)], dtype="int32")

    # tables of known size: few pairs need few bitmaps, and the others are then not shuffled
    pairs = stored(pairs, "jaccard-pairs")
    needed = stored(pairs.select(F.col("x").alias("id")).union(pairs.select("p")).distinct(), "jaccard-needed")
    bits = stored(bits.join(needed, "id", "left_semi"), "jaccard-bits")
    left, right = (bits.select(F.col("id").alias(c), F.col("bits").alias(f"{c}b")) for c in "xp")
    total = F.col("nx") + F.col("np")
    bounded = stored(pairs.join(left, "x").join(right, "p").withColumn("diff", differ("xb", "pb")).drop("xb", "pb")
                     .withColumn("may", may_link(F.col("nx"), F.col("np"), F.col("diff"), percent)),
                     "jaccard-bounds")
    close = bounded.filter("may").select("x", "p", "nx", "np")
    known = sets(checkpointed(close.select(F.col("x").alias("id")).union(close.select("p")).distinct()))
    first, second = (known.select(F.col("id").alias(c), F.col("items").alias(f"{c}s")) for c in "xp")
    exact = (close.join(first, "x").join(second, "p")
             .withColumn("both", F.size(F.array_intersect("xs", "ps"))).drop("xs", "ps"))
    union = total - F.col("both")
    exact = exact.select("x", "p", (100 * F.col("both") >= percent * union).alias("linked"),
                         (1 - F.col("both") / union).alias("low"), (1 - F.col("both") / union).alias("high"))
    far = bounded.filter("not may").select(
        "x", "p", F.lit(False).alias("linked"),
        (2 * F.col("diff") / (total + F.col("diff"))).alias("low"), F.lit(1.0).alias("high"))
    measured = stored(exact.unionByName(far), "jaccard-measured")
    release(pairs.sparkSession, pairs, needed, bits, bounded)
    return measured


def class_components(df: DataFrame, text: str, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """((id, n), (id, label)): the classes with their set sizes, and the components of those that have a link."""
    spark = df.sparkSession
    described = stored(classes(df, text, size, percent).dropDuplicates(["id"]), "jaccard-classes")
    sizes, bits = described.select("id", "n"), described.select("id", "bits")
    # most shingles are nobody else's: until those are gone, rows carry a short handle of their class, and a handle
    # that two classes share only adds candidates
    handle = F.xxhash64("id").alias("handle")
    region = Window.partitionBy("sig")  # counted and given its first pivot in place: its rows move once for each
    shared = described.select(handle, F.explode("firsts").alias("sig")).withColumn(
        "m", F.count(F.lit(1)).over(region)).filter("m > 1")
    least = F.min(F.struct(F.xxhash64("id").alias("hash"), "id", "n", "parity")).over(region)
    members = stored(
        shared.join(described.select(handle, "id", "n", "parity"), "handle")
        .select("sig", "id", "n", "parity", "m", least.alias("of"))
        .select("sig", "id", "n", "parity", "m", F.col("of.id").alias("p"), F.col("of.n").alias("np"),
                F.col("of.parity").alias("pparity")), "jaccard-members")
    labels = spark.createDataFrame([], "id binary, label binary")
    held: list[DataFrame] = []

    def sets(wanted: DataFrame) -> DataFrame:
        """The sets of these classes; what an earlier round has fetched is not built again."""
        missing = wanted.join(held[0].select("id"), "id", "left_anti") if held else wanted
        missing = checkpointed(missing.join(described.select("id", "sample"), "id"))
        fresh = stored(sets_of(df, text, size, missing), "jaccard-sets")
        held[:] = [held[0].unionByName(fresh)] if held else [fresh]
        return held[0]

    reach = 1 - percent / 100 + 1e-9
    count = 1
    ways = None
    while True:
        # rows that differ in too many parities are no pair of the join at all
        apart = sum((F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("pparity", F.lit(i)))) for i in range(PARITY // 64)),
                    F.lit(0))
        if count == 1:  # every class is a component of its own, every region is open and its rows carry its pivot
            if members.isEmpty():
                break
            met = members.withColumnsRenamed({"id": "x", "n": "nx"}).filter(F.col("x") != F.col("p"))
            passed = [members]
        else:
            live = members.join(labels, "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")
            live = (live.withColumns({"a": F.min("comp").over(region), "b": F.max("comp").over(region)})
                    .filter(F.col("a") != F.col("b")).drop("a", "b"))
            passed = [members]
            if ways is not None:  # distances to the region's first pivot give the windows of the later rounds
                live = (live.join(ways, ["id", "first"], "left").drop("first")
                        .withColumn("low", F.coalesce("low", F.lit(0.0))).withColumn("high", F.coalesce("high", F.lit(1.0))))
                ways = None
            live = stored(live, "jaccard-live")
            if live.isEmpty():
                break
            rank = F.row_number().over(region.orderBy(F.xxhash64("id"), "id"))
            pivots = stored(live.withColumn("rank", rank).filter(F.col("rank") <= count).select(
                "sig", F.col("id").alias("p"), F.col("n").alias("np"), F.col("comp").alias("cp"),
                F.col("parity").alias("pparity"), F.col("low").alias("plow"), F.col("high").alias("phigh")), "jaccard-pivots")
            window = ((F.col("low") - F.col("phigh") <= reach) & (F.col("plow") - F.col("high") <= reach))
            met = (live.withColumnsRenamed({"id": "x", "n": "nx"}).join(pivots, "sig")
                   .filter((F.col("comp") != F.col("cp")) & window))
            passed += [live, pivots]
        pairs = (met.filter(similar_enough("nx", "np", percent) & may_link(F.col("nx"), F.col("np"), apart, percent))
                 .select(F.least("x", "p").alias("x"), F.greatest("x", "p").alias("p"), "nx", "np")
                 .dropDuplicates(["x", "p"]))
        measured = measure(pairs, bits, sets, percent)
        linked = measured.filter("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))
        # between rounds only components are linked anew
        named = linked
        for c in "ab":
            named = (named.join(labels.select(F.col("id").alias(c), F.col("label").alias("l")), c, "left")
                     .withColumn(c, F.coalesce("l", c)).drop("l"))
        joined = connected(named)
        merged = (labels.join(joined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left")
                  .select("id", F.coalesce("to", "label").alias("label")))
        labels = checkpointed(merged.union(joined.join(labels, "id", "left_anti")))
        if count == 1:  # a region of two classes ends with its pivot
            members = stored(members.filter((F.col("m") > 2) & (F.col("id") != F.col("p")))
                             .select("sig", "id", "n", "parity", F.col("p").alias("first")), "jaccard-members")
            ways = (measured.select(F.col("x").alias("id"), F.col("p").alias("first"), "low", "high")
                    .union(measured.select("p", "x", "low", "high")))
        else:
            rest = live.drop("comp").join(pivots.select("sig", F.col("p").alias("id")), ["sig", "id"], "left_anti")
            members = stored(rest, "jaccard-members")
            passed.append(measured)
        release(spark, *passed)
        count *= PIVOTS
    return sizes, labels


def _labelled(named: DataFrame, key: str, text_of: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """``named`` (key, id) with n, component (label of the component) and first (its smallest key)."""
    sizes, labels = class_components(text_of, text, size, percent)
    by_class = sizes.join(labels, "id", "left").select("id", "n", F.coalesce("label", "id").alias("component"))
    least = (named.join(by_class, "id").groupBy("component").agg(F.min(key).alias("first")))
    return checkpointed(by_class.join(least, "component").select("id", "n", "component", "first"))


def components(df: DataFrame, key: str, text: str, size: int = 5, percent: int = 80) -> DataFrame:
    """(``key``, n_shingles, component_id) for every row: the size of its shingle set and the smallest key it is linked to.

    Two rows link when 100 * |intersection| >= ``percent`` * |union| of their sets of ``size``-word shingles. A text of
    fewer words is one shingle; null, empty and blank texts have none and are linked with nothing. Rows of equal text
    are linked, whatever their keys; a null key is never the smallest unless all keys of the component are null.
    """
    named = stored(df.select(F.col(key).alias("key"), class_name()(F.col(text)).alias("id")), "jaccard-names")
    found = _labelled(named, "key", df, text, size, percent).drop("component")
    return named.join(found, "id", "left").select(
        F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.col("key")).otherwise(F.col("first")).alias("component_id"))


def row_token(key: str, text: str, worded: Column) -> Column:
    """Names a row by its key and text; a row without words has a name of its own."""
    both = F.concat(F.md5(text), F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    alone = F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))
    return F.when(worded, F.unhex(F.md5(both))).otherwise(alone.cast("binary"))


def one_of_each(df: DataFrame, key: str, text: str, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` with the smallest key of their component, one row for each; texts without words all stay.

    Rows are found again by a digest of key and text, so whoever writes the result runs no Python on whole texts.
    """
    token, chosen = (name_beside(df, c) for c in ("token", "chosen"))
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    with passing(df.sparkSession):
        named = stored(df.filter(worded).select(F.col(key).alias("key"), row_token(key, text, worded).alias("token"),
                                                class_name()(F.col(text)).alias("id")), "jaccard-names")
        _, labels = class_components(df, text, size, percent)
        # a null key is never the smallest unless all keys of the component are null
        first = F.min(F.struct(F.col("key").isNull(), "key", "token"))["token"]
        firsts = checkpointed(named.join(labels, "id", "left").groupBy(F.coalesce("label", "id").alias("component"))
                              .agg(first.alias(token)).select(token, F.lit(True).alias(chosen)))
    # a key that occurs twice in a component leaves one row
    rows = df.withColumn(token, row_token(key, text, worded)).join(firsts, token, "left")
    return rows.filter(F.col(chosen) | ~worded).dropDuplicates([token]).select(*(F.col(f"`{c}`") for c in df.columns))
