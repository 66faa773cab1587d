"""Prefix tries of conversations as balanced parentheses.

A node is a sequence of first turns. Its name is 128 bits, made of the turns' hashes and places, so equal beginnings
have equal names wherever they are worked out, and the path of a conversation is the names of its beginnings, one after
another. Different paths are sorted and cut into shards. A shard writes its trie as parentheses, one pair a node in depth
first order, with the least excess of every block of 64 parentheses in a range min-max tree:

* ``find_close`` delimits a subtree, so sums over it are differences of cumulative arrays over the nodes;
* ``rank`` counts the leaf pairs "()" inside it.

Only the first and the last path of a shard can go on in another shard. Their nodes, the spines, are summed over the
shards by name; all other nodes are done. Texts never travel: a turn is two hashes and a size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import stored

#: Turns of one shard, and parentheses of one block.
SHARD_TURNS, BLOCK = 100_000, 64
#: Ids of one piece of an end list are those with equal id >> PIECE_BITS.
PIECE_BITS = 10
NAME = 16
_U = np.uint64


class Parentheses:
    """A balanced sequence of parentheses (True opens) with excess summaries by block."""

    def __init__(self, opens: np.ndarray):
        self.n = len(opens)
        blocks = max(1, -(-self.n // BLOCK))
        padded = np.zeros(blocks * BLOCK, dtype=bool)
        padded[:self.n] = opens
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        # opening pairs "()": an open followed by a close
        pairs = padded & ~np.r_[padded[1:], False]
        self.pair_words = np.packbits(pairs, bitorder="little").view(np.uint64)
        self.rank_before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]
        self.pairs_before = np.r_[0, np.cumsum(np.bitwise_count(self.pair_words).astype(np.int64))]
        steps = np.where(padded, 1, -1).astype(np.int8).reshape(blocks, BLOCK)
        # least excess inside a block; the padding closes too much, so it only adds candidates
        inside = np.cumsum(steps, axis=1, dtype=np.int16)
        before = 2 * self.rank_before[:-1] - BLOCK * np.arange(blocks)
        width = 1 << (blocks - 1).bit_length() if blocks > 1 else 1
        level = np.full(width, np.iinfo(np.int64).max)
        level[:blocks] = before + inside.min(axis=1)
        self.levels = [level]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))

    def _count(self, words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        block, bit = np.divmod(i, BLOCK)
        inside = words[np.minimum(block, len(words) - 1)] & ((_U(1) << bit.astype(np.uint64)) - _U(1))
        return before[block] + np.where(bit > 0, np.bitwise_count(inside), 0)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Opening parentheses before each place."""
        return self._count(self.words, self.rank_before, i)

    def leaf_pairs(self, i: np.ndarray) -> np.ndarray:
        """Pairs "()" that start before each place."""
        return self._count(self.pair_words, self.pairs_before, i)

    def excess(self, i: np.ndarray) -> np.ndarray:
        """Unclosed parentheses before each place."""
        return 2 * self.rank(i) - i

    def opens(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i // BLOCK] >> (i % BLOCK).astype(np.uint64) & _U(1)).astype(bool)

    def _scan(self, at: np.ndarray, excess: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place from ``at`` to the end of its block after which the excess is ``target``; -1 without one."""
        found = np.full(len(at), -1)
        left, at, excess = np.arange(len(at)), at.copy(), excess.copy()
        while len(left):
            excess += np.where(self.opens(at), 1, -1)
            hit = excess == target[left]
            found[left[hit]] = at[hit]
            at += 1
            go_on = ~hit & (at % BLOCK != 0) & (at < self.n)
            left, at, excess = left[go_on], at[go_on], excess[go_on]
        return found

    def find_close(self, i: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one at ``i``."""
        target = self.excess(i)
        close = self._scan(i, target, target)
        left = np.flatnonzero(close < 0)
        # up the tree from the own block until a later subtree goes as low as the target, then down to its first block
        node, level, goal = i[left] // BLOCK, np.zeros(len(left), dtype=np.int64), target[left]
        block = np.full(len(left), -1)
        climbing = np.ones(len(left), dtype=bool)
        for depth, mins in enumerate(self.levels):
            here = np.flatnonzero(climbing)
            if not len(here):
                break
            beside = node[here] + 1
            right = (node[here] % 2 == 0) & (beside < len(mins))
            low = right & (mins[np.minimum(beside, len(mins) - 1)] <= goal[here])
            stop = here[low]
            climbing[stop], block[stop], level[stop] = False, beside[low], depth
            node[here] //= 2
        for depth in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(level == depth)
            child = 2 * block[down]
            block[down] = np.where(self.levels[depth - 1][child] <= goal[down], child, child + 1)
            level[down] = depth - 1
        at = block * BLOCK
        close[left] = self._scan(at, self.excess(at), goal)
        return close


def turn_lists(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """(conv, turns array<struct<turn, a, b, size>>): one row a conversation, its turns in order, null turns first.

    Null roles and texts are empty. Turns of equal number come in the order of their hashes. Rows without a
    conversation are left out; repeated rows are turns of their own. ``conv`` is an integer.
    """
    kept = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    one = F.struct(F.col(turn).alias("turn"), *(F.xxhash64(F.lit(seed), *kept).alias(n) for seed, n in ((17, "a"), (31, "b"))),
                   F.octet_length(kept[1]).cast("long").alias("size"))
    return (df.filter(F.col(conv).isNotNull()).groupBy(F.col(conv).cast("long").alias("conv"))
            .agg(F.sort_array(F.collect_list(one)).alias("turns")))


def path_names(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The names (two numbers) of every beginning of the concatenated conversations of these lengths.

    Turn hashes are mixed with their place and joined by exclusive or, so a beginning's name takes one step from the
    one before.
    """
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(a)) - np.repeat(starts, lengths)
    out = np.empty((len(a), 2), dtype=np.uint64)
    for i, h in enumerate((a, b)):
        z = h.view(np.uint64) + (place.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
        z = (z ^ z >> _U(30)) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ z >> _U(27)) * _U(0x94D049BB133111EB)
        z = np.bitwise_xor.accumulate(z ^ z >> _U(31))
        before = np.r_[_U(0), z][starts]
        out[:, i] = z ^ np.repeat(before, lengths)
    return out


def paths(lists: DataFrame) -> DataFrame:
    """(conv, path, sizes): the names of all beginnings and the sizes of the turns, both as bytes."""

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["a"].map(len).to_numpy()
            a, b = (np.concatenate([np.empty(0, np.int64), *batch[c]]).astype(np.int64) for c in "ab")
            names = path_names(a, b, lengths).astype(">u8")
            cuts = np.cumsum(lengths)
            yield pd.DataFrame({
                "conv": batch["conv"], "path": [names[e - n:e].tobytes() for e, n in zip(cuts, lengths)],
                "sizes": [np.asarray(s, dtype=np.int64).tobytes() for s in batch["sizes"]]})

    columns = [F.col(f"turns.{f}").alias(n) for f, n in (("a", "a"), ("b", "b"), ("size", "sizes"))]
    return lists.select("conv", *columns).mapInPandas(name, "conv long, path binary, sizes binary")


class Shard:
    """The trie of a shard's sorted paths; node 0 is the root."""

    def __init__(self):
        self.names, self.sizes = [np.zeros((1, 2), dtype=">u8")], [np.zeros(1, dtype=np.int64)]
        self.parents, self.depths = [np.array([-1])], [np.array([0])]
        self.runs: list[tuple[int, int]] = [(0, 1)]  # closes, then opens
        self.ends: list[tuple[int, int, int]] = []  # node, copies, smallest conversation
        self.stack, self.last, self.n = np.array([0]), np.empty((0, 2), dtype=">u8"), 1
        self.first_path = None

    def add(self, path: bytes, sizes: bytes, copies: int, conv: int) -> None:
        own = np.frombuffer(path, dtype=">u8").reshape(-1, 2)
        m = min(len(own), len(self.last))
        differ = np.flatnonzero((own[:m] != self.last[:m]).any(axis=1))
        shared = int(differ[0]) if len(differ) else m
        new = len(own) - shared
        self.runs.append((len(self.last) - shared, new))
        fresh = np.arange(self.n, self.n + new)
        self.names.append(own[shared:])
        self.sizes.append(np.frombuffer(sizes, dtype=np.int64)[shared:])
        self.parents.append(np.r_[self.stack[shared], fresh[:-1]] if new else fresh)
        self.depths.append(np.arange(shared + 1, len(own) + 1))
        self.stack, self.last, self.n = np.r_[self.stack[:shared + 1], fresh], own, self.n + new
        self.ends.append((int(self.stack[-1]), copies, conv))
        if self.first_path is None:
            self.first_path = self.stack

    def rows(self, shard: int) -> pd.DataFrame:
        """One row a node. On the spines the sums leave out what other shards may add to: saved tokens of spine nodes and
        spine nodes without children."""
        self.runs.append((len(self.last) + 1, 0))
        shape = np.array(self.runs).ravel()
        bits = Parentheses(np.repeat(np.tile([False, True], len(self.runs)), shape))
        places = np.repeat(np.cumsum(shape)[1::2] - shape[1::2], shape[1::2])
        opened = shape[1::2]
        places += np.arange(self.n) - np.repeat(np.cumsum(opened) - opened, opened)
        sizes, parents, depths = (np.concatenate(x) for x in (self.sizes, self.parents, self.depths))
        close = bits.find_close(places)
        nodes = np.arange(self.n)
        after = nodes + (close - places + 1) // 2  # the subtree's nodes are nodes[i:after[i]]
        spine = np.zeros(self.n, dtype=bool)
        spine[self.first_path], spine[self.stack] = True, True
        within = lambda own: (lambda c: c[after] - c[nodes])(np.r_[0, np.cumsum(own)])
        copies, least = np.zeros(self.n, dtype=np.int64), np.full(self.n, np.iinfo(np.int64).max)
        for node, n, conv in self.ends:
            copies[node], least[node] = n, conv
        n_convs = within(copies)
        by_depth = np.argsort(depths, kind="stable")
        level_ends = np.cumsum(np.bincount(depths))
        for d in range(len(level_ends) - 1, 0, -1):
            level = by_depth[level_ends[d - 1]:level_ends[d]]
            np.minimum.at(least, parents[level], least[level])
        childless = bits.leaf_pairs(places + 1) > bits.leaf_pairs(places)
        names = np.concatenate(self.names).astype(">u8").tobytes()
        named = [names[NAME * i:NAME * i + NAME] for i in range(self.n)]
        named[0] = b""
        inner = spine[np.maximum(parents, 0)]
        known = ~spine & ~inner
        return pd.DataFrame({
            "shard": shard, "spine": spine, "name": named,
            "parent": [named[p] if p >= 0 and i else None for p, i in zip(parents.tolist(), inner)],
            "depth": depths, "bytes": sizes, "conv": least,
            "parent_conv": pd.array(np.where(known, least[np.maximum(parents, 0)], 0), dtype="Int64").copy(),
            "known": known, "n_convs": n_convs, "n_children": np.bincount(parents[1:], minlength=self.n),
            "n_leaves": bits.leaf_pairs(close + 1) - bits.leaf_pairs(places) - within(childless & spine),
            "saved": within(np.where(spine, 0, (n_convs - 1) * sizes))})


_ROW = ("shard int, spine boolean, name binary, parent binary, depth long, bytes long, conv long, parent_conv long, "
        "known boolean, n_convs long, n_children long, n_leaves long, saved long")


def encoded(different: DataFrame, shards: int) -> DataFrame:
    """The nodes of every shard (path, sizes, copies, conv), cut from the sorted order of the paths."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Shard()
        for batch in batches:
            for row in zip(*(batch[c] for c in ("path", "sizes", "copies", "conv"))):
                shard.add(*row)
        if shard.first_path is not None:
            out = shard.rows(TaskContext.get().partitionId())
            for at in range(0, len(out), 50_000):
                yield out.iloc[at:at + 50_000]

    return (different.repartitionByRange(shards, "path").sortWithinPartitions("path")
            .select("path", "sizes", "copies", "conv").mapInPandas(encode, _ROW))


def along_spines(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of ``own`` and ``leaf`` over each spine node of a shard and the spine nodes below it."""
    rows = rows.sort_values("depth", ascending=False)
    total = {n: [a, b] for n, a, b in zip(rows["name"], rows["own"], rows["leaf"])}
    for name, parent in zip(rows["name"], rows["parent"]):
        if parent is not None:
            above, below = total[parent], total[name]
            above[0] += below[0]
            above[1] += below[1]
    return pd.DataFrame({"name": list(total), "own": [v[0] for v in total.values()],
                         "leaf": [v[1] for v in total.values()]})


def merged_spines(spine: DataFrame) -> DataFrame:
    """One row for each spine node from its parts (the columns of ``encoded``), with all sums complete."""
    whole = spine.groupBy("name", "parent", "depth", "bytes").agg(
        F.min("conv").alias("conv"), F.min("shard").alias("home"), F.count(F.lit(1)).alias("parts"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")))
    # a child that several shards have was counted in each
    again = whole.groupBy(F.col("parent").alias("name")).agg(F.sum(F.col("parts") - 1).alias("again"))
    whole = stored(whole.join(again, "name", "left").withColumn("n_children", F.col("n_children") - F.coalesce("again", F.lit(0)))
                   .withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
                   .withColumn("leaf", (F.col("n_children") == 0).cast("long")).drop("again"), "tries-spines")
    # a spine node adds to the nodes above it once, in its first shard
    home = F.col("home") == F.col("shard")
    parts = spine.select("shard", "name", "parent", "depth").join(whole.select("name", "home", "own", "leaf"), "name").select(
        "shard", "name", "parent", "depth", *(F.when(home, F.col(c)).otherwise(0).alias(c) for c in ("own", "leaf")))
    below = parts.groupBy("shard").applyInPandas(along_spines, "name binary, own long, leaf long")
    below = below.groupBy("name").agg(F.sum("own").alias("more"), F.sum("leaf").alias("leaves"))
    return stored(whole.join(below, "name").select(
        "name", "parent", "depth", "conv", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("more")).alias("saved")), "tries-merged")


def end_digests(ends: DataFrame) -> DataFrame:
    """(name, sha): SHA-256 of the ascending ids ``conv`` at each ``name``, joined by commas.

    Ids are put together in pieces of ``1 << PIECE_BITS`` consecutive numbers; a task hashes the pieces of a name one
    after another and never holds the list.
    """
    pieces = (ends.groupBy("name", F.shiftright("conv", PIECE_BITS).alias("piece"))
              .agg(F.sort_array(F.collect_list("conv")).alias("ids"))
              .select("name", "piece", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, sha = None, None
        for batch in batches:
            done = []
            for own, ids in zip(batch["name"], batch["ids"]):
                if sha is not None and own == name:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    done.append((name, sha.hexdigest()))
                name, sha = own, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=["name", "sha"])
        if sha is not None:
            yield pd.DataFrame({"name": [name], "sha": [sha.hexdigest()]})

    return pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids").mapInPandas(
        digest, "name binary, sha string")


def prefix_trie(lists: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node of the trie of ``turn_lists``: (name, conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256).

    ``conv_id`` is the smallest conversation that starts with the node's turns, ``n_convs`` their number. ``n_leaves`` and
    ``saved_tokens`` are sums over the subtree, the node included: of nodes without children, and of (n_convs - 1)
    times the size of the node's last turn. ``ends_sha256`` is the digest of the ids of the conversations that end
    here. The root has depth 0, an empty name and a null parent. No conversations, no rows.

    Equal conversations are summed before they are sorted, so copies cost one path. A conversation is one row of 40
    bytes a turn.
    """
    named = stored(paths(lists), "tries-paths")
    different = stored(named.groupBy("path", "sizes").agg(F.count(F.lit(1)).alias("copies"), F.min("conv").alias("conv")),
                       "tries-different")
    turns = different.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    nodes = stored(encoded(different, 1 + turns // (NAME * shard_turns)), "tries-nodes")
    spine = nodes.filter("spine")
    whole = merged_spines(spine)
    # nodes under a spine get their parent's smallest conversation by shard, so the root's children spread
    over = spine.select("shard", "name").join(whole.select("name", "conv"), "name").select(
        "shard", F.col("name").alias("parent"), F.col("conv").alias("over"))
    inner = nodes.filter("not spine")
    values = ["name", "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved"]
    done = inner.filter("known").select(values).unionByName(
        inner.filter("not known").join(over, ["shard", "parent"]).withColumn("parent_conv", F.col("over")).select(values))
    above = whole.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
    done = done.unionByName(whole.join(above, "parent", "left").select(values))
    end = F.when(F.octet_length("path") == 0, F.col("path")).otherwise(F.expr(f"substring(path, -{NAME}, {NAME})"))
    digests = end_digests(named.select(end.alias("name"), "conv"))
    return done.join(digests, "name", "left").select(
        "name", F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
