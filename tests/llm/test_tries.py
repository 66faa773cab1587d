import hashlib
import random
import zlib

import numpy as np
import oracle
import pytest

from retentia.llm import queries, tries


def brute_trie(conversations):
    """Rows of the trie of {conv: [(role, text), ...]} by prefix dictionaries."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for name, convs in members.items():
        below = [n for n in members if n[:len(name)] == name]
        children = [n for n in below if len(n) == len(name) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        ends = ",".join(str(c) for c in sorted(convs) if len(conversations[c]) == len(name))
        out.append((min(convs), len(name), min(members[name[:-1]]) if name else None, len(convs), len(children), len(leaves),
                    sum((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0 for n in below),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_grafted(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = conversations.get(c - c % 5, [])[:h] + turns[h:]
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def collected(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def frame(spark, conversations):
    rows = [(c, t, role, text) for c, turns in conversations.items() for t, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_query_equals_sql_and_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_prefix_trie"](spark, sf_dir)
    sql = queries.ORACLES["op12_prefix_trie"]
    assert oracle.compare(spark, oracle.connect(sf_dir), "op12", lambda *_: got, sql, sf_dir) is None
    own = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert collected(got) == brute_trie(brute_grafted(own))


@pytest.mark.parametrize("shard_turns", [3, 20, 100_000])
def test_spines_over_many_shards(spark, shard_turns):
    random.seed(shard_turns)
    own = {c: [("u", random.choice(["", "a", "b", "été"])) for _ in range(random.randrange(7))] for c in range(-20, 160)}
    own[500], own[501] = [("u", "z")] * 90, [("u", "z")] * 91
    lists = tries.turn_lists(frame(spark, own))
    own = {c: turns for c, turns in own.items() if turns}
    assert collected(tries.prefix_trie(lists, shard_turns)) == brute_trie(own)


def test_turnless_conversations_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, "u", "x"), (1, 3, None, None), (1, 3, None, None), (2, -4, "u", "x"), (None, 0, "u", "lost"),
            (2, 9, "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for c in ("name", "turns", "conv", "path", "depth"):
        df = df.selectExpr("*", f"'mine' as {c}")
    want = {1: [("u", "x"), ("", ""), ("", "")], 2: [("u", "x"), ("", "")]}
    assert collected(tries.prefix_trie(tries.turn_lists(df))) == brute_trie(want)
    assert tries.prefix_trie(tries.turn_lists(df.limit(0))).collect() == []
    # 6 is grafted onto 5, which is absent, so it loses its first turns
    grafted = queries.grafted(tries.turn_lists(frame(spark, {6: [("u", "a")], 7: [("u", "b")] * 12})))
    assert collected(tries.prefix_trie(grafted)) == brute_trie(brute_grafted({6: [("u", "a")], 7: [("u", "b")] * 12}))


def test_digest_of_a_long_list_of_ends(spark):
    conversations = {c: [("u", "same")] for c in [*range(-5, 3000), 10**12]}
    got = {r["depth"]: r for r in tries.prefix_trie(tries.turn_lists(frame(spark, conversations))).collect()}
    ids = ",".join(map(str, sorted(conversations)))
    assert got[1]["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and got[1]["n_convs"] == len(conversations)


@pytest.mark.parametrize("n", [1, 31, 32, 33, 700, 5000])
@pytest.mark.parametrize("up", [0.5, 0.95])
def test_find_close_and_ranks(n, up):
    draw = np.random.default_rng(n)
    bits, depth, left = [], 0, n
    while left or depth:
        opens = left > 0 and (depth == 0 or draw.random() < up)
        bits.append(opens)
        depth, left = depth + (1 if opens else -1), left - opens
    bits = np.array(bits)
    tree, stack, close = tries.Parentheses(bits), [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    places = np.flatnonzero(bits)
    assert tree.find_close(places).tolist() == [close[i] for i in places.tolist()]
    ends = np.arange(len(bits) + 1)
    assert tree.rank(ends).tolist() == np.r_[0, np.cumsum(bits)].tolist()
    pairs = bits & ~np.r_[bits[1:], False]
    assert tree.leaf_pairs(ends).tolist() == np.r_[0, np.cumsum(pairs)].tolist()
