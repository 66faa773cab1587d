import random

import brute
import numpy as np
import pytest

from retentia.llm import common, graph, jaccard, queries


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = collected(queries.QUERIES["op6_jaccard_join"](spark, sf))
    assert got == brute.jaccard_components(rows, 3, 90)


def near_copies(seed, n, words=60, change=3):
    random.seed(seed)
    base = [f"w{random.randrange(500)}" for _ in range(words)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(random.randrange(change + 1)):
            own[random.randrange(words)] = f"x{random.randrange(50)}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 70)])
def test_near_copies_and_chains(spark, size, percent):
    rows = near_copies(1, 60) + [(k + 100, t) for k, t in near_copies(2, 30, 200, 12)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one two"), (204, "ONE two"), (205, "one"), (206, "É a b c"),
             (207, "é a b c"), (208, "a b c d"), (209, "a b c d")]
    df = spark.createDataFrame(rows, "k long, text string").repartition(5)
    assert collected(jaccard.components(df, "k", "text", size, percent)) == brute.jaccard_components(rows, size, percent)


def test_one_of_each_keeps_all_columns_and_repeated_rows_once(spark):
    rows = [(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"),
            (None, "q r s t u v", "n"), (None, "q r s t u v", "n"), (7, None, "e"), (8, "", "e"), (9, "other text", "o")]
    df = spark.createDataFrame(rows, "k long, text string, class string")
    got = sorted(((r["k"], r["class"]) for r in jaccard.one_of_each(df, "k", "text").collect()), key=str)
    assert got == sorted([(1, "y"), (None, "n"), (7, "e"), (8, "e"), (9, "o")], key=str)


def test_one_of_each_leaves_no_python_to_the_writer_and_no_tables(spark):
    before = list(common._PATHS)
    rows = [(i % 70, t, i) for i, (_, t) in enumerate(near_copies(3, 90) + [(0, f"a{i} b c d e f g") for i in range(600)])]
    rows += [(5, " \t\v\f", 1000 + i) for i in range(40)] + [(5, None, 2000 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, text string, `a.b` int").repartition(5)
    got = jaccard.one_of_each(df, "k", "text")
    assert common._PATHS == before
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == df.columns
    got = [tuple(r) for r in got.collect()]
    # rows of a repeated key may be in several components: each component keeps one row with its smallest key
    named = brute.jaccard_components([(i, t) for i, (_, t, _) in enumerate(rows)], 5, 80)
    groups = {}
    for i, _, first in named:
        groups.setdefault(first, []).append(rows[i])
    assert len(got) == len(groups)
    where = {r: first for first, own in groups.items() for r in own}
    assert len({where[r] for r in got}) == len(groups)
    assert all(r[0] == min(k for k, _, _ in groups[where[r]]) for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, text string")
    assert jaccard.components(df, "k", "text").collect() == []
    assert jaccard.one_of_each(df, "k", "text").collect() == []


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m in ((10, 10), (300, 280), (50, 2000)):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[:n // 2], rng.integers(0, 2**63, m).astype(np.uint64)])
        assert jaccard.least_difference(jaccard.bitmap(a), jaccard.bitmap(b)) <= len(np.setxor1d(a, b))


def test_connected_follows_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (7, 3)]
    got = dict(map(tuple, graph.connected(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_word_hashes_tell_words_apart_wherever_they_stand():
    own = [b"a", b"b", b"ab", b"ba", b"a" * 64, b"a" * 65, b"a" * 66, b"a" * 64 + b"b", b"b" * 300, b"\x00", b"\x00\x00"]
    alone = [int(jaccard.word_hashes([w])[0]) for w in own]
    assert len(set(alone)) == len(own)
    assert jaccard.word_hashes(own).tolist() == alone
    assert jaccard.word_hashes(own[::-1]).tolist() == alone[::-1]
    assert len(jaccard.word_hashes([])) == 0


def test_regions_are_dealt_once_and_passed_rounds_leave_no_files(spark, monkeypatch):
    """The rows of the first round move by their shingle once to be counted and once to get their pivot."""
    from retentia.llm import common

    plans = {}

    def kept(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return common.stored(df, name)

    monkeypatch.setattr(jaccard, "stored", kept)
    common.release(spark)
    rows = near_copies(3, 80) + [(k + 100, t) for k, t in near_copies(4, 40, 200, 30)]
    sizes, labels = jaccard.class_components(spark.createDataFrame(rows, "k long, text string"), "text")
    assert plans["jaccard-members"].count("hashpartitioning(sig") == 2
    assert "hashpartitioning(sig" not in plans["jaccard-pairs"]
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._PATHS}
    assert not left & {"llm-jaccard-pairs", "llm-jaccard-needed", "llm-jaccard-bits", "llm-jaccard-bounds", "llm-jaccard-pivots"}
    assert labels.count() and sizes.count() == len({t for _, t in rows})


def test_sets_are_built_from_wanted_texts_without_naming_all(spark):
    rows = [("A b c d",), ("a B c d",), ("e f g",), ("h i",), (None,), ("e f g",)]
    df = spark.createDataFrame(rows, "text string")
    described = jaccard.classes(df.coalesce(1), "text", 3, 90)
    wanted = described.filter("n > 1 or hex(sample) = upper(md5('e f g'))").select("id", "sample")
    got = jaccard.sets_of(df, "text", 3, wanted)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    names = {jaccard.digest(jaccard.words(t)): jaccard.words(t) for t in ("a b c d", "e f g")}
    assert {bytes(r["id"]): sorted(r["items"]) for r in got.collect()} == {
        k: sorted(jaccard.shingles(common.word_hashes(w), 3).view(np.int64).tolist()) for k, w in names.items()}
