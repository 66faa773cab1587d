import random

import brute
import numpy as np
import pytest

from retentia.llm import common, queries, substrings


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def digest_rows(df, key="doc_id"):
    return collected(df.select(key, "n_words", "n_removed", "kept_sha256"))


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert collected(queries.QUERIES["op9_repeated_phrases"](spark, sf_dir)) == brute.repeated(rows, 20)


def test_shared_passages_self_overlap_and_edges(spark):
    random.seed(3)
    word = lambda: f"w{random.randrange(40)}"
    passage = [word() for _ in range(45)]
    rows = []
    for i in range(40):
        own = [word() for _ in range(random.randrange(60))]
        at = random.randrange(len(own) + 1)
        cut = sorted(random.sample(range(46), 2))
        rows.append((i, " ".join(own[:at] + passage[cut[0]:cut[1]] + own[at:])))
    rows += [(50, "a " * 100), (51, "a " * 19), (52, "a " * 20), (53, None), (54, ""), (55, rows[3][1]),
             (56, "x y " * 30 + " ".join(passage)), (57, "É é " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert digest_rows(substrings.repeated(df, "doc_id", "text")) == brute.repeated(rows, 20)


def test_spans_rebuild_the_kept_text(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, "head " + text + " tail"), (None, "a b " + text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.repeated(df, "doc_id", "text").collect()}
    assert got[1]["spans"] == [] and got[2]["spans"] == [[1, 31]] and got[2]["text"] == "head tail"
    assert got[None]["text"] == "a b"


def test_repeated_rows_count_once_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert [r[2] for r in digest_rows(substrings.repeated(df, "doc_id", "text"))] == [0, 0, 25]
    assert substrings.repeated(df.limit(0), "doc_id", "text").collect() == []


def test_words_are_hashed_side_by_side(monkeypatch):
    """Only words longer than ``LONG`` bytes are hashed one by one; pieces and neighbours change no hash."""
    one_by_one = []
    hashed = common.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(common.xxhash, "xxh3_64_intdigest", lambda w: one_by_one.append(w) or hashed(w))
    own = [b"w%d" % i for i in range(3000)] + [b"x" * 64, b"x" * 65, b"x" * 66, b"x" * 100_000, b"y" * 100_000, b"w7"]
    whole = substrings.Lot([((1, 0), own)], 20).hashes
    assert one_by_one == [b"x" * 65, b"x" * 66, b"x" * 100_000, b"y" * 100_000]
    assert len(np.unique(whole)) == len(own) - 1 and whole[7] == whole[-1]
    monkeypatch.setattr(substrings, "LOT_WORDS", 100)
    assert (substrings.hashes_of(own) == whole).all() and not len(substrings.hashes_of([]))
