import random

import brute
import numpy as np
import pytest

from retentia.llm import decontamination as dc
from retentia.llm import queries


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["edits"]
           for r in queries.QUERIES["op7_benchmark_matches"](spark, sf).collect()}
    assert got == brute.edit_matches(docs, items, dc.SIMILARITY, dc.words)


def edited(item, edits, rng, filler):
    own = list(item)
    for _ in range(edits):
        at = rng.randrange(len(own))
        kind = rng.randrange(3)
        if kind == 0:
            own[at] = rng.choice(filler)
        elif kind == 1:
            del own[at]
        else:
            own.insert(at, rng.choice(filler))
    return own


def test_recall_of_edited_passages():
    rng = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    items = [(i, [rng.choice(common) if rng.random() < 0.5 else f"t{i}x{j}" for j in range(rng.randrange(15, 60))])
             for i in range(30)]
    texts, planted = [], []
    for n in range(600):
        item, words = rng.choice(items)
        edits = rng.randrange(int(len(words) * 0.2) + 1)
        texts.append(" ".join(rng.choices(common, k=20) + edited(words, edits, rng, common) + rng.choices(common, k=20)))
        planted.append(item)
    held = dc.Items([(i, " ".join(w)) for i, w in items])
    found = [{m[0] for m in hits} for hits in dc.search(held, texts)]
    recall = np.mean([p in f for p, f in zip(planted, found)])
    assert recall >= 0.95
    exact = brute.edit_matches(list(enumerate(texts[:40])), [(i, " ".join(w)) for i, w in items], dc.SIMILARITY, dc.words)
    got = {(k, m[0]) for k, hits in enumerate(dc.search(held, texts[:40])) for m in hits}
    assert got <= set(exact)


@pytest.mark.parametrize("length", [15, 60, 150, 300, 600])
def test_recall_at_the_most_edits(length):
    """Passages of which 20 % of the words are changed, dropped or preceded by another."""
    rng = random.Random(length)
    common = [f"c{i}" for i in range(30)]
    items = [(i, [f"t{i}x{j}" if rng.random() < 0.5 else rng.choice(common) for j in range(length)]) for i in range(12)]
    texts = [" ".join(rng.choices(common, k=9) + edited(w, int(length * 0.2), rng, common) + rng.choices(common, k=9))
             for _, w in items * 12]
    held = dc.Items([(i, " ".join(w)) for i, w in items])
    found = [{m[0] for m in hits} for hits in dc.search(held, texts)]
    assert np.mean([i in f for (i, _), f in zip(items * 12, found)]) >= 0.95


def test_items_in_blocks(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, dc.benchmark_matches(docs, items).collect()))
    kept = sorted(r["doc_id"] for r in dc.decontaminated(docs, items).collect())
    monkeypatch.setattr(dc.item_blocks, "__defaults__", (2_500,))
    assert len(list(dc.item_blocks(items, "item_id", "text"))) > 2
    assert sorted(map(tuple, dc.benchmark_matches(docs, items).collect())) == want
    assert sorted(r["doc_id"] for r in dc.decontaminated(docs, items).collect()) == kept


def test_nulls_empty_short_and_repeated(spark):
    docs = [(1, "the quick brown fox jumps"), (2, None), (3, ""), (None, "QUICK, brown fox"), (5, "nothing here"),
            (5, "nothing here"), (6, "quick brown")]
    items = [(1, "quick brown fox"), (2, None), (3, "!!"), (4, "quick brown fox")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["first_word"]) for r in dc.benchmark_matches(df, it).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 4, 1), (None, 1, 0), (None, 4, 0)], key=str)
    kept = [r["doc_id"] for r in dc.decontaminated(df, it).collect()]
    assert sorted(kept) == [2, 3, 5, 5, 6]
    assert dc.benchmark_matches(df, it.limit(0)).collect() == []
    assert dc.decontaminated(df.limit(0), it).collect() == []
    assert dc.decontaminated(df, it.limit(0)).count() == 7
