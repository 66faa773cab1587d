import numpy as np
import oracle
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retentia.llm import negatives, queries


def brute(rows, is_anchor, positives=5, negatives=3):
    out = []
    for key, label, v in rows:
        if not is_anchor(key):
            continue
        scored = sorted((-int(v @ w), k, own) for k, own, w in rows if k != key and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(n, k) for n, k, own in scored if own != label and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(key, p, i, k, -s, -n) for i, (n, k) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(n, seed=5, dim=8, clusters=40):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 1, (clusters, dim))
    v = np.floor(256 * (centres[draw.integers(0, clusters, n)] + draw.normal(0, 0.02, (n, dim)))).astype(np.int64)
    return [(i, int(c), x) for i, c, x in zip(range(n), draw.integers(0, 3, n), v)]


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_equals_sql(spark, sf_dir):
    name = "op11_tree_bound_negatives"
    assert oracle.compare(spark, oracle.connect(sf_dir), name, queries.QUERIES[name], queries.ORACLES[name], sf_dir) is None


def test_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 7)
    rows = clustered(400)
    rows += [(1000 + i, 1, rows[3][2]) for i in range(30)]  # a group of equal vectors
    rows += [(2000, 0, np.arange(3)), (2001, 1, np.arange(3)), (2002, 0, np.arange(3) + 1)]  # another dimension
    df = spark.createDataFrame([(k, c, v.tolist()) for k, c, v in rows], "key long, label int, v array<long>")
    df = df.withColumn("dim", F.size("v"))
    got = negatives.mine(df, F.col("key") % 10 == 0, candidate_block=60)
    assert collected(got) == brute(rows, lambda k: k % 10 == 0)


def test_bounds_leave_candidates_out():
    rows = pd.DataFrame(clustered(2000), columns=["key", "label", "v"]).assign(dim=8)
    anchors = rows[rows["key"] % 10 == 0]
    order, parent, edge = negatives.spanning_tree(np.array(anchors["v"].tolist(), dtype=float))
    place = np.empty(len(order) + 1, dtype=int)
    place[order], place[-1] = np.arange(len(order)), -1
    scores = [np.array([10**5]) for _ in order]
    tree = anchors.iloc[order].assign(node=range(len(order)), parent=place[parent[order]], edge=edge[order], anchor=0,
                                      scores=scores)
    found, scored = negatives.negatives_of_block(tree, rows, 3, 50, 95)
    # beyond the root's own scores less than half of the rows of other labels are scored
    assert scored < len(rows) + 0.5 * sum((rows["label"] != c).sum() for c in anchors["label"])
    v, keys = np.array(rows["v"].tolist()), rows["key"].to_numpy()
    at = 0
    for _, row in tree.iterrows():
        s = v @ row["v"]
        inside = np.flatnonzero((s >= 50_000) & (s <= 95_000) & (rows["label"] != row["label"]).to_numpy())
        best = sorted((-int(s[i]), int(keys[i])) for i in inside)[:3]
        assert [(k, s) for _, _, k, s in found[at:at + len(best)]] == [(k, -n) for n, k in best]
        at += len(best)
    assert at == len(found)


def test_unusable_rows_repeated_rows_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.9]), (1, 1, [1.0, 0.9]), (2, 0, [0.9, 0.9]), (3, 0, [nan, 1.0]),
            (4, 0, [1.0, inf]), (5, 0, [None, 1.0]), (6, 0, None), (7, None, [1.0, 1.0]), (None, 0, [0.9, 0.9]), (8, 0, [])]
    df = spark.createDataFrame(rows, "vec_id long, kind int, v array<double>").withColumn("dim", F.lit("mine"))
    usable = negatives.integer_rows(df, "vec_id", "v", F.col("kind"))
    assert sorted(r["key"] for r in usable.collect()) == [0, 1, 2]
    assert collected(negatives.mine(usable, F.col("key") == 0)) == [(0, 1, 1, 2, 256 * 256 + 256 * 230, 2 * 256 * 230)]
    assert negatives.mine(usable.limit(0), F.col("key") == 0).collect() == []
    assert negatives.mine(usable, F.col("key") == 99).collect() == []
