"""Hard negatives by anchor spanning-tree bounds.

Scores are integer inner products with anchors. Near anchors are put into one block, and a minimum spanning tree joins
the anchors of a block. The root's scores are exact; for a child at distance e from its parent, a candidate x scores
within the parent's bounds plus or minus e * |x| (Cauchy-Schwarz), and within |anchor| * |x|. Only candidates whose
bounds overlap a window of the child are scored: for positives, the window above the k-th best score of the same label;
for negatives, the windows that each positive's score sets. What has been scored is exact for the grandchildren.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentia.llm.common import checkpointed, ranked, stored

SCALE = 256
#: Anchors of a block (one tree) and candidates of a block; one task holds one of each.
ANCHOR_BLOCK, CANDIDATE_BLOCK = 512, 4_096
#: Anchors that gather those near them into blocks, at most; drawn by hash, the only bounded sample.
LEADERS = 1_024


def integer_rows(df: DataFrame, key: str, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(key, label, v array<long>, dim), each different row once; rows with a null key or label or an unusable vector
    are left out. Inner products are exact while they stay below 2 ** 62."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (df.select(F.col(key).cast("long").alias("key"), label.alias("label"), x.alias("x"))
            .filter(F.col("key").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.coalesce(fine, F.lit(False)))
            .select("key", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("v"), F.size("x").alias("dim"))
            .dropDuplicates(["key", "label", "v"]))


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree of the rows: ``order`` starts with the root and has parents
    first, ``parent`` is -1 for the root, ``edge`` the distance to the parent."""
    n = len(v)
    order, parent, edge = np.zeros(n, dtype=np.int64), np.full(n, -1), np.zeros(n)
    squares = (v * v).sum(axis=1)
    near, by, out = np.full(n, np.inf), np.full(n, -1), np.zeros(n, dtype=bool)
    at = 0
    for i in range(n):
        order[i], out[at] = at, True
        parent[at], edge[at] = by[at], np.sqrt(max(near[at], 0.0)) if i else 0.0
        apart = squares + squares[at] - 2 * (v @ v[at])
        closer = ~out & (apart < near)
        near[closer], by[closer] = apart[closer], at
        at = int(np.where(out, np.inf, near).argmin())
    return order, parent, edge


def anchor_trees(anchors: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """(``anchors`` with anchor (a name of the row), block, node, parent and edge; first and last block of each dimension).

    Blocks are numbered from 0; the driver gets one count for each leader.
    """
    rows = anchors.withColumn("anchor", F.xxhash64("key", "label", "v"))
    n = rows.count()
    wanted = min(LEADERS, -(-n // ANCHOR_BLOCK))
    leaders: dict[int, list] = {}
    for r in rows.orderBy("anchor", "key").limit(wanted).collect():
        leaders.setdefault(r["dim"], []).append(r["v"])
    tables = {d: np.array(v, dtype=np.float64) for d, v in leaders.items()}

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        def of(x: np.ndarray) -> int:
            table = tables.get(len(x))
            return 0 if table is None else int(((table - x) ** 2).sum(axis=1).argmin())

        return pd.Series([of(np.asarray(x, dtype=np.float64)) for x in v], dtype="int32")

    placed = ranked(rows.withColumn("leader", nearest("v")), ["dim", "leader"], [F.col("key"), F.col("anchor")], "place", "of")
    kind = rows.schema["label"].dataType.simpleString()

    def grow(block: pd.DataFrame) -> pd.DataFrame:
        v = np.array(block["v"].tolist(), dtype=np.float64)
        order, parent, edge = spanning_tree(v)
        place = np.empty(len(v) + 1, dtype=np.int64)
        place[order], place[-1] = np.arange(len(v)), -1
        out = block.iloc[order].assign(node=np.arange(len(v)), parent=place[parent[order]], edge=edge[order])
        return out[["key", "label", "v", "dim", "anchor", "block", "node", "parent", "edge"]]

    placed, offsets, spans, blocks = checkpointed(placed), [], {}, 0
    for dim, leader, of in sorted(placed.select("dim", "leader", "of").distinct().collect()):
        offsets.append((dim, leader, blocks))
        blocks += -(-of // ANCHOR_BLOCK)
        spans[dim] = (spans.get(dim, (offsets[-1][2],))[0], blocks - 1)
    first_block = anchors.sparkSession.createDataFrame(offsets, "dim int, leader int, first_block int")
    block = (F.col("first_block") + F.expr(f"place div {ANCHOR_BLOCK}")).cast("int")
    return stored(placed.join(F.broadcast(first_block), ["dim", "leader"]).withColumn("block", block)
                  .drop("leader", "place", "of", "first_block").groupBy("block").applyInPandas(
        grow, f"key long, label {kind}, v array<long>, dim int, anchor long, block int, node int, parent int, "
              "edge double"), "negatives-trees"), spans


class Candidates:
    """A block of candidates and their bounds, walked down an anchor tree."""

    def __init__(self, v: np.ndarray, largest_anchor: float):
        self.v, self.norm = v, np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        # products of doubles are exact below 2 ** 53
        self.exact = self.norm.max(initial=0) * largest_anchor < 2**52
        if self.exact:
            self.v = v.astype(np.float64)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.scored = 0

    def score(self, anchor: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Scores of the candidates in the mask ``wanted``."""
        self.scored += int(wanted.sum())
        anchor = anchor.astype(np.float64) if self.exact else anchor
        if 2 * wanted.sum() > len(wanted):  # one product over all is cheaper than a copy of most
            return (self.v @ anchor)[wanted].astype(np.int64)
        return (self.v[wanted] @ anchor).astype(np.int64)

    def bounds(self, parent: int, edge: float, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = float(np.sqrt((anchor.astype(np.float64) ** 2).sum())) * self.norm
        # room for rounding
        most = most * (1 + 1e-9) + 1e-6
        reach = edge * self.norm * (1 + 1e-9) + 1e-6
        return np.maximum(self.low[parent] - reach, -most), np.minimum(self.high[parent] + reach, most)

    def visit(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, scores: np.ndarray) -> None:
        low[wanted] = high[wanted] = scores
        self.low.append(low)
        self.high.append(high)


def first(scores: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller key."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = places[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
    return places[np.lexsort((keys[places], -scores[places]))[:k]]


def _block(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.array(side["v"].tolist(), dtype=np.int64), side["key"].to_numpy()


def _walk(anchors: pd.DataFrame, candidates: pd.DataFrame):
    """(anchor row, its vector, block of candidates, their keys, whether they have its label, low, high) of each anchor."""
    v, keys = _block(candidates)
    codes, _ = pd.factorize(pd.concat([anchors["label"], candidates["label"]], ignore_index=True))
    anchors = anchors.assign(code=codes[:len(anchors)]).sort_values("node")
    vectors = np.array(anchors["v"].tolist(), dtype=np.int64)
    block = Candidates(v, float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)).max()))
    labels = codes[len(anchors):]
    for row, own in zip(anchors.itertuples(index=False), vectors):
        if row.parent < 0:
            every = np.ones(len(v), dtype=bool)
            low = block.score(own, every).astype(np.float64)
            high = low.copy()
        else:
            low, high = block.bounds(row.parent, row.edge, own)
        yield row, own, block, keys, labels == row.code, low, high


def positives_of_block(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int) -> list[tuple]:
    """(anchor, anchor's key, key, score) of the ``k`` best rows of the anchor's label in the block."""
    out = []
    for row, own, block, keys, same, low, high in _walk(anchors, candidates):
        able = same & (keys != row.key)
        # the window opens at the k-th best lower bound
        some = low[able]
        floor = np.partition(some, len(some) - k)[len(some) - k] if len(some) > k else -np.inf
        wanted = able & (high >= floor)
        scores = block.score(own, wanted)
        best = first(scores, keys[wanted], k)
        out += [(row.anchor, row.key, a, b) for a, b in zip(keys[wanted][best].tolist(), scores[best].tolist())]
        block.visit(low, high, wanted, scores)
    return out


def negatives_of_block(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int, low_percent: int,
                       high_percent: int) -> tuple[list[tuple], int]:
    """(anchor, place of the positive, key, score) of the ``k`` best rows of another label in each window, and the
    number of scores worked out."""
    out = []
    for row, own, block, keys, same, low, high in _walk(anchors, candidates):
        windows = [(p, -(-low_percent * s // 100), high_percent * s // 100) for p, s in enumerate([] if row.scores is None else row.scores)]
        wanted = np.zeros(len(keys), dtype=bool)
        for _, least, most in windows:
            wanted |= (high >= least) & (low <= most)
        wanted &= ~same & (keys != row.key)
        scores, own_keys = block.score(own, wanted), keys[wanted]
        for p, least, most in windows:
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            best = inside[first(scores[inside], own_keys[inside], k)]
            out += [(row.anchor, p, a, b) for a, b in zip(own_keys[best].tolist(), scores[best].tolist())]
        block.visit(low, high, wanted, scores)
    return out, block.scored


def _meet(trees: DataFrame, spans: dict, rows: DataFrame, down: int, fn, kind: str) -> DataFrame:
    """``fn`` over every block of anchors and every block of candidates of the same dimension."""
    left = trees.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    own = F.create_map(*(F.lit(x) for dim, span in spans.items() for x in (dim, list(range(span[0], span[1] + 1)))))
    right = (rows.filter(F.col("dim").isin(list(spans))).withColumn("block", F.explode(own[F.col("dim")]))
             .withColumn("b", F.pmod(F.xxhash64("key"), F.lit(down)).cast("int")))

    def meet(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = fn(anchors, candidates) if len(anchors) and len(candidates) else []
        return pd.DataFrame(found, columns=[c.split()[0] for c in kind.split(", ")]).astype("int64")

    by = ["block", "b"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, kind)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low_percent: int = 50,
         high_percent: int = 95, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``integer_rows``.

    ``is_anchor`` is an expression over ``key``. The positives of an anchor are its ``positives`` best rows with its label and
    another key. For each, rank 1 to ``negatives`` are the best rows of other labels whose score is at least
    ``low_percent`` and at most ``high_percent`` of the positive's; none if the positive's score is negative. Larger scores
    come first, ties go to the smaller key. Rows that differ in label or vector but share a key are rows of their own,
    and a row is no candidate of its own key. Only vectors of the same dimension meet.

    Anchors are a stated query set: blocks of them meet blocks of all rows, a task holds one of each, and no label or key
    is gathered anywhere.
    """
    rows = stored(rows, "negatives-rows")
    trees, spans = anchor_trees(rows.filter(is_anchor))
    spans = spans or {0: (0, 0)}  # no anchors
    down = max(1, -(-rows.count() // candidate_block))
    found = _meet(trees, spans, rows, down, lambda a, c: positives_of_block(a, c, positives),
                  "anchor long, anchor_id long, key long, score long")
    order = [F.col("score").desc(), F.col("key")]
    best = (found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "anchor_id").orderBy(*order)))
            .filter(F.col("rank") <= positives))
    # at most ``positives`` entries
    chosen = stored(best.groupBy("anchor", "anchor_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "key", "score"))).alias("best")), "negatives-positives")
    asked = trees.join(chosen.select("anchor", F.col("anchor_id").alias("key"), F.col("best.score").alias("scores")),
                       ["anchor", "key"], "left")
    near = _meet(asked, spans, rows, down, lambda a, c: negatives_of_block(a, c, negatives, low_percent, high_percent)[0],
                 "anchor long, place long, key long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))
    return (near.withColumn("rank", rank).filter(F.col("rank") <= negatives)
            .join(chosen.select("anchor", "anchor_id", F.posexplode("best").alias("place", "best")), ["anchor", "place"])
            .select("anchor_id", F.col("best.key").alias("positive_id"), "rank", F.col("key").alias("negative_id"),
                    F.col("best.score").alias("positive_score"), F.col("score").alias("negative_score")))
