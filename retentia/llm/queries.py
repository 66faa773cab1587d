"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.llm import (decontamination, jaccard, languages, mixing, negatives, secrets, sharding, substrings, surrogates,
                          tokens, topk, toxicity, tries)
from retentia.llm.common import checkpointed, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = checkpointed(table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32")))
    dims = [d if d.name != "size" else sharding.Dimension("size", F.col("size"), "log")
            for d in sharding.document_dimensions()]
    rows = sharding.hilbert_shards(docs, dims, [F.col("doc_id"), F.col("text_crc32")], shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = mixing.pfair_mix(docs, F.col("source"), [F.col("doc_id")])
    return mixed.select("doc_id", "source", "stream", "share", "cycle", "block", "epoch", "slot", "position")


@query
def op3_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set ``retentia.surrogate.secret`` for surrogates that last; without it the session draws a key of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    secret = spark.conf.get("retentia.surrogate.secret", None)
    if not secret:
        secret = token_hex(32)
        spark.conf.set("retentia.surrogate.secret", secret)
    return surrogates.pseudonymised(docs, "text", secret).withColumn("n_entities", F.size("entities"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = tokens.count_bytes_and_tokens(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.scan(docs, "text", F.col("source"))
    # the digest names a candidate without showing it
    return found.select("doc_id", "place", F.sha2("candidate", 256).alias("candidate_sha256"), "probability",
                        "is_secret")


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.components(docs, "doc_id", "text", size=3, percent=90)


@query
def op7_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.benchmark_matches(docs, table(spark, sf_dir, "benchmark"))


@query
def op8_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), "vec_id", "embedding", k=5)


@query
def op9_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.repeated(docs, "doc_id", "text", window=20).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def may_train(key: str):
    """Rows whose labels may be learnt from; the others are held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2


@query
def op10_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), may_train("doc_id"))
    scored = docs.withColumn("score", toxicity.score(model)("text"))
    return scored.select("doc_id", F.coalesce(~may_train("doc_id"), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op11_tree_bound_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.integer_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return negatives.mine(rows, F.col("key") % 50 == 0)


def grafted(lists: DataFrame) -> DataFrame:
    """Each conversation's first h turns replaced by those of the conversation its number is rounded down to."""
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")
    heads = lists.filter(F.col("conv") % 5 == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, 8).alias("head"))
    both = lists.withColumn("base", F.col("conv") - F.col("conv") % 5).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return both.select("conv", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(0)))).alias("turns"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tries.turn_lists(table(spark, sf_dir, "conversations"))
    return tries.prefix_trie(grafted(lists)).drop("name")


def may_learn_language(key: str):
    """Rows whose language may be learnt from; the others are held out. Null keys count as held in, but teach nothing."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 != 1


@query
def op13_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = languages.predict(languages.train(docs, may_learn_language("doc_id")))
    return docs.withColumn("found", found("text")).select(
        "doc_id", F.coalesce(~may_learn_language("doc_id"), F.lit(False)).alias("held_out"),
        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


ORACLES["op8_pivot_top_k"] = """
WITH v AS (
    SELECT vec_id, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS q, len(embedding) AS dim
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
           CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, a.dim + 1)]) AS BIGINT) AS score
    FROM v a JOIN v b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

ORACLES["op11_tree_bound_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, len(embedding) AS dim,
           [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
           CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, a.dim + 1)]) AS BIGINT) AS score
    FROM v a JOIN v b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

ORACLES["op12_prefix_trie"] = """
WITH t AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          WHERE conv_id IS NOT NULL)),
c AS (
    SELECT conv_id, n, conv_id - conv_id % 5 AS base,
           -- CRC-32 of the decimal number, bit by bit, modulo 9
           xor(list_reduce(list_prepend(4294967295, [CAST(ord(d) AS BIGINT) FOR d IN string_split(CAST(conv_id AS VARCHAR), '')]),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(0 AS BIGINT) FOR i IN range(8)]),
                   lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h
    FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
g AS (
    SELECT c.conv_id, t.pos AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)) AS d, t.role, t.text
    FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c b ON b.conv_id = c.base),
w AS (
    SELECT conv_id, d, strlen(text) AS bytes,
           sha256(string_agg(sha256(role) || sha256(text), ',' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS name
    FROM (SELECT * FROM g)
    UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(d) AS depth FROM w GROUP BY conv_id),
n AS (
    SELECT w.name, any_value(w.d) AS depth, any_value(w.bytes) AS bytes, min(w.conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(w.conv_id AS VARCHAR), ',' ORDER BY w.conv_id) FILTER (l.depth = w.d), '')) AS ends
    FROM w JOIN l USING (conv_id) GROUP BY w.name),
up AS (SELECT n.name, a.name AS above, a.d AS above_depth FROM n JOIN w a ON a.conv_id = n.conv_id AND a.d <= n.depth),
parent AS (SELECT up.name, up.above FROM up JOIN n USING (name) WHERE up.above_depth = n.depth - 1),
child AS (SELECT above AS name, count(*) AS n_children FROM parent GROUP BY above),
below AS (
    SELECT up.above AS name, sum(CASE WHEN child.name IS NULL THEN 1 ELSE 0 END) AS n_leaves,
           sum((n.n_convs - 1) * n.bytes) AS saved_tokens
    FROM up JOIN n USING (name) LEFT JOIN child USING (name) GROUP BY up.above)
SELECT n.conv_id, n.depth, pn.conv_id AS parent_conv_id, n.n_convs, coalesce(child.n_children, 0) AS n_children,
       CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved_tokens AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN below USING (name) LEFT JOIN child USING (name) LEFT JOIN parent ON parent.name = n.name
LEFT JOIN n pn ON pn.name = parent.above
"""
