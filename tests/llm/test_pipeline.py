import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from retentia.llm import decontamination, jaccard, mixing, queries, sharding, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.001"


def by_brute_force(spark, sf_dir):
    """The documents left by each filtering stage: three times {doc_id: text}."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model, cut = toxicity.train_and_cut(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")),
                                        queries.may_train("doc_id"))
    keys = list(docs)
    clean = {k: docs[k] for k, s in zip(keys, model.scorer()([docs[k] for k in keys])) if s < cut}
    once = {k: clean[k] for k, _, first in brute.jaccard_components(list(clean.items()), 5, 80) if k == first}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {k for k, _ in brute.edit_matches(once.items(), items, decontamination.SIMILARITY, decontamination.words)}
    return clean, once, {k: t for k, t in once.items() if k not in hit}


def test_run_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    everything = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    clean, once, kept = by_brute_force(spark, sf_dir)
    # every filtering stage takes some documents and leaves most
    assert everything > len(clean) > len(once) > len(kept) > 0.5 * everything
    assert {r["doc_id"]: r["text"] for r in rows} == kept
    # the shard law: counts at most one apart, slots gapless, shards in curve order
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append((r["slot"], r["curve"]))
    assert sorted(shards) == list(range(16)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    in_order = [c for s in range(16) for _, c in sorted(shards[s])]
    assert all([n for n, _ in sorted(own)] == list(range(len(own))) for own in shards.values())
    assert in_order == sorted(in_order)
    # mixing repeats whole passes over a source and drops nothing
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], {}).setdefault(r["doc_id"], []).append(1)
    for times in sources.values():
        n = [len(t) for t in times.values()]
        assert max(n) - min(n) <= 1


def test_toxicity_stage_keeps_all_where_labels_are_too_few(spark):
    """Nine toxic training rows cannot show a precision of 0.95."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, sf_dir).count() == docs.count() == 200


@pytest.mark.parametrize("name", ["mix", "shard"])
def test_stages_leave_columns_of_the_input_as_they_are(spark, sf_dir, name):
    names = ["stream", "share", "cycle", "block", "epoch", "slot", "position", "shard", "curve", "document"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).withColumns({c: F.lit(f"my {c}") for c in names})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert {tuple(r[c] for c in docs.columns) for r in out.collect()} == {tuple(r) for r in docs.collect()}
    if name == "shard":
        assert out.columns == [*docs.columns, "_shard", "_slot", "_curve"]


def messy(spark):
    rows = [(1, "you are all fine " * 5, "en", "a", 3), (1, "you are all fine " * 5, "en", "a", 3), (2, None, None, None, None),
            (None, "", "en", "b", 0), (None, "a text without id and with enough words", "de", "b", 1),
            (5, "word " * 30_000, "en", "a", 9), (6, "tie tie tie", "en", "c", 1), (7, "tie tie tie", "en", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["score", "class", "component", "once", "stream", "place", "slice", "tokens", "rows", "cell", "first"]
    return df.withColumns({c: F.lit(c) for c in extra})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_nulls_repeats_and_clashing_columns(spark, sf_dir, name, stage):
    docs = messy(spark)
    out = stage(spark, docs, sf_dir)
    kept = out.collect()
    if name == "shard":
        assert sorted(r["slot"] for r in kept if r["shard"] == 0) == [0]
    else:
        assert sorted(out.columns) == sorted(docs.columns)
    texts = {r["text"] for r in kept}
    assert texts == {r["text"] for r in docs.collect()}
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.collect() == []


def test_mix_keeps_each_prefix_less_than_one_block_off(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    slots = sorted({(r["slot"], r["stream"], r["share"], r["cycle"]) for r in mixing.pfair_mix(
        docs, F.col("source"), [F.col("doc_id")], block=4).collect()})
    assert [s[0] for s in slots] == list(range(len(slots)))
    share, cycle = {s[1]: s[2] for s in slots}, slots[0][3]
    done = dict.fromkeys(share, 0)
    for t, (_, stream, _, _) in enumerate(slots, 1):
        done[stream] += 1
        assert all(abs(done[s] - t * share[s] / cycle) < 1 for s in share)


def test_mix_takes_given_weights_and_pools_small_sources(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 390, F.lit("a")).otherwise(
        F.concat(F.lit("s"), F.col("id"))).alias("source"))
    weights = spark.createDataFrame([("a", 0.5), *[(f"s{i}", 0.05) for i in range(390, 400)]], "source string, weight double")
    rows = mixing.pfair_mix(docs, F.col("source"), [F.col("doc_id")], weights, cycle=10, block=2).collect()
    assert {r["stream"] for r in rows} == {"s:a", ""} and len({r["doc_id"] for r in rows}) == 400
    none = mixing.pfair_mix(docs, F.col("source"), [F.col("doc_id")], weights.filter("source = 'a'"))
    assert {r["source"] for r in none.collect()} == {"a"}


def test_mix_keeps_unrounded_weights_of_many_sources(spark):
    """2,000 sources of very different weights, all below or about one slot of the cycle but one."""
    weight = {f"s{i}": 2000.0 if i == 0 else 0.37 + i % 7 * 0.41 for i in range(2000)}
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2000).alias("source"))
    given = spark.createDataFrame(list(weight.items()), "source string, weight double")
    rows = mixing.pfair_mix(docs, F.col("source"), [F.col("doc_id")], given, block=2).select("slot", "source", "doc_id").collect()
    assert len({r["doc_id"] for r in rows}) == 12_000
    at = {}
    for r in rows:
        at.setdefault(r["source"], set()).add(r["slot"])
    assert sorted(t for s in at.values() for t in s) == list(range(sum(map(len, at.values()))))
    total = sum(weight.values())
    for s, slots in at.items():
        # a source is furthest behind just before a slot of its own and furthest ahead just after it
        for i, t in enumerate(sorted(slots)):
            assert t * weight[s] / total - i < 1 and i + 1 - (t + 1) * weight[s] / total < 1
        assert max(map(max, at.values())) * weight[s] / total - len(slots) < 1


def test_shards_prune_and_keep_law(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dims = sharding.document_dimensions()
    out = sharding.hilbert_shards(docs, dims, [F.col("doc_id")], shards=16)
    assert out.count() == docs.count() and out.select("shard", "slot").distinct().count() == docs.count()
    table = sharding.manifest(out, dims)
    kept = {r["shard"] for r in sharding.prune(table, doc_id=(100, 140), size=(0, 800)).collect()}
    wanted = out.filter("doc_id between 100 and 140 and octet_length(text) + 1 <= 800").select("shard").distinct()
    assert {r["shard"] for r in wanted.collect()} <= kept and len(kept) < 16


def test_curve_steps_to_neighbours(spark):
    cells = spark.range(64 * 64).select((F.col("id") % 16).cast("int").alias("x"), F.expr("cast(id div 16 % 16 as int)").alias("y"),
                                        F.expr("cast(id div 256 as int)").alias("z"))
    at = {r["i"]: (r["x"], r["y"], r["z"]) for r in cells.withColumn(
        "i", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 4)).collect()}
    assert sorted(at) == list(range(4096))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(4095))
