import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from retentia.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op10_pu_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.filter("held_out").select("score", "predicted", "toxic").toPandas()
    tp = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    # 329 confirmed examples in this table; with the 1,600 of a larger one both figures reach 0.99
    assert tp / (rows.toxic == 1).sum() >= 0.9 and tp / (rows.predicted == 1).sum() >= 0.7
    assert rows.score.between(0, 1).all()


def test_stage_rejects_few_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.drop_toxic(spark, docs, sf).select("doc_id")
    held_out = labels.filter(~queries.may_train("doc_id"))
    rejected = [r["toxic"] for r in held_out.join(kept, "doc_id", "left_anti").collect()]
    toxic = held_out.filter("toxic = 1").count()
    print(f"rejected {len(rejected)}, of them toxic {sum(rejected)}, toxic in all {toxic}")
    assert sum(rejected) >= 0.95 * len(rejected) and sum(rejected) >= 0.6 * toxic


def test_labels_of_held_out_rows_are_not_read(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    usable = queries.may_train("doc_id")
    turned = labels.withColumn("toxic", F.when(usable, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.train(docs, own, usable) for own in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (3, ""), (None, "hello"), (4, "word " * 50_000)],
                                 "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, none, F.lit(True))
    scores = [r["s"] for r in docs.select(toxicity.score(model)("text").alias("s")).collect()]
    assert len(scores) == 5 and np.allclose(scores, toxicity.PRIOR)
    assert toxicity.train(docs.limit(0), none.limit(0), F.lit(True)).prior == toxicity.PRIOR


def test_risk_never_rewards_a_negative_second_term():
    rng = np.random.default_rng(1)
    positive = [np.array([1, 2, *rng.integers(10, 400, 5)]) for _ in range(40)]
    unlabelled = [np.unique(rng.integers(10, 400, 8)) for _ in range(300)] + positive[:30]
    model = toxicity.fit(positive, unlabelled, 0.1)
    score = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    assert score[1] > 0 and score[2] > 0


def test_folds_share_the_words_they_remember(monkeypatch):
    looked, known = [], toxicity.buckets
    monkeypatch.setattr(toxicity, "buckets", lambda w: looked.append(w) or known(w))
    models = [toxicity.Model(np.unique(known(w)), np.full(len(set(known(w))), 0.5), -1.0, 0.1) for w in ("foul", "awful", "kind")]
    texts, numbers = ["a foul word", "an awful word", None, "kind word", "a foul word"], np.array([0, 1, 2, 2, 1])
    got = toxicity.scorer_of(models)(texts, numbers)
    assert sorted(looked) == ["a", "an", "awful", "foul", "kind", "word"]
    assert got.tolist() == [models[i].scorer()([t])[0] for t, i in zip(texts, numbers)]
