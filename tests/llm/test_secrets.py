import random

import pytest
from pyspark.sql import functions as F

from retentia.llm import queries, secrets

KEYS = "0123456789abcdef"


def text_of(rng):
    words = [rng.choice(["the", "and", "house", "garden", "token", "river"]) for _ in range(30)]
    secret = "".join(rng.choice(KEYS) for _ in range(40))
    kinds = [f'token = "{secret}"', f"{rng.randrange(10**15, 10**16)}", f"user{rng.randrange(99)}@mail.example.com", ""]
    which = rng.randrange(4)
    words.insert(rng.randrange(20), kinds[which])
    return " ".join(words), which == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    rows = [(i, *text_of(rng), f"src/{'test' if i % 7 == 0 else 'main'}/f{i % 5}.py") for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, secret boolean, file string")


def test_forest_finds_planted_secrets(corpus):
    rows = secrets.scan(corpus, "text", F.col("file")).collect()
    assert {r["doc_id"] for r in rows if r["is_secret"]} == {r["doc_id"] for r in corpus.collect() if r["secret"]}
    assert all(0 <= r["probability"] <= 1 for r in rows) and any(not r["is_secret"] for r in rows)


def test_reviewed_findings_overrule(spark, corpus):
    """Findings that call card numbers secrets and tokens harmless turn the forest round."""
    found = secrets.candidates(corpus.withColumnRenamed("file", "f"), "text", F.col("f"))
    labelled = found.withColumn("label", F.col("candidate").rlike("^[0-9]+$").cast("double"))
    rows = secrets.scan(corpus, "text", F.col("file"), labelled).collect()
    assert rows and all(r["is_secret"] == r["candidate"].isdigit() for r in rows)


def test_candidates_equal_plain_split(spark):
    import re

    rows = [(1, 'a b="0123456789abcdef0" c'), (2, None), (3, ""), (4, "x" * 40 + " " + "y1" * 20), (5, "z9" * 50_000)]
    df = spark.createDataFrame(rows, "place long, text string")
    got = sorted((r[0], r["candidate"], r["before"]) for r in secrets.candidates(
        df.withColumnRenamed("place", "k"), "text").collect())
    want = []
    for k, t in rows:
        parts = re.split(secrets.SEPARATORS, t or "")
        want += [(k, w, parts[i - 1] if i else "") for i, w in enumerate(parts) if len(w) >= 16 and re.search("[0-9]", w)]
    assert got == sorted(want)


def test_edges(spark, sf):
    df = spark.createDataFrame([(None, "no candidate here", 1.0), (2, None, 2.0)], "doc_id long, text string, probability double")
    assert secrets.scan(df, "text").collect() == [] and secrets.scan(df.limit(0), "text").collect() == []
    got = queries.QUERIES["op5_secret_forest"](spark, sf)
    assert got.columns == ["doc_id", "place", "candidate_sha256", "probability", "is_secret"] and got.count() > 0
