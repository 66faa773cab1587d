import numpy as np
from pyspark.sql import functions as F

from retentia.llm import languages, queries


def plain_bundle(text, dims):
    """The bundle of a text, letter by letter."""
    shown = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    shown = " " + " ".join(shown.split()) + " "
    total = np.zeros(dims, dtype=np.int64)
    for a, b, c in zip(shown, shown[1:], shown[2:]):
        x, y, z = (languages.letter_vector(ord(s), dims).astype(np.int64) for s in (a, b, c))
        total += np.roll(x, 2) * np.roll(y, 1) * z
    return total


def test_bundles_equal_the_plain_form(monkeypatch):
    monkeypatch.setattr(languages, "PIECE", 7)
    texts = ["Straße, ÉTÉ! 12 of", "a", "  --x-- ", "日本語 text", "word " * 40, "no", "x" * 50]
    got = languages.bundles([*texts, None, "", "123 !?"], 64)
    for row, text in zip(got, texts):
        assert row.tolist() == plain_bundle(text, 64).tolist()
    assert not got[len(texts):].any()


def test_held_out_accuracy_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.QUERIES["op13_language_profiles"](spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = [r for r in rows if r["held_out"] and r["lang"] and any(c.isalpha() for c in r["text"] or "")]
    assert len(kept) > 2000 and sum(r["lang"] == r["lang_pred"] for r in kept) / len(kept) > 0.97


def test_texts_without_letters_ties_empty_tables_and_partitioning(spark):
    rows = [(1, "der die das und ist nicht", "de"), (2, "the of and is not with", "en"), (3, None, "de"), (4, "", "en"),
            (5, "12 34", "fr"), (None, "the and of", "en"), (6, "und die", None), (7, "the " * 200_000, None), (2, "the of and is not with", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("found", F.lit("mine"))
    profiles = languages.train(df, F.lit(True))
    assert profiles.languages == ("de", "en")  # "fr" has no letter to learn from
    again = languages.train(df.repartition(5), F.lit(True))
    assert np.array_equal(profiles.prototypes, again.prototypes)
    got = {(r["doc_id"], r["text"]): r["p"] for r in df.withColumn("p", languages.predict(profiles)("text")).collect()}
    assert got[3, None] == got[4, ""] == got[5, "12 34"] == ("und", 0.0)
    assert got[6, "und die"]["lang"] == "de" and got[7, "the " * 200_000]["lang"] == "en"
    nothing = languages.train(df.limit(0), F.lit(True))
    assert [tuple(r["p"]) for r in df.withColumn("p", languages.predict(nothing)("text")).collect()] == [("und", 0.0)] * len(rows)
