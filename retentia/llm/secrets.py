"""Secret scanning with a random forest that removes false positives.

Long tokens with a digit are candidates. Each is described by its length, its character classes and transitions, its
coverage by words of the corpus, its path and the neighbouring words; a forest learnt from labelled findings tells
secrets from card numbers, addresses, identifiers and the like. DataFrame operations and Spark ML only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import checkpointed, name_beside

#: Fewest characters of a candidate.
LEAST = 16
#: Characters that separate tokens.
SEPARATORS = r"[\s\"'`,;:()<>|=]+"
#: Most frequent words of the corpus that count as a dictionary; the bound of what is carried to the tasks.
DICTIONARY = 500
#: Most labelled findings the forest is fitted on, drawn by hash.
FINDINGS = 20_000
TREES, DEPTH = 40, 8
THRESHOLD = 0.5
# Words that name a secret, and path parts of examples and tests.
SECRET_WORDS = "token|secret|passw|pwd|api_?key|auth|credential|bearer|private"
EXAMPLE_PATHS = "test|example|sample|fixture|doc|readme"
FEATURES = ["length", "digits", "upper", "lower", "hex", "others", "changes", "repeats", "distinct", "coverage",
            "named_before", "near_before", "before_length", "after_length", "depth", "example_path", "path_hash"]


def candidates(df: DataFrame, text: str, path: Column | None = None) -> DataFrame:
    """``df`` without ``text``, one row per candidate: ``place`` (its token number), ``candidate``, ``before``, ``near``
    (the words ahead of it), ``after`` and ``path``. Null and empty texts have none."""
    columns = [c for c in df.columns if c != text]
    tokens, at, shown = (name_beside(df, n) for n in ("tokens", "at", "shown_path"))
    found = F.filter(
        F.transform(F.col(tokens), lambda w, i: F.when((F.length(w) >= LEAST) & w.rlike("[0-9]"), i)),
        lambda i: i.isNotNull())
    rows = (df.withColumn(tokens, F.split(F.col(text), SEPARATORS))
            .withColumn(shown, F.coalesce((F.lit("") if path is None else path).cast("string"), F.lit("")))
            .withColumn(at, F.explode(found)))
    get = lambda step: F.coalesce(F.get(F.col(tokens), F.col(at) + step), F.lit(""))
    return rows.select(*columns, F.col(at).alias("place"), get(0).alias("candidate"), get(-1).alias("before"),
                       get(-2).alias("near"), get(1).alias("after"), F.col(shown).alias("path"))


def dictionary(df: DataFrame, text: str, words: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters and more, counted over all documents."""
    every = df.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word"))
    counts = every.filter(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]


def with_features(rows: DataFrame, known: list[str]) -> DataFrame:
    """Adds the columns ``FEATURES`` to candidates."""
    c = F.col("candidate")
    length = F.length(c).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / length
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    runs = F.length(F.regexp_replace(kinds, r"(?s)(.)\1*", "x"))
    same = F.length(F.regexp_replace(c, r"(?s)(.)\1*", "x"))
    inside = F.filter(F.split(F.lit(" ".join(known)), " "), lambda w: (w != "") & F.lower(c).contains(w))
    covered = F.aggregate(inside, F.lit(0), lambda total, w: total + F.length(w)) / length
    secret = lambda name: F.lower(F.col(name)).rlike(SECRET_WORDS).cast("double")
    made = {
        "length": length, "digits": share("[^0-9]"), "upper": share("[^A-Z]"), "lower": share("[^a-z]"),
        "hex": share("[^0-9a-fA-F]"), "others": share("[0-9A-Za-z]"), "changes": (runs - 1) / length,
        "repeats": 1 - same / length, "distinct": F.size(F.array_distinct(F.split(c, ""))) / length,
        "coverage": F.least(covered, F.lit(1.0)), "named_before": secret("before"), "near_before": secret("near"),
        "before_length": F.length("before").cast("double"), "after_length": F.length("after").cast("double"),
        "depth": F.size(F.split("path", "/")).cast("double"),
        "example_path": F.lower("path").rlike(EXAMPLE_PATHS).cast("double"),
        "path_hash": F.pmod(F.xxhash64("path"), F.lit(16)).cast("double")}
    return rows.withColumns({name: F.coalesce(made[name], F.lit(0.0)) for name in FEATURES})


def distant_labels(rows: DataFrame) -> DataFrame:
    """Labelled findings where none were reviewed by hand: ``label`` 1 for a mixed token of 20 characters or more
    right after a word that names a secret, 0 for plain numbers and addresses; other candidates get no label."""
    c = F.col("candidate")
    plain = c.rlike(r"^[0-9.\-+/]+[^0-9A-Za-z]*$") | c.rlike("@")
    named = F.lower("before").rlike(SECRET_WORDS) & c.rlike("[A-Za-z]") & (F.length(c) >= 20) & ~plain
    return rows.withColumn("label", F.when(named, 1.0).when(plain, 0.0)).filter(F.col("label").isNotNull())


def train(findings: DataFrame, most: int = FINDINGS, seed: int = 11) -> RandomForestClassificationModel | float:
    """A forest on labelled candidates with ``FEATURES``, at most ``most`` of them; if one label is missing, the share
    of secrets among them instead (0.5 without any)."""
    some = checkpointed(findings.orderBy(F.xxhash64("candidate", "place"), "candidate", "place").limit(most)
                        .select("label", *FEATURES))
    share = some.agg(F.avg("label").alias("s")).first()["s"]
    if share is None or share in (0.0, 1.0):
        return 0.5 if share is None else share
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(some))


def scan(df: DataFrame, text: str, path: Column | None = None, findings: DataFrame | None = None) -> DataFrame:
    """The candidates of ``df`` with ``probability`` and ``is_secret``; its other columns stay.

    ``findings`` are labelled candidates with the columns of ``candidates`` and ``label``; without them the corpus is
    labelled by ``distant_labels``. Columns of ``df`` named like an added one are replaced.
    """
    added = ["place", "candidate", "before", "near", "after", "path", "probability", "is_secret", "features", "label",
             "rawPrediction", "prediction", *FEATURES]
    keep = [c for c in df.columns if c not in added or c == text]
    rows = df.select(*keep, *([path.alias(name_beside(df, "scanned_path"))] if path is not None else []))
    if path is not None:
        scanned = name_beside(df, "scanned_path")
        found = candidates(rows, text, F.col(scanned)).drop(scanned)
    else:
        found = candidates(rows, text)
    known = dictionary(df, text)
    found = checkpointed(found)
    described = with_features(found, known)
    labelled = with_features(findings, known) if findings is not None else distant_labels(described)
    model = train(labelled)
    columns = [c for c in keep if c != text]
    shown = [*columns, "place", "candidate", "before", "after", "path", "probability"]
    if isinstance(model, float):
        scored = described.withColumn("probability", F.lit(model))
    else:
        ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described)
        scored = model.setProbabilityCol("forest_vote").transform(ready).withColumn(
            "probability", vector_to_array("forest_vote")[1])
    return scored.select(*shown).withColumn("is_secret", F.col("probability") >= THRESHOLD)
