"""Column -> Column functions; all JVM-side, none can fail on bad text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values ------------------------------------------------------------------------------
UPDATE_DATE_FORMAT = "MM/dd/yyyy HH:mm"
TRUE_WORDS = ["yes", "true", "1"]
LABEL_YES = ["Yes", "yes", "True", "true", "1"]
LABEL_NO = ["No", "no", "False", "false", "0"]
EMAIL_PATTERN = r"^[\w\.-]+@[\w\.-]+\.\w+$"
GPA_LIMIT = 2.0
ATTENDANCE_LIMIT = 70.0
# ------------------------------------------------------------------------------------------------

_NUMBER = r"(?U)\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
_INTEGER = r"(?U)\A\s*[+-]?\d+\s*\z"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and all-white-space text."""
    return c.isNull() | (strip(c) == "")


def blank_to_null(c: Column) -> Column:
    """Blank text becomes null; other text is kept as it is, untrimmed."""
    return F.when(~is_blank(c), c)


def parse_update_date(c: Column, fmt: str = UPDATE_DATE_FORMAT) -> Column:
    """Text date to timestamp, null when it does not parse."""
    return F.try_to_timestamp(c, F.lit(fmt))


def str_to_bool(c: Column) -> Column:
    """Trimmed yes/true/1 of any case is True, everything else and null is False."""
    return F.coalesce(F.lower(strip(c)).isin(TRUE_WORDS), F.lit(False))


def ingest_bool(c: Column) -> Column:
    """Untrimmed true/yes/1 of any case is True; null stays null."""
    return F.lower(c.cast("string")).isin(TRUE_WORDS)


def safe_float(c: Column) -> Column:
    """Finite number or null, from text or numbers."""
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), strip(text).try_cast("double"))


def number_column(df: DataFrame, name: str) -> Column:
    """A column as double: numbers are cast, text is parsed safely."""
    numeric = isinstance(df.schema[name].dataType, T.NumericType)
    return (F.col(name).cast("double") if numeric else safe_float(F.col(name))).alias(name)


def safe_int(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.rlike(_INTEGER), strip(text).try_cast("int"))


def label_map(c: Column) -> Column:
    """Yes/No, True/False or 1/0 to 1/0; null marks a row for quarantine."""
    text = c.cast("string")
    return F.when(text.isin(LABEL_YES), 1).when(text.isin(LABEL_NO), 0)


def label_parse(c: Column) -> Column:
    """Numbers by their whole part, words by the true list, other text False, null stays null."""
    number = safe_float(c)
    return (
        F.when(c.isNull(), F.lit(None).cast("boolean"))
        .when(number.isNotNull(), F.abs(number) >= 1)
        .otherwise(ingest_bool(c))
    )


def derived_label(gpa: Column, attendance: Column) -> Column:
    """At risk when the GPA or the attendance is known and below its limit."""
    return F.coalesce(gpa < GPA_LIMIT, F.lit(False)) | F.coalesce(
        attendance < ATTENDANCE_LIMIT, F.lit(False)
    )


def age_years(born: Column, as_of: Column) -> Column:
    """Whole years between two dates; the birthday itself counts."""
    def day_of_year(d: Column) -> Column:
        return F.month(d) * 100 + F.dayofmonth(d)

    return F.year(as_of) - F.year(born) - F.when(day_of_year(as_of) < day_of_year(born), 1).otherwise(0)


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def weekday_text(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "hh:mm a")


def iso_text(ts: Column) -> Column:
    """ISO form; the fraction is written only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def title_case(c: Column) -> Column:
    """Underscores to blanks, each run of letters capitalised."""
    words = F.replace(c, F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(words, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    # initcap starts words at blanks only: enough unless other signs separate letters
    return F.when(words.rlike(r"\A[\p{L} ]*\z"), F.initcap(words)).otherwise(
        F.array_join(F.transform(runs, F.initcap), ""))


def fixed_text(c: Column, digits: int = 2) -> Column:
    """Fixed decimals with ties to even, without group separators."""
    return F.translate(F.format_number(c, digits), ",", "")


def percent_text(share: Column, digits: int = 2) -> Column:
    return F.concat(fixed_text(share * 100, digits), F.lit("%"))


def round_even(c: Column, digits: int = 2) -> Column:
    """Round the exact binary value, ties to even."""
    return fixed_text(c, digits).cast("double")


def display_name(dataset: Column, kind: Column, model: Column, accuracy: Column) -> Column:
    return F.concat_ws(
        " | ", dataset, title_case(kind), title_case(model),
        F.concat(F.lit("Acc: "), percent_text(accuracy)),
    )


def name_fingerprint(names: Column) -> Column:
    """SHA-256 of an ordered array of column names."""
    return F.sha2(F.array_join(names, ","), 256)


def is_email(c: Column) -> Column:
    # (?U): letters of every script count as word characters; \n?\z: one final newline is allowed
    return c.rlike("(?U)" + EMAIL_PATTERN[:-1] + r"\n?\z")


def in_rating_range(c: Column, low: int = 1, high: int = 5) -> Column:
    return F.coalesce(safe_int(c).between(low, high), F.lit(False))


def risk_name(predicted: Column) -> Column:
    return F.when(predicted == 1, "High Risk").otherwise("Low Risk")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def alert_targets(role: Column) -> Column:
    """Roles that hear about a new registration."""
    staff = [F.lit("admin"), F.lit("analyst")]
    return F.when(role == "student", F.array(F.lit("teacher"), *staff)).otherwise(F.array(*staff))


def hash_bucket(key: Column, seed: int, buckets: int = 100) -> Column:
    """Stable bucket of a key; the same in every run, partitioning and engine."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets
