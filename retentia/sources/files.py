"""File scans with declared schemas, and listings of landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.functions.scalars import base_name

CORRUPT = "_corrupt_record"
DATA_SUFFIX = r"\.(csv|json)$"


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


#: Quotes inside a quoted value are doubled. An empty value, quoted or not, is null.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path, schema: T.StructType, keep_corrupt: bool = False,
             multi_line: bool = True) -> DataFrame:
    """CSV with a header; a record that does not fit the schema keeps its text in ``_corrupt_record``.

    Values may hold line ends inside quotes, so files are read one per task; pass ``multi_line=False`` for files
    known to hold none, which then split.
    """
    reader = spark.read.options(**CSV_OPTIONS).option("mode", "PERMISSIVE").option("multiLine", multi_line)
    if keep_corrupt:
        return (reader.schema(_with_corrupt(schema)).option("columnNameOfCorruptRecord", CORRUPT)
                .csv(path))
    return reader.schema(schema).csv(path)


def split_corrupt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that fit their schema, rows that do not) of a scan that kept corrupt records.

    A scan parses only the columns asked for, so both parts must ask for all, or the scan be written first.
    """
    bad = F.col(CORRUPT).isNotNull()
    return rows.filter(~bad).drop(CORRUPT), rows.filter(bad)


def read_json(spark: SparkSession, path, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """JSON records; pass ``multi_line`` for files that hold one array (such files do not split)."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, modified, length) of a folder's files; no file is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        "path", base_name(F.col("path")).alias("name"),
        F.col("modificationTime").alias("modified"), "length")


def files_with_suffix(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """File names with one of the suffixes, sorted."""
    return files.filter(F.col("name").rlike(r"\.(" + "|".join(suffixes) + r")$")).orderBy("name")


def latest_data_file(files: DataFrame, suffix: str = DATA_SUFFIX) -> DataFrame:
    """The most recently modified data file, as at most one row."""
    return files.filter(F.col("name").rlike(suffix)).orderBy(F.col("modified").desc(), "path").limit(1)


def read_latest(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Scan the newest CSV or JSON file of a folder."""
    found = latest_data_file(list_files(spark, folder)).collect()
    if not found:
        raise FileNotFoundError(f"no CSV or JSON file in {folder}")
    path = found[0]["path"]
    return read_csv(spark, path, schema) if path.endswith("csv") else read_json(spark, path, schema)


def latest_delivery(files: DataFrame, suffix: str = DATA_SUFFIX) -> DataFrame:
    """(folder, kind) of the most recently modified delivery, a folder with data files of one kind, as at most one row."""
    inside = files.filter(F.col("name").rlike(suffix)).withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    newest = inside.groupBy("folder").agg(F.max("modified").alias("modified"), F.max("name").alias("name"))
    return newest.orderBy(F.col("modified").desc(), "folder").limit(1).select(
        "folder", F.regexp_extract("name", suffix, 1).alias("kind"))


def read_latest_delivery(spark: SparkSession, landing: str, schema: T.StructType) -> DataFrame:
    """Scan all files of the newest delivery below ``landing``, in as many tasks as it has files."""
    found = latest_delivery(list_files(spark, landing)).collect()
    if not found:
        raise FileNotFoundError(f"no CSV or JSON file in {landing}")
    return (read_csv if found[0]["kind"] == "csv" else read_json)(spark, found[0]["folder"], schema)


def csv_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(file, position, name) of every CSV file's header, from the first line of each file; quoted names may hold commas
    and doubled quotes, but no line ends.

    Each task keeps one line per file before the shuffle.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("line"), "value")
    first = lines.filter(F.col("at") == 0).groupBy("file").agg(
        F.min(F.struct("line", "value"))["value"].alias("header"))
    cells = F.regexp_extract_all("header", F.lit('(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(
        F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return first.select("file", F.posexplode(plain).alias("position", "name"))
