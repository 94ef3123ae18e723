"""Scans: each reads what it is told to, into a declared schema, and routes what doesn't fit instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt"


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, quoted cells over several lines, doubled quotes."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All cells as trimmed strings; missing ones are empty."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return read_csv(spark, path, schema).select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])


def split_positional(lines: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """Comma-separated lines by position: the last column takes the rest of the line, missing ones are empty."""
    parts = F.split(F.col(value), ",", len(columns))
    return lines.select(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


def read_positional(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """split_positional() of files, each without its first line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = lines.groupBy("file").agg(F.min("at").alias("first"))
    return split_positional(lines.join(first, "file").where("at > first"), columns)


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def parse_jsonl(lines: DataFrame, schema: StructType, strict: bool = True, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON objects, one in a line, as (good, rejected).

    Blank lines are left out. A line that isn't an object is rejected, and if strict so is one whose keys aren't exactly
    the schema's. good has the schema's columns, rejected the line and a reason; other columns of lines go along.
    """
    text = F.col(value)
    beside = [F.col(c) for c in lines.columns if c != value]
    wider = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = F.from_json(text, wider, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    expected = F.array(*[F.lit(f) for f in schema.fieldNames()])
    keys = F.json_object_keys(text)
    rows = lines.where(F.trim(text) != "").select(*beside, text.alias("line"), parsed.alias("row"), keys.alias("keys"))
    bad_json = F.col("keys").isNull() | F.col(f"row.{CORRUPT}").isNotNull()
    reason = F.when(bad_json, "malformed")
    if strict:
        reason = reason.when(F.size(F.array_except(expected, "keys")) > 0, "missing key").when(F.size(F.array_except("keys", expected)) > 0, "unexpected key")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select(*beside, *[F.col(f"row.{f}").alias(f) for f in schema.fieldNames()])
    return good, rows.where("reason is not null").select(*beside, "line", "reason")


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    return parse_jsonl(spark.read.text(path), schema, strict)


def read_jsonl_dynamic(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Known keys of each line, null where absent; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_dataset(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """By ending: .jsonl and .jsonl.all hold an object in a line, .json an array or object; anything else is an error, and so is a bad record."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if path.endswith((".jsonl", ".jsonl.all")):
        return reader.json(path)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    raise ValueError(f"unknown kind of file: {path}")


def read_documents(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """JSON documents, one in a file, at any depth, as (good, malformed).

    good has `instance` and `project`, the names of the two folders above the file, `file`, and the schema's columns.
    """
    wider = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    parsed = F.from_json("value", wider, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    steps = F.split("file", "/")
    rows = whole.select(F.col("_metadata.file_path").alias("file"), "value", parsed.alias("row"))
    rows = rows.withColumn("instance", F.try_element_at(steps, F.lit(-2))).withColumn("project", F.try_element_at(steps, F.lit(-3)))
    bad = F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull()
    good = rows.where(~bad).select("project", "instance", "file", *[F.col(f"row.{f}").alias(f) for f in schema.fieldNames()])
    return good, rows.where(bad).select("project", "instance", "file", "value")


def files_below(spark: SparkSession, paths: list[str], pattern: str = "*") -> DataFrame:
    """(path, length): the files below the paths that match, each once, in order."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(paths)
    return listed.select("path", "length").distinct().orderBy("path")


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """A row for each suite: counts are 0 and times 0.0 where the report has none, and the file's name stands in for the suite's."""
    from strandline.schemas import JUNIT_SUITE

    suites = spark.read.format("xml").option("rowTag", "testsuite").schema(JUNIT_SUITE).load(path)
    name = F.coalesce(F.col("_name"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    counts = [F.coalesce(F.col(f"_{c}"), F.lit(0)).cast("long").alias(c) for c in ("tests", "failures", "errors", "skipped")]
    return suites.select(name.alias("suite"), *counts, F.coalesce("_time", F.lit(0.0)).alias("time"), "testcase")


def junit_cases(suites: DataFrame) -> DataFrame:
    """A row for each test case: failure goes before error, error before skipped, and the rest passed."""
    c = F.col("c")
    status = F.when(c["failure"].isNotNull(), "FAILED").when(c["error"].isNotNull(), "ERROR").when(c["skipped"].isNotNull(), "SKIPPED").otherwise("PASSED")
    rows = suites.select("suite", F.posexplode("testcase").alias("pos", "c"))
    return rows.select(
        "suite", "pos", c["_classname"].alias("class_name"), c["_name"].alias("test_name"), status.alias("status"),
        F.coalesce(c["_time"], F.lit(0.0)).alias("duration"), F.coalesce(c["failure"], c["error"]).alias("message"),
    )


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files. Files that aren't UTF-8 have a marker for a text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise("[binary file]").alias("text"))


def until_cutoff(rows: DataFrame, order: list[Column], stamp: Column, cutoff: str, most: int | None = None) -> DataFrame:
    """Rows in ascending order up to and with the first that is older than the cutoff or has no stamp, and at most one row more than `most`.

    The log that this stands for writes a row before it tests the limits. The first such row is found by an aggregate, so
    that no task holds the listing.
    """
    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    first = rows.where(~F.coalesce(stamp >= F.lit(cutoff), F.lit(False))).agg(F.min(place).alias("first_"))
    kept = rows.join(F.broadcast(first)).where(F.col("first_").isNull() | (place <= F.col("first_"))).drop("first_")
    return kept if most is None else kept.orderBy(*order).limit(most + 1)


def read_pages(spark: SparkSession, path: str, pattern: str = r"page[-=]([0-9]+)") -> DataFrame:
    """(page, pos, value): the recorded pages of a paged listing, from the first to the last before one that is absent or blank.

    A page is the files whose path has its number, a value a line that isn't blank.
    """
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    pages = whole.select(F.regexp_extract("file", pattern, 1).try_cast("int").alias("page"), "value").where("page is not null and trim(value) <> ''")
    numbers = pages.select("page").distinct()
    before = numbers.select((F.col("page") + 1).alias("page"))
    # the least page without one before it, but for the first, ends the listing
    gap = numbers.where("page > 1").join(before, "page", "left_anti").agg(F.min("page").alias("gap_"))
    held = pages.join(F.broadcast(gap)).where(F.col("gap_").isNull() | (F.col("page") < F.col("gap_")))
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    return held.select("page", F.posexplode(lines).alias("pos", "value"))
