"""Sources: JSON lines, arrays and maps, positional scores, CSV, recogniser TSV, lists, folders; all with explicit schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry
from ..functions.text import kernel_column
from . import json_members

ANNOTATION = "filename string, split string, table_id string, bbox array<double>, html struct<structure: struct<tokens: array<string>>, cells: array<struct<tokens: array<string>, bbox: array<double>>>>"
SAMPLE = "struct<html: string, type: string>"
REGIONS = "array<struct<bbox: array<double>, text: string, score: double, bbox_score: double>>"
INFERENCE = "struct<pred_string: string, answer_string: string>"


def json_lines(spark: SparkSession, path: str, schema: str = ANNOTATION) -> DataFrame:
    """A row for each line that is not blank; a filter on a column reaches the scan's output at once."""
    return spark.read.schema(schema).json(path)


def json_lookup(spark: SparkSession, path: str, keys: DataFrame, key: str, schema: str = ANNOTATION) -> DataFrame:
    """The lines whose key is wanted. Spark broadcasts the keys below its own size limit."""
    return json_lines(spark, path, schema).join(keys.select(key).distinct(), key, "left_semi")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each object of JSON arrays that fill whole files."""
    return json_members.array_elements(spark, path, f"struct<{schema_string(schema)}>").select("value.*")


def schema_string(schema: str) -> str:
    return T.StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def json_map(spark: SparkSession, path: str, value: str = SAMPLE, key: str = "sample") -> DataFrame:
    """A row for each member of JSON objects that fill whole files: key and the value's fields."""
    rows = json_members.object_members(spark, path, value).withColumnRenamed("key", key)
    return rows.select(key, "value.*") if value.startswith("struct") else rows


def regions(spark: SparkSession, path: str) -> DataFrame:
    """sample, region_idx and the fields of each region of a JSON map of lists. Pickled files are not read: loading them would run their code."""
    lists = json_map(spark, path, REGIONS)
    return lists.select("sample", F.posexplode("value").alias("region_idx", "r")).select("sample", "region_idx", "r.*")


def positional_scores(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of file, prediction, truth, edit distance, structure score and score, by name."""
    rows = json_members.array_elements(spark, path, "array<string>").withColumnRenamed("value", "r")
    at = lambda k, kind: F.get("r", F.lit(k)).cast(kind)
    return rows.select(at(0, "string").alias("sample"), at(1, "string").alias("pred_html"), at(2, "string").alias("gt_html"), at(3, "double").alias("edit_distance"), at(4, "double").alias("teds_s"), at(5, "double").alias("teds"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def recognised_words(spark: SparkSession, path: str, keep_unsure: bool = False) -> DataFrame:
    """text, score and box of recogniser TSV rows with text. A confidence that is no number is -1; rows below 0 go, unless `keep_unsure`, where whole numbers count as hundredths and others as 1."""
    raw = spark.read.option("sep", "\t").option("quote", "").csv(path, header=True)
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    conf = F.coalesce(number("conf"), F.lit(-1.0))
    rows = raw.withColumn("__conf", conf).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    if not keep_unsure:
        rows = rows.where("__conf >= 0")
    score = F.when(F.col("conf").rlike("^[0-9]+$"), F.col("__conf") / 100).otherwise(F.lit(1.0)) if keep_unsure else F.col("__conf")
    x, y = number("left"), number("top")
    return rows.select(F.trim("text").alias("text"), score.alias("score"), F.struct(x.alias("x0"), y.alias("y0"), (x + number("width")).alias("x1"), (y + number("height")).alias("y1")).alias("box"))


def words_in_table(words: DataFrame, table_box: Column) -> DataFrame:
    """The words whose centres lie in the table's box, bounds included."""
    return words.where(geometry.contains_point(table_box, *geometry.centre(F.col("box"))))


def name_list(spark: SparkSession, path: str, comments: bool = False, both_forms: bool = False) -> DataFrame:
    """Distinct lines that are not blank; optionally without '#' comments, and with a name and the name with .png."""
    rows = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")
    if comments:
        rows = rows.where(~F.col("name").startswith("#"))
    if both_forms:
        stem = F.regexp_replace("name", "\\.png$", "")
        rows = rows.select(F.explode(F.array(stem, F.concat(stem, F.lit(".png")))).alias("name"))
    return rows.distinct()


def files(spark: SparkSession, path: str, pattern: str | None = None, content: bool = True, **keys: str) -> DataFrame:
    """path, size_bytes and, if `content` is wanted, sha256 of the files of a folder, and keys that regular expressions find in the path. Without `content` no file is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    found = [F.regexp_extract("path", regex, 1).alias(name) for name, regex in keys.items()]
    digest = [F.sha2("content", 256).alias("sha256")] if content else []
    return rows.select(*digest, F.col("length").alias("size_bytes"), "path", *found)


def by_stem(rows: DataFrame) -> DataFrame:
    """Rows of a file source with `sample`, the file's name without its suffix."""
    return rows.withColumn("sample", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "\\.[^.]*$", ""))


def optional(spark: SparkSession, path: str, schema: str, read=json_lines) -> DataFrame:  # noqa: ANN001
    """The source, or no rows of its schema if the path is not there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return read(spark, path, schema)


def require_columns(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    if lost := [c for c in names if c not in rows.columns]:
        raise ValueError(f"columns that are not there: {lost}")
    return rows


def first_text(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def sniffed(spark: SparkSession, paths: Sequence[str], names: Sequence[str], lines: int = 20) -> str:
    """The first path whose first lines, a bounded number, are JSON objects that all have the named members. Raises ValueError if there is none."""
    for path in paths:
        head = spark.read.text(path).limit(lines)
        has = F.lit(True)
        for name in names:
            has = has & F.coalesce(F.array_contains(F.json_object_keys("value"), name), F.lit(False))
        n, ok = head.agg(F.count("*"), F.count_if(has)).first()
        if n and n == ok:
            return path
    raise ValueError(f"none of {list(paths)} has {list(names)}")


def _boxed(value: object) -> Iterator[dict]:
    if isinstance(value, dict):
        if "bbox" in value and "tokens" in value:
            yield {"bbox": value["bbox"], "tokens": value["tokens"]}
        else:
            for member in value.values():
                yield from _boxed(member)
    elif isinstance(value, list):
        for element in value:
            yield from _boxed(element)


def boxed_tokens(document: Column) -> Column:
    """All objects with both bbox and tokens of a JSON text, at any depth, in order; none of what is no JSON."""

    def found(text: str | None) -> list[dict]:
        try:
            return list(_boxed(json.loads(text or "null")))
        except (ValueError, RecursionError):
            return []

    return kernel_column(found, document, kind="array<struct<bbox: array<double>, tokens: array<string>>>")

