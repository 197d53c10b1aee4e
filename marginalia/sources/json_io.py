"""JSON sources and sinks: job requests, analyses, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import kind_of, member, with_json


def parse_requests(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Request columns from JSON objects, and ``type_errors``: the members of a wrong type.

    slide_count may be an integer, a whole number or a string of digits; one that no
    int holds is of a wrong type. Of a repeated key the last value counts; other columns pass through.
    """
    rest = [c for c in df.columns if c != json_col]
    v = with_json(df, json_col, "__v").select(*rest, "__v")
    get = lambda k: member(F.col("__v"), f"$.{k}")
    bad = [F.when(~F.coalesce(kind_of(get(k)).isin("string", "null"), F.lit(True)), F.lit(k)) for k in ("input_mode", "source_text", "file_name", "deck_purpose")]
    n, number = kind_of(get("slide_count")), member(F.col("__v"), "$.slide_count", "string")
    count = F.when(n == "integer", number.try_cast("double").try_cast("int")).when((n == "string") & F.rlike(number, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.trim(number).try_cast("int"))
    bad.append(F.when(n.isNotNull() & (n != "null") & count.isNull(), F.lit("slide_count")))
    root = F.when(~F.coalesce(kind_of(F.col("__v")) == "object", F.lit(False)), F.lit("body"))
    text = [F.when(kind_of(get(k)) == "string", member(F.col("__v"), f"$.{k}", "string")).alias(k) for k in ("input_mode", "source_text", "file_name", "deck_purpose")]
    return v.select(*rest, *text, count.alias("slide_count"), F.array_compact(F.array(root, *bad)).alias("type_errors"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from files of one JSON object a line."""
    return parse_requests(spark.read.text(path))


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """(analysis_id, raw) from files that each hold one JSON document; the id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("analysis_id"), F.col("value").alias("raw"))


def write_jobs(jobs: DataFrame, path: str) -> None:
    jobs.write.partitionBy("status").json(path)


def write_analyses(analyses: DataFrame, path: str) -> None:
    """Raw documents as lines of JSON text, by schema version."""
    version = F.coalesce(F.try_variant_get("__v", "$.schemaVersion", "string"), F.lit("none"))
    with_json(analyses, "raw", "__v").select(F.col("raw").alias("value"), version.alias("schema_version")).write.partitionBy("schema_version").text(path)
