"""Column helpers: blank tests, ids, periods and the types of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: matches a character that isn't white space in Unicode's sense.
NON_BLANK = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def not_blank(c: Column) -> Column:
    """Whether a string has more than white space; null counts as blank."""
    return F.coalesce(F.rlike(c, F.lit(NON_BLANK)), F.lit(False))


def stable_id(*parts: Column) -> Column:
    """A UUID-shaped id made from the parts: the same again when a task is retried."""
    key = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])
    return F.regexp_replace(F.substring(F.sha2(key, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def job_short_id(c: Column) -> Column:
    return F.substring(c, 1, 8)


def parse_period(c: Column) -> Column:
    """Number of the quarter that "Q2 2026" names (4 * year + quarter - 1); null for any other period."""
    got = lambda k: F.regexp_extract(c, r"^Q([1-4]) (\d{4})$", k).try_cast("int")
    return got(2) * 4 + got(1) - 1


def with_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``name``: a variant of the JSON document in column ``text``, or null for what isn't one; of a repeated key the last value counts.

    Spark's parser stops after the first value, so the text is read as the first of two
    members of an array; the second is the text's SHA-256, which only comes second if one
    value, and nothing else, precedes it: no text holds its own hash. Hash and array are
    columns, since Spark evaluates expressions that are named twice anew.

    Sets spark.sql.variant.allowDuplicateKeys for the session, without which documents that repeat a key count as no JSON.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    ended = df.withColumn("__end", F.sha2(text, 256))
    listed = ended.withColumn("__listed", F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(',"'), "__end", F.lit('"]'))))
    alone = F.try_variant_get("__listed", "$[1]", "string") == F.col("__end")
    return listed.withColumn(name, F.when(alone, F.try_variant_get("__listed", "$[0]", "variant"))).drop("__end", "__listed")


def member(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_name(s: Column, d: Column) -> Column:
    """object, array, string, integer, number, boolean or null from a variant's schema and its value as a double; SQL NULL if missing. 17.0 is an integer."""
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "VOID", "null").when(s == "BOOLEAN", "boolean")
        .when((s == "BIGINT") | s.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").when(s.startswith("DECIMAL"), F.when(d == F.floor(d), "integer").otherwise("number"))
        .when(s.isin("DOUBLE", "FLOAT"), F.when(d == F.floor(d), "integer").otherwise("number")).when(s.isNotNull(), "other")
    )


def kind_of(v: Column) -> Column:
    """``kind_name`` of a variant."""
    once = F.struct(F.schema_of_variant(v).alias("s"), F.try_variant_get(v, "$", "double").alias("d"))
    return F.transform(F.array(once), lambda x: kind_name(x["s"], x["d"]))[0]  # inside lambdas Spark evaluates each mention of an expression anew


def string_of(v: Column, path: str) -> Column:
    """The string at ``path`` of a variant; null if it is missing or of another type."""
    return F.when(F.schema_of_variant(member(v, path)) == "STRING", member(v, path, "string"))


def number_of(v: Column, path: str) -> Column:
    """The number at ``path`` of a variant as a double; null if it is missing or of another type."""
    return F.when(F.rlike(F.schema_of_variant(member(v, path)), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), member(v, path, "double"))
