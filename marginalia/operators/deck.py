"""Decks: preflight, slides, layouts, repairs, artifacts, assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import placed

SLIDE_ERROR = "slideCount must be a non-negative integer"


def preflight_report(df: DataFrame, col: str = "slide_count") -> DataFrame:
    """``df`` with report (status, slide_count, failures), or error where the count is no whole number of 0 or more."""
    n = F.col(col)
    numeric = dict(df.dtypes)[col] in ("tinyint", "smallint", "int", "bigint", "float", "double") or dict(df.dtypes)[col].startswith("decimal")
    ok = F.coalesce((n >= 0) & (n == F.floor(n)) & ~F.isnan(n.cast("double")), F.lit(False)) if numeric else F.lit(False)
    report = F.when(ok, F.struct(F.lit("pending").alias("status"), n.try_cast("int").alias("slide_count"), F.array().cast("array<string>").alias("failures")))
    return df.withColumn("report", report).withColumn("error", F.when(~ok, F.lit(SLIDE_ERROR)))


def render_warnings(df: DataFrame) -> DataFrame:
    """(output_path, warning) rows; a result without warnings keeps one row with a null."""
    return df.select("output_path", F.explode_outer("warnings").alias("warning"))


def count_warnings(df: DataFrame) -> DataFrame:
    return render_warnings(df).groupBy("output_path").agg(F.count("warning").alias("n_warnings"))


def compile_deckspec(items: DataFrame, slide_counts: DataFrame, per_slide: int) -> DataFrame:
    """Slides (job, slide_no, overflow, n_items, longest, items) of items (job, ord, text), in order.

    Slides past the job's slide_count (job, slide_count) are marked overflow. Items of one
    job are numbered over many tasks and meet by slide only.
    """
    numbered = placed(items.select("job", "ord", "text"), ["job"], ["ord", "text"])
    slides = numbered.withColumn("slide_no", (1 + F.floor(F.col("before") / per_slide)).cast("int")).groupBy("job", "slide_no").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("o"))
    slides = slides.select("job", "slide_no", F.size("o").alias("n_items"), F.array_max(F.transform("o", lambda x: F.length(x["text"]))).alias("longest"), F.transform("o", lambda x: x["text"]).alias("items"))
    return slides.join(slide_counts, "job").withColumn("overflow", F.col("slide_no") > F.col("slide_count"))


def fit_layouts(slides: DataFrame, layouts: list[tuple[str, int, int]]) -> DataFrame:
    """Slides with layout: the smallest (slots, then name) of (name, slots, max_chars) that holds them; null if none does."""
    registry = F.array(*[F.struct(F.lit(s).alias("slots"), F.lit(n).alias("name"), F.lit(c).alias("chars")) for n, s, c in layouts])
    fits = F.filter(registry, lambda x: (x["slots"] >= F.col("n_items")) & (x["chars"] >= F.col("longest")))
    return slides.withColumn("layout", F.array_min(fits)["name"])


def layout_failures(fitted: DataFrame) -> DataFrame:
    """(job, failures): for each job the slides without a layout."""
    what = F.when(F.col("layout").isNull(), F.concat(F.lit("no_layout:"), F.col("slide_no").cast("string")))
    return fitted.groupBy("job").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(what.isNotNull(), F.struct("slide_no", what.alias("w"))))), lambda x: x["w"]), ",").alias("failures"))


def bound_repairs(attempts: DataFrame, max_attempts: int, job: str, *order: str) -> DataFrame:
    """Attempts numbered in order within their job; the first ``max_attempts`` run, others are refused. A job's attempts are numbered over many tasks."""
    numbered = placed(attempts, [job], [*order])
    return numbered.withColumn("attempt", (F.col("before") + 1).cast("int")).drop("before", "total").withColumn("decision", F.when(F.col("attempt") <= max_attempts, "run").otherwise("refused"))


def latest_artifacts(artifacts: DataFrame, job: str, created: str, id_col: str) -> DataFrame:
    return artifacts.groupBy(job).agg(F.max_by(id_col, F.struct(created, id_col)).alias("latest_id"), F.max(created).alias("latest_created"))


def check_layout_assertions(decks: DataFrame, assertions: DataFrame) -> DataFrame:
    """Assertions (fixture_id, measure, min, max) with the deck's value (fixture_id, measure, value) and whether it holds."""
    return assertions.join(decks, ["fixture_id", "measure"], "left").withColumn("holds", F.coalesce(F.col("value").between(F.col("min"), F.col("max")), F.lit(False)))


def measures(slides: DataFrame) -> DataFrame:
    """(fixture_id, measure, value) of decks: slides, most items on one, longest item."""
    by = slides.groupBy(F.col("job").alias("fixture_id")).agg(F.count("*").alias("slides"), F.max("n_items").cast("long").alias("most_items"), F.max("longest").cast("long").alias("longest"))
    pair = lambda c: F.struct(F.lit(c).alias("measure"), F.col(c).alias("value"))
    rows: Column = F.explode(F.array(*map(pair, ("slides", "most_items", "longest"))))
    return by.select("fixture_id", rows.alias("m")).select("fixture_id", "m.measure", "m.value")
