"""Telemetry: job progress, latency and cost by stage, choice of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import placed


def latest_job_status(events: DataFrame) -> DataFrame:
    """(job, stage, n_events): the latest stage of each job by time, then event id."""
    return events.groupBy("job").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.count("*").alias("n_events"))


def exact_percentiles(events: DataFrame, group: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(group, p0, p1, ...): for each share the percentile of a group's values, between the two nearest by distance; nulls are left out.

    Equal values are counted first and the counts ordered over many tasks; of each group
    only the values at the ranks asked for are picked, so no task holds a group.
    """
    counts = events.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    ordered = placed(counts, [group], [value], "n").withColumn("past", F.col("before") + F.col("n"))
    at = [F.lit(p) * (F.col("total") - 1) for p in shares]
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("past"))
    wanted = [F.when(holds(f(x)), F.col(value)) for x in at for f in (F.floor, F.ceil)]
    picks = [F.max(c).alias(f"v{i}") for i, c in enumerate(wanted)]
    by = ordered.where(F.coalesce(*wanted).isNotNull()).groupBy(group).agg(F.max("total").alias("total"), *picks)
    part = [x - F.floor(x) for x in at]
    return by.select(group, *[((1 - f) * F.col(f"v{2 * i}") + f * F.col(f"v{2 * i + 1}")).alias(f"p{i}") for i, f in enumerate(part)])


def stage_telemetry(events: DataFrame, exact: bool = True) -> DataFrame:
    """Per stage: events, jobs, median and 95th percentile, total and cost per job. ``exact`` False reads the events once, for percentiles that are near."""
    total = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    near = [] if exact else [F.approx_percentile("value", F.lit(p)).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))]
    by = events.groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct("job").alias("jobs"), *near, total.alias("total"))
    if exact:
        found = exact_percentiles(events, "stage", "value", (0.5, 0.95)).select(F.col("stage").alias("__stage"), F.col("p0").alias("p50"), F.col("p1").alias("p95"))
        by = by.join(found, F.col("stage").eqNullSafe(F.col("__stage")), "left")
    return by.select("stage", "n", "jobs", "p50", "p95", "total", F.try_divide(F.col("total"), F.col("jobs").cast("double")).alias("cost_per_job"))


def rank_models(results: DataFrame) -> DataFrame:
    """Primary and fallback of (model, correct, cost): most accurate, then cheapest, then by name."""
    by = results.groupBy("model").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.col("cost").cast("double")).alias("cost"))
    rank = F.row_number().over(Window.orderBy(F.desc("accuracy"), "cost", "model"))  # one row a model
    return by.withColumn("rank", rank).where("rank <= 2").withColumn("choice", F.when(F.col("rank") == 1, "primary").otherwise("fallback"))
