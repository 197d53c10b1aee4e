"""Facts with formula provenance, year-over-year trends, and analyses made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import parse_period, stable_id

#: How a trend is computed; names of the analysis document are those of its contract.
TREND_FORMULA = "round(100 * (value - prior) / prior, 4)"


def compute_facts(rows: DataFrame, entity: Column, when: Column, amount: str, page: Column, metric: str = "Revenue", unit: str = "USD") -> DataFrame:
    """One fact per entity and quarter: values of the SQL expression ``amount`` added as decimals.

    The formula kept with each fact is made of that expression, so it tells what was
    computed; ``page`` is the source's page, over the columns entity and qidx.
    """
    quarter, year = F.quarter(when), F.year(when)
    by = rows.select(entity.cast("string").alias("entity"), (year * 4 + quarter - 1).alias("qidx"), F.expr(amount).cast("decimal(18,4)").alias("a")).groupBy("entity", "qidx").agg(F.sum("a").cast("double").alias("value"), F.count("*").alias("input_rows"))
    period = F.concat(F.lit("Q"), (F.col("qidx") % 4 + 1).cast("string"), F.lit(" "), F.floor(F.col("qidx") / 4).cast("string"))
    return by.select(stable_id(F.lit(metric), F.col("entity"), F.col("qidx")).alias("id"), "entity", F.lit(metric).alias("metric"), F.lit(unit).alias("unit"), period.alias("period"), "qidx", "value", F.lit(f"sum({amount})").alias("formula"), "input_rows", page.cast("int").alias("page"), F.lit(1.0).alias("confidence"))


def compute_trends(facts: DataFrame) -> DataFrame:
    """Each fact beside the one of four quarters before: change in per cent, direction, and both ids.

    yoy_pct is null where the earlier value is missing or zero; facts of other periods have no trend.
    """
    rows = facts.withColumn("q", parse_period(F.col("period"))).where("q is not null")
    w = Window.partitionBy("entity", "metric", "unit").orderBy("q").rangeBetween(-4, -4)
    rows = rows.withColumns({"prior": F.first("value").over(w), "prior_id": F.first("id").over(w)})
    pct = F.round(F.try_divide(100 * (F.col("value") - F.col("prior")), F.col("prior")), 4)
    direction = F.when(F.col("value") > F.col("prior"), "increased").when(F.col("value") < F.col("prior"), "decreased").when(F.col("value") == F.col("prior"), "flat")
    return rows.select("entity", "metric", "unit", "period", "value", "prior", pct.alias("yoy_pct"), direction.alias("direction"), F.lit(TREND_FORMULA).alias("trend_formula"), F.col("id").alias("fact_id"), "prior_id")


def build_analysis(facts: DataFrame, trends: DataFrame) -> DataFrame:
    """(analysis_id, raw): a document per entity, facts and trends in order of time, which breaks no rule of the contract."""
    fact = F.struct("id", "metric", "value", "unit", "period", F.struct("page").alias("source"), "confidence")
    f = facts.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("qidx", "id", fact.alias("f")))).alias("f"))
    t = trends.where("direction is not null").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct(parse_period(F.col("period")).alias("q"), "fact_id", "prior_id", "yoy_pct", "direction"))).alias("t"))
    empty = F.array().cast("array<string>")
    body = F.struct(
        F.lit("0.1").alias("schemaVersion"), F.array(F.concat(F.lit("Facts of "), F.col("entity"), F.lit("."))).alias("executiveSummary"), F.transform("f", lambda x: x["f"]).alias("facts"),
        F.coalesce(F.transform("t", lambda x: F.struct(x["fact_id"].alias("factId"), x["prior_id"].alias("priorId"), x["yoy_pct"].alias("yoyPct"), x["direction"].alias("direction"))), F.array().cast("array<struct<factId:string,priorId:string,yoyPct:double,direction:string>>")).alias("trends"),
        empty.alias("risks"), empty.alias("opportunities"), F.array(F.struct(F.lit("line").alias("type"), F.transform("f", lambda x: x["id"]).alias("factIds"))).alias("recommendedVisuals"),
    )
    return f.join(t, "entity", "left").select(F.col("entity").alias("analysis_id"), F.to_json(body).alias("raw"))
