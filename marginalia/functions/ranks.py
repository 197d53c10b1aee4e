"""Places and running totals in order, of groups of any size: by sorted ranges and their offsets, so that no group meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import discard, written


def placed(rows: DataFrame, groups: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """``rows`` with before, the rows of their group that come before them by ``order``, and total, all of the group; with ``weight``, sums of that column.

    Rows are dealt by ranges of group and order, sorted, and written with their place. A
    range's offset into a group is the sum over the ranges before it, of which there are
    as many as partitions at most; only within a range rows are counted one by one. Null
    groups are groups. Rows equal in group and order come in any order, in one task;
    ``order`` should end in a column that tells them apart.
    """
    spark = rows.sparkSession
    keys = [*groups, *order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = written(rows)  # else dealing by ranges would compute it twice
    dealt = written(source.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    discard(source)
    part = dealt.withColumn("__part", F.shiftright("__at", 33))
    amount = F.lit(1).cast("long") if weight is None else F.col(weight)
    runs = part.groupBy(*groups, "__part").agg(F.min("__at").alias("__first"), F.sum(amount).alias("__sum"))
    w = Window.partitionBy(*groups)
    offset = F.coalesce(F.sum("__sum").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), "__first", offset.alias("__offset"), F.sum("__sum").over(w).alias("total"))
    if weight is None:
        within = F.col("__at") - F.col("__first")
    else:
        own = Window.partitionBy(*groups, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        part, within = part.withColumn("__within", F.coalesce(F.sum(weight).over(own), F.lit(0))), F.col("__within")
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    met = part.join(starts, [*same, F.col("__part") == F.col("__p")])
    return met.select(*rows.columns, (F.col("__offset") + within).alias("before"), "total")
