"""Golden evaluation: fixtures, expected facts, findings, claims, contract differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .grams import containing

#: Kinds of provenance that may be used, and the number of fixtures aimed at.
PROVENANCE = ("synthetic", "licensed", "anonymized", "opted-in")
TARGET, TOLERANCE = 20, 1e-6
#: Copies of a row that are made from one row at once.
COPIES = 10_000


def admit_fixtures(fixtures: DataFrame) -> DataFrame:
    return fixtures.where(F.col("provenance").isin(*PROVENANCE))


def fixture_target(fixtures: DataFrame) -> DataFrame:
    return admit_fixtures(fixtures).agg(F.count_distinct("fixture_id").alias("n_fixtures")).withColumn("meets_target", F.col("n_fixtures") >= TARGET)


def score_facts(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """(fixture_id, metric, period, outcome): missing, unexpected, value_mismatch, unit_mismatch, page_mismatch or match.

    Of facts that repeat a key, one of each side counts: that of the least value.
    """
    key = ["fixture_id", "metric", "period"]
    one = lambda df, side: df.groupBy(*key).agg(F.min(F.struct("value", "unit", "page")).alias(side))
    e, p = F.col("e"), F.col("p")
    near = F.abs(e["value"] - p["value"]) <= TOLERANCE * F.greatest(F.abs(e["value"]), F.abs(p["value"]))
    outcome = F.when(p.isNull(), "missing").when(e.isNull(), "unexpected").when(~F.coalesce(near, F.lit(False)), "value_mismatch").when(~e["unit"].eqNullSafe(p["unit"]), "unit_mismatch").when(~e["page"].eqNullSafe(p["page"]), "page_mismatch").otherwise("match")
    return one(expected, "e").join(one(produced, "p"), key, "full_outer").select(*key, outcome.alias("outcome"))


def fact_accuracy(scored: DataFrame) -> DataFrame:
    n = lambda *names: F.sum(F.col("outcome").isin(*names).cast("long"))
    by = scored.groupBy("fixture_id").agg(F.count("*").alias("n"), n("match").alias("n_match"), n("missing").alias("n_missing"), n("unexpected").alias("n_unexpected"))
    ratio = lambda d: F.try_divide(F.col("n_match").cast("double"), d.cast("double"))
    return by.select("fixture_id", "n", "n_match", ratio(F.col("n")).alias("accuracy"), ratio(F.col("n") - F.col("n_missing")).alias("precision"), ratio(F.col("n") - F.col("n_unexpected")).alias("recall"))


def forbidden_hits(claims: DataFrame, texts: DataFrame) -> DataFrame:
    """(claim_id, doc_id): texts (doc_id, text) that hold a claim (claim_id, claim) verbatim.

    Found by joins on each claim's rarest gram. Empty claims and nulls hit nothing; a
    pair comes once.
    """
    return containing(claims.select("claim_id", "claim"), texts.select("doc_id", "text"), []).select("claim_id", "doc_id").distinct()


def missing_findings(required: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Required findings (fixture_id, finding) in no summary (fixture_id, text) of their fixture; and the share found per fixture.

    Found by joins on the fixture and each finding's rarest gram, so a fixture of many
    findings and summaries isn't all their pairs. A null or empty finding is in none; of
    repeated findings each row counts.
    """
    asked = required.select("fixture_id", F.col("finding").alias("claim"))
    found = containing(asked, summaries.select("fixture_id", "text"), ["fixture_id"]).select("fixture_id", F.col("claim").alias("finding")).distinct()
    found = written(found)
    on = [required["fixture_id"].eqNullSafe(found["fixture_id"]), required["finding"] == found["finding"]]
    missing = required.join(found, on, "left_anti")
    flagged = required.join(found.select("fixture_id", "finding", F.lit(1).alias("hit")), on, "left").select(required["fixture_id"], "hit")
    return missing, flagged.groupBy("fixture_id").agg((F.count("hit") / F.count("*")).alias("coverage"))


def contract_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more, with the side.

    A row counts up on one side and down on the other, so both meet in one shuffle, added
    up before it; rows come back as often as the sum says, in stretches of COPIES.
    """
    cols = expected.columns
    signed = expected.select(*cols, F.lit(1).alias("__n")).unionByName(actual.select(*cols, F.lit(-1).alias("__n")))
    left = signed.groupBy(*cols).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    side = F.when(F.col("__n") > 0, "expected_only").otherwise("actual_only")
    stretches = F.explode(F.sequence(F.lit(0).cast("long"), F.abs("__n") - 1, F.lit(COPIES).cast("long")))
    within = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.abs("__n") - F.col("__from"), F.lit(COPIES))))
    return left.withColumn("side", side).withColumn("__from", stretches).withColumn("__k", within).select(*cols, "side")
