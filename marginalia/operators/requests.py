"""Job requests: defaults, validation, routing, queueing, entitlement, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import not_blank, stable_id

#: Fixed values of the request contract.
MODES = ("file", "text")
PURPOSES = ("management-review", "board-update", "investor-summary")
MIN_SLIDES, MAX_SLIDES = 5, 20
DEFAULTS = {"input_mode": "file", "source_text": "", "file_name": None, "deck_purpose": "management-review", "slide_count": 10}
SOURCE_REQUIRED = "source_text is required when input_mode is text"
FILE_REQUIRED = "file_name is required when input_mode is file"


def with_request_defaults(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items() if v is not None})


def select_source_by_mode(df: DataFrame) -> DataFrame:
    """Text requests keep source_text, file requests file_name; the other is null."""
    text = F.col("input_mode") == "text"
    return df.withColumns({"source_text": F.when(text, F.col("source_text")), "file_name": F.when(F.col("input_mode") == "file", F.col("file_name"))})


def validate_requests(df: DataFrame) -> DataFrame:
    """``df`` with ``errors``: names of bad fields, or only if there are none the missing source's message."""
    fine = {"input_mode": F.col("input_mode").isin(*MODES), "deck_purpose": F.col("deck_purpose").isin(*PURPOSES), "slide_count": F.col("slide_count").between(MIN_SLIDES, MAX_SLIDES)}
    fields = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in fine.items()]))
    if "type_errors" in df.columns:
        fields = F.array_distinct(F.concat(fields, "type_errors"))
    missing = F.when((F.col("input_mode") == "text") & ~not_blank(F.col("source_text")), F.lit(SOURCE_REQUIRED)).when((F.col("input_mode") == "file") & ~not_blank(F.col("file_name")), F.lit(FILE_REQUIRED))
    return df.withColumn("__f", fields).withColumn("errors", F.when(F.size("__f") > 0, F.col("__f")).otherwise(F.array_compact(F.array(missing)))).drop("__f")


def route_requests(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows without errors, rejected rows with them; together all rows."""
    return validated.where(F.size("errors") == 0).drop("errors"), validated.where(F.size("errors") > 0)


def enqueue_jobs(accepted: DataFrame, *key: str) -> DataFrame:
    """Accepted requests with a stable ``id`` made from the key columns (all, if none are named), and status queued."""
    return accepted.withColumn("id", stable_id(*[F.col(c) for c in key or accepted.columns])).withColumn("status", F.lit("queued"))


def entitled_requests(requests: DataFrame, entitlements: DataFrame, account: str) -> tuple[DataFrame, DataFrame]:
    """Requests whose account has an entitlement, and the others."""
    accounts = entitlements.select(account).distinct()
    return requests.join(accounts, account, "left_semi"), requests.join(accounts, account, "left_anti")


def log_view(requests: DataFrame) -> DataFrame:
    """Requests as they may be logged: the text's length and digest in place of the text."""
    return requests.withColumns({"source_length": F.length("source_text"), "source_sha256": F.sha2("source_text", 256)}).drop("source_text")
