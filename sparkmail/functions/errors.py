"""Landed fetch errors: retry or not, which kind, and how long to wait."""

from pyspark.sql import Column, DataFrame, functions as F

# Retryable statuses and reasons, retry budget and back-off.
RETRY_STATUSES = ["RESOURCE_EXHAUSTED", "UNAVAILABLE", "INTERNAL"]
RETRY_REASONS = ["rateLimitExceeded", "userRateLimitExceeded", "backendError"]
MAX_RETRIES = 3
MAX_BACKOFF_DOUBLINGS = 5

ENVELOPE_SCHEMA = "error struct<code: bigint, status: string, errors: array<string>>"


def _retryable(error: Column) -> Column:
    """An error envelope that asks for another try."""
    by_code = (error["code"] == 429) | error["code"].between(500, 599)
    by_status = error["status"].isin(RETRY_STATUSES)
    # Elements are read one by one: an odd one hides no other.
    by_reason = F.exists(error["errors"], lambda e: F.coalesce(
        F.get_json_object(e, "$.reason").isin(RETRY_REASONS), F.lit(False)))
    no = F.lit(False)
    return F.coalesce(by_code, no) | F.coalesce(by_status, no) | F.coalesce(by_reason, no)


def with_transient(failures: DataFrame) -> DataFrame:
    """Add `transient`: whether a failed fetch (body, http_status,
    network_error) is worth another try.

    A JSON body is judged by the error it carries, any other body by the HTTP
    status alone; a network failure is always transient.
    """
    parsed = failures.withColumns({
        "__error": F.from_json("body", ENVELOPE_SCHEMA)["error"],
        # A body with a repeated key is JSON too.
        "__json": F.get_json_object("body", "$").isNotNull(),
    })
    status = F.col("http_status")
    return parsed.withColumn(
        "transient",
        F.when(F.col("network_error"), True)
        .when(F.col("__json"), _retryable(F.col("__error")))
        .otherwise(F.coalesce(status.isin(403, 429) | status.between(500, 599), F.lit(False))),
    ).drop("__error", "__json")


def error_kind(message: Column, origin: Column, transient: Column) -> Column:
    """The kind recorded on a failed run.

    `origin` says where the first known cause arose: consent, not_found, io,
    db or api.
    """
    return (
        F.when(F.contains(message, F.lit("policy_enforced")), "policy_enforced")
        .when(origin == "consent", "auth_required")
        .when(origin == "not_found", "missing_credentials")
        .when(origin == "io", "io")
        .when(origin == "db", "db")
        .when((origin == "api") & transient, "rate_limited")
        .when(origin == "api", "gmail_api")
        .otherwise("other")
    )


def backoff_seconds(attempt: Column) -> Column:
    """1, 2, 4 ... 32 seconds; up to a second of jitter comes on top."""
    doublings = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(MAX_BACKOFF_DOUBLINGS))
    return F.pow(F.lit(2), doublings).cast("long")


def gives_up(attempt: Column, transient: Column) -> Column:
    return ~transient | (attempt > MAX_RETRIES)
