"""Display and progress expressions over one run row."""

from pyspark.sql import Column, functions as F

# Labels, states and limits of the status view.
SOURCE_LABELS = {
    "mbox": "Takeout import",
    "gmail_api": "Gmail scan",
    "backfill": "Message-ID backfill",
}
STATE_LABELS = {"awaiting_auth": "awaiting authorization"}
RESUME_IMPORT = "Resume import"
RETRY = "Retry"
RESUME_SCAN = "Resume — may restart from the beginning"
START_AGAIN = "Start again"
USE_ARCHIVE = "Use Takeout instead →"
NO_SOURCE = "Ingestion"
STALL_AFTER_S = 15
CONSENT_ORIGIN = "https://accounts.google.com"


def _round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def progress_fraction(run) -> Column:
    """Share done: by bytes when known, else by estimate, else NULL."""
    def share(done, total):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total))

    return F.when(
        (run["bytes_total"] > 0) & run["bytes_done"].isNotNull(),
        share(run["bytes_done"], run["bytes_total"]),
    ).when(run["total_estimate"] > 0, share(run["messages_seen"], run["total_estimate"]))


def import_percent(bytes_done: Column, bytes_total: Column) -> Column:
    """Whole percent of an archive; an empty archive is complete."""
    return F.when(
        bytes_total > 0, F.floor(F.least(bytes_done, bytes_total) * 100 / bytes_total)
    ).otherwise(F.lit(100)).cast("long")


def duration_text(seconds: Column) -> Column:
    s = F.greatest(F.lit(0).cast("long"), _round_half_up(seconds))
    m = _round_half_up(s / 60)
    return (
        F.when(s < 90, F.concat(s.cast("string"), F.lit("s")))
        .when(m < 90, F.concat(m.cast("string"), F.lit(" min")))
        .otherwise(F.concat(
            F.floor(m / 60).cast("string"), F.lit(" h "), (m % 60).cast("string"), F.lit(" min")
        ))
    )


def relative_time(now_unix: Column, then_unix: Column) -> Column:
    d = F.greatest(F.lit(0).cast("long"), now_unix - then_unix)
    return (
        F.when(d < 60, F.lit("just now"))
        .when(d < 3600, F.concat(_round_half_up(d / 60).cast("string"), F.lit(" min ago")))
        .when(d < 172800, F.concat(_round_half_up(d / 3600).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(_round_half_up(d / 86400).cast("string"), F.lit(" d ago")))
    )


def source_label(source: Column) -> Column:
    label = F.when(F.lit(False), F.lit(""))
    for key, text in SOURCE_LABELS.items():
        label = label.when(source == key, text)
    return label.otherwise(F.coalesce(F.nullif(source, F.lit("")), F.lit(NO_SOURCE)))


def state_label(state: Column) -> Column:
    return F.coalesce(*[F.when(state == key, text) for key, text in STATE_LABELS.items()], state)


def is_stalled(now_unix: Column, updated_at_unix: Column) -> Column:
    return now_unix - updated_at_unix > STALL_AFTER_S


def recovery_actions(run) -> Column:
    """Labels of what can be done about a run that ended early."""
    ended = run["state"].isin("failed", "cancelled", "abandoned")
    mbox, api = run["source"] == "mbox", run["source"] == "gmail_api"
    has_path = F.coalesce(run["mbox_path"], F.lit("")) != ""
    some_bytes = F.coalesce(run["bytes_done"], F.lit(0)) > 0
    some_messages = F.coalesce(run["messages_seen"], F.lit(0)) > 0
    broke = run["state"].isin("failed", "abandoned")
    offers = F.array(
        F.when(mbox & some_bytes & has_path, RESUME_IMPORT),
        F.when(mbox & ~some_bytes & has_path, RETRY),
        F.when(api & broke, RETRY),
        F.when(api & some_messages, RESUME_SCAN),
        F.when(api & ~some_messages & (run["state"] == "cancelled"), START_AGAIN),
        F.when(run["error_kind"] == "policy_enforced", USE_ARCHIVE),
    )
    none = F.array().cast("array<string>")
    return F.when(ended, F.array_compact(offers)).otherwise(none)


def is_consent_url(url: Column) -> Column:
    """True only for https links on the exact consent host.

    The prefix ends the host name, so nothing after it can change the origin.
    """
    return F.coalesce(F.startswith(url, F.lit(CONSENT_ORIGIN + "/")), F.lit(False))
