"""Ingest runs: state from the event log, history, lookups, log tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkmail.functions.errors import backoff_seconds, gives_up
from sparkmail.operators.ordered import carry_by_volume, carry_last, newest_per_key
from sparkmail.schemas import PUBLIC_RUN_COLUMNS, RUN_COLUMNS, TERMINAL_STATES

# History limits and log retention.
DEFAULT_HISTORY, MAX_HISTORY = 20, 100
LOG_LINES, LOG_TAIL = 200, 5


def latest_runs(events: DataFrame) -> DataFrame:
    """One row per run: every column holds its last non-null value."""
    seq = F.col("event_seq")

    def last(value, when: Column | None = None) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.max_by(value, F.when(value.isNotNull() if when is None else when, seq))

    event = F.col("event")
    ended = event.isin("finished", "abandoned")
    zero = F.lit(0).cast("long")
    columns = {c: last(c) for c in RUN_COLUMNS if c in events.columns} | {
        "started_at_unix": last("at_unix", event == "created"),
        "updated_at_unix": last("at_unix"),
        "finished_at_unix": last("at_unix", ended),
        "messages_seen": F.coalesce(last("messages_seen"), zero),
        "messages_new": F.coalesce(last("messages_new"), zero),
        # A consent event sets or clears the link; it is not kept when NULL.
        "auth_url": last(F.struct("auth_url"), event == "auth")["auth_url"],
        "error_kind": last(F.struct("error_kind"), event == "finished")["error_kind"],
        "error": last(F.struct("error"), event == "finished")["error"],
    }
    return events.groupBy("run_id").agg(
        *[columns[c].alias(c) for c in RUN_COLUMNS if c != "run_id"]
    ).select(*RUN_COLUMNS)


def is_terminal(state: Column) -> Column:
    return state.isin(TERMINAL_STATES)


def active_run(runs: DataFrame) -> DataFrame:
    return runs.filter(~is_terminal(F.col("state"))).orderBy(F.desc("run_id")).limit(1)


def last_run(runs: DataFrame) -> DataFrame:
    return runs.filter(is_terminal(F.col("state"))).orderBy(F.desc("run_id")).limit(1)


def history(runs: DataFrame, limit: int | str | None = DEFAULT_HISTORY) -> DataFrame:
    """Newest runs first; a limit that is no number means the default."""
    try:
        n = int(limit)
    except (TypeError, ValueError):
        n = DEFAULT_HISTORY
    return runs.orderBy(F.desc("run_id")).limit(min(max(n, 1), MAX_HISTORY))


def public(runs: DataFrame) -> DataFrame:
    return runs.select(*[c for c in PUBLIC_RUN_COLUMNS if c in runs.columns])


def history_document(runs: DataFrame, now_unix: int, limit: int | str | None = DEFAULT_HISTORY) -> DataFrame:
    """The run history as one JSON document; it holds at most 100 runs."""
    newest = public(history(runs, limit))
    listed = F.sort_array(F.collect_list(F.struct(*newest.columns)), asc=False)
    return newest.agg(F.to_json(
        F.struct(listed.alias("runs"), F.lit(now_unix).cast("long").alias("now_unix")), {"ignoreNullFields": "false"}
    ).alias("document"))


def abandon_stale(runs: DataFrame, now_unix: int) -> DataFrame:
    """Runs left open by a dead ingester become abandoned."""
    open_ = ~is_terminal(F.col("state"))
    now = F.lit(now_unix).cast("long")
    return runs.withColumns({
        "finished_at_unix": F.when(open_, now).otherwise(F.col("finished_at_unix")),
        "updated_at_unix": F.when(open_, now).otherwise(F.col("updated_at_unix")),
        "state": F.when(open_, F.lit("abandoned")).otherwise(F.col("state")),
    })


def run_by_id(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def scan_resume_token(runs: DataFrame, run_id: int) -> str | None:
    """Saved page token of a scan run; None means scan from the beginning."""
    run = run_by_id(runs, run_id).select("source", "resume_token").first()
    if run is None:
        raise ValueError(f"unknown run: {run_id}")
    if run["source"] != "gmail_api":
        raise ValueError(f"only API scans resume by page; run {run_id} came from {run['source']}")
    return run["resume_token"] or None


def max_run_id(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.max("run_id"), F.lit(0).cast("long")).alias("max_run_id"))


def newest_of_process(runs: DataFrame, after: int) -> DataFrame:
    """pid → its newest run after run `after`."""
    return runs.filter(F.col("run_id") > after).groupBy("pid").agg(F.max("run_id").alias("run_id"))


def retry_schedule(attempts: DataFrame, tile: int = 10_000) -> DataFrame:
    """Failed attempts (run_id, attempt_no, made_progress, transient) with the
    failures in a row, the wait before the next try, and whether to give up.

    An attempt that finished at least one page starts the count over.
    """
    rows = carry_last(
        attempts, ["run_id"], "attempt_no", F.when(F.col("made_progress"), F.col("attempt_no")),
        "last_progress", tile, inclusive=True,
    )
    retries = F.col("attempt_no") - F.coalesce("last_progress", F.lit(1).cast("long")) + 1
    return rows.withColumn("retries", retries).select(
        "run_id", "attempt_no", "retries",
        backoff_seconds(F.col("retries")).alias("wait_s"),
        gives_up(F.col("retries"), F.col("transient")).alias("gives_up"),
    )


def _cut_bytes(line: Column, limit: int) -> Column:
    """At most `limit` bytes, ending on a whole character."""
    raw = line.cast("binary")
    cuts = [F.substring(raw, 1, limit - k).cast("string") for k in range(4)]
    return F.when(F.octet_length(line) <= limit, line).otherwise(
        F.coalesce(*[F.when(F.is_valid_utf8(c), c) for c in cuts])
    )


def _newest_lines(lines: DataFrame, count: int, line_bytes: int | None) -> DataFrame:
    kept = newest_per_key(lines, "run_id", "line_no", count)
    return kept if line_bytes is None else kept.withColumn("line", _cut_bytes(F.col("line"), line_bytes))


def kept_log(lines: DataFrame, line_bytes: int | None = None) -> DataFrame:
    """The newest 200 lines of each run (run_id, line_no, line), whole unless
    `line_bytes` says where to cut them."""
    return _newest_lines(lines, LOG_LINES, line_bytes)


def log_tail(lines: DataFrame, line_bytes: int | None = None) -> DataFrame:
    """run_id → its last five lines in order, joined with ' | '."""
    last = _newest_lines(lines, LOG_TAIL, line_bytes)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return last.groupBy("run_id").agg(F.concat_ws(" | ", ordered["line"]).alias("tail"))


def history_refreshes(observations: DataFrame, viewer: str) -> DataFrame:
    """Observations at which a viewer must reload the run history: the pair
    (active run and state, last run and state) differs from the one before."""
    def key(run_id, state):
        return F.coalesce(F.concat(F.col(run_id).cast("string"), F.lit(":"), F.col(state)), F.lit("-"))

    keyed = observations.withColumn(
        "runs_key",
        F.concat_ws("|", key("active_run_id", "active_state"), key("last_run_id", "last_state")),
    )
    rows = carry_by_volume(keyed, [viewer], "t_us", F.col("runs_key"), "before")
    return rows.filter(~F.col("runs_key").eqNullSafe(F.col("before"))).drop("before")
