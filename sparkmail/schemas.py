"""Fixed table layouts shared by the sources, operators and streaming sinks."""

from pyspark.sql import types as T

# One landed message document: a full or a metadata-only fetch.
MESSAGE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("labelIds", T.ArrayType(T.StringType())),
    T.StructField("payload", T.StructType([
        T.StructField("headers", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("value", T.StringType()),
        ]))),
    ])),
])

# One message on its way into the ledger. `seq` may be any orderable type; it
# fixes which copy of a message comes first.
BATCH_COLUMNS = ["seq", "mail_id", "rfc_message_id", "sender"]

# rfc_message_id has three states: NULL = not known yet, '' = looked up and
# the message has none, anything else = the normalized id.
SEEN_SCHEMA = T.StructType([
    T.StructField("mail_id", T.StringType()),
    T.StructField("rfc_message_id", T.StringType()),
])

LEDGER_SCHEMA = T.StructType([
    T.StructField("mail_id", T.StringType()),
    T.StructField("rfc_message_id", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("counted", T.BooleanType()),
    T.StructField("epoch", T.StringType()),
])

REPAIRS_SCHEMA = T.StructType([
    T.StructField("mail_id", T.StringType()),
    T.StructField("rfc_message_id", T.StringType()),
    T.StructField("sender", T.StringType()),
    T.StructField("duplicate", T.BooleanType()),
    T.StructField("epoch", T.StringType()),
])

SENDERS_SCHEMA = T.StructType([
    T.StructField("sender", T.StringType()),
    T.StructField("mails_sent", T.LongType()),
    T.StructField("epoch", T.StringType()),
])

COMMITS_SCHEMA = T.StructType([
    T.StructField("epoch", T.StringType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("messages_seen", T.LongType()),
    T.StructField("messages_new", T.LongType()),
    T.StructField("bytes_done", T.LongType()),
    T.StructField("resume_token", T.StringType()),
    # Of the run up to and with this batch.
    T.StructField("total_seen", T.LongType()),
    T.StructField("total_new", T.LongType()),
    T.StructField("total_bytes", T.LongType()),
])

# Message-IDs that are recorded, for the test across sources.
LEDGER_IDS_SCHEMA = T.StructType([
    T.StructField("rfc_message_id", T.StringType()),
    T.StructField("epoch", T.StringType()),
])

# How far the files of an import are committed. A file that changed has another fingerprint.
OFFSETS_SCHEMA = T.StructType([
    T.StructField("checkpoint", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("committed", T.LongType()),
    T.StructField("epoch", T.StringType()),
])

# Append-only run log. `event` is one of created, progress, auth, finished,
# abandoned, heartbeat; only the columns that event sets are non-null.
RUN_EVENTS_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("event_seq", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("at_unix", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("pid", T.LongType()),
    T.StructField("messages_seen", T.LongType()),
    T.StructField("messages_new", T.LongType()),
    T.StructField("total_estimate", T.LongType()),
    T.StructField("bytes_total", T.LongType()),
    T.StructField("bytes_done", T.LongType()),
    T.StructField("resume_token", T.StringType()),
    T.StructField("mbox_path", T.StringType()),
    T.StructField("mbox_fingerprint", T.StringType()),
    T.StructField("error_kind", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("auth_url", T.StringType()),
])

# Display columns of a run; the resume token and the file fingerprint are
# bookkeeping and stay internal.
PUBLIC_RUN_COLUMNS = [
    "run_id", "source", "state", "pid", "started_at_unix", "updated_at_unix",
    "finished_at_unix", "messages_seen", "messages_new", "total_estimate",
    "bytes_total", "bytes_done", "mbox_path", "error_kind", "error", "auth_url",
]
RUN_COLUMNS = PUBLIC_RUN_COLUMNS + ["resume_token", "mbox_fingerprint"]

# Sources, run states and error kinds.
SOURCES = ["gmail_api", "mbox", "backfill"]
OPEN_STATES = ["starting", "awaiting_auth", "running"]
TERMINAL_STATES = ["done", "failed", "cancelled", "abandoned"]
ERROR_KINDS = [
    "policy_enforced", "missing_credentials", "auth_required", "io", "db", "rate_limited", "gmail_api", "other",
]
