"""Streaming drivers: folders of archives and of landed documents."""

from __future__ import annotations

import logging
import random
import re
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from sparkmail.functions.errors import MAX_BACKOFF_DOUBLINGS, MAX_RETRIES, error_kind
from sparkmail.operators.runs import latest_runs
from sparkmail.operators.summary import unrepaired
from sparkmail.sources import mbox_ranges
from sparkmail.sources.mbox_ranges import Progress
from sparkmail.sources.messages import stream_messages
from sparkmail.streaming.store import StatsStore


logger = logging.getLogger(__name__)
# Fixed value: seconds between two signs of life of a run.
HEARTBEAT_S = 5.0
BATCH_BYTES = 64 << 30  # of archives that an import commits at once
# Fixed value: labels of messages that a listing leaves out.
UNLISTED = ["SPAM", "TRASH"]
# Failures that may pass, by the names in their text: a lost connection, a time that ran out, a store that asks to wait.
PASSING = re.compile(
    r"\b(?:Connection\w*Error|BrokenPipeError|TimeoutError|SocketException|SocketTimeoutException|Connect\w*Exception"
    r"|NoRouteToHostException|UnknownHostException|NoHttpResponseException|TimeoutException|SlowDown|TooManyRequests"
    r"|ServiceUnavailable|InternalError|Status Code: (?:429|5\d\d))\b")


@contextmanager
def beating(
    store: StatsStore, run_id: int, progress: Progress | None = None, every: float = HEARTBEAT_S,
) -> Iterator[None]:
    """Signs of life while a block runs, also inside one long batch.

    A sign is one small file, no Spark job. With `progress` it says what the tasks that ended have scanned on top of what
    is committed. A sign that cannot be written is tried again at the next beat.
    """
    over = threading.Event()

    def beat() -> None:
        while not over.wait(every):
            try:
                if progress is None:
                    store.record(run_id, "heartbeat")
                    continue
                done = store.totals(run_id)
                store.record(run_id, "progress", messages_seen=done.get("total_seen", 0) + progress.messages.value,
                             bytes_done=(done.get("total_bytes") or 0) + progress.bytes.value)
            except Exception as e:  # noqa: BLE001
                logger.warning("run %s: no sign of life written: %s", run_id, e)

    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def failure_kind(store: StatsStore, error: Exception, origin: str) -> str:
    """The kind of error a run ends with; paths that are gone count as such."""
    if isinstance(error, FileNotFoundError) or isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND":
        origin = "not_found"
    message = F.lit(str(error))
    return store.spark.range(1).select(error_kind(message, F.lit(origin), F.lit(False))).first()[0]


@contextmanager
def _closing(store: StatsStore, run_id: int, origin: str, state: str = "done") -> Iterator[None]:
    """Close a run as the block ends. `origin` says what its errors come from, unless they tell."""
    try:
        yield
    except KeyboardInterrupt:
        store.finish_run(run_id, "cancelled")
        raise
    except Exception as e:
        store.finish_run(run_id, "failed", failure_kind(store, e, origin), str(e).splitlines()[0])
        raise
    store.finish_run(run_id, state)


def _wait(retries: int) -> None:
    """Before a try: 1, 2, 4 ... 32 seconds and up to one more."""
    time.sleep(2 ** min(retries - 1, MAX_BACKOFF_DOUBLINGS) + random.random())


def _drain(
    store: StatsStore, run_id: int, rows: Callable[[], DataFrame], apply: Callable[[DataFrame, int, int], None],
    checkpoint: str, origin: str, most: int = 0,
) -> int:
    """Run one ingest until the folder holds nothing new; returns its run_id.

    The checkpoint remembers finished files, so the next run resumes there;
    what it replays is dropped by the ledger. A failure that may pass is tried
    again from the batch that failed, up to `most` times in a row; a batch that
    was committed in between starts the count over.
    """
    with _closing(store, run_id, origin), beating(store, run_id):
        retries, committed = 0, None
        while True:
            query: StreamingQuery | None = None
            try:
                query = (
                    rows().writeStream.foreachBatch(lambda df, batch_id: apply(df, run_id, batch_id))
                    .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
                )
                query.awaitTermination()
                if retries:
                    store._publish()  # of a batch that failed behind its commit
                break
            except Exception as e:  # noqa: BLE001
                if not most or not PASSING.search(str(e)):
                    raise
                before, committed = committed, store.totals(run_id).get("batch_id")
                retries = retries + 1 if committed == before else 1
                if retries > most:
                    raise
                logger.warning("run %s: try %s of %s after: %s", run_id, retries, most, str(e).splitlines()[0])
            finally:
                if query is not None:
                    query.stop()
            _wait(retries)
    return run_id


def import_mbox(
    store: StatsStore, folder: str, checkpoint: str, max_files: int | None = None, batch_bytes: int = BATCH_BYTES,
    max_batches: int | None = None,
) -> int:
    """Import the archives of a folder, or one archive, from where imports with this checkpoint have stopped.

    The bytes that are left are taken in batches of ranges; each batch commits its messages and how far the files are done
    in one marker. A killed import goes on behind the last marker, inside a file as well. A file whose size, time or first
    bytes changed is read from its start; what was recorded is known by the ledger. The run's total is the bytes left, its
    fingerprint that of the file, or of all files together. With max_batches it stops after so many, as cancelled if bytes
    are left.
    """
    try:
        found = mbox_ranges.archives(folder)
    except FileNotFoundError as e:
        run_id = store.start_run("mbox", mbox_path=folder)
        store.finish_run(run_id, "failed", failure_kind(store, e, "io"), str(e).splitlines()[0])
        raise
    good = [a for a in found if not a.refused]
    batches = mbox_ranges.plan_batches(good, store.offsets(checkpoint), batch_bytes, max_files)
    run_id = store.start_run(
        "mbox", mbox_path=folder, bytes_total=sum(r.stop - r.start for b in batches for r in b),
        mbox_fingerprint=mbox_ranges.joint_fingerprint(good))
    progress = mbox_ranges.Progress(store.spark)
    left = max_batches is not None and len(batches) > max_batches
    with _closing(store, run_id, "io", "cancelled" if left else "done"), beating(store, run_id, progress):
        for batch_id, ranges in enumerate((batches or [[]])[:max_batches]):
            if ranges or any(a.refused for a in found):
                store.apply_ranges(ranges, found, checkpoint, run_id, batch_id, progress)
            progress.reset()
    return run_id


def scan_messages(
    store: StatsStore, folder: str, checkpoint: str, max_files: int | None = None, total_estimate: int | None = None,
    after_page: str | None = None,
) -> int:
    """Ingest landed documents; the mailbox total, where known, feeds the ETA.

    Each batch commits the name of its last page file as the run's resume token. `after_page`, such a token, leaves out the
    pages up to it where the checkpoint is gone; for pages that land in the order of their names. A token that names no page
    of the folder is no good any more: the scan begins with the first page. Messages with a label of UNLISTED are left out,
    as a listing leaves them out. Failures that may pass are tried again MAX_RETRIES times.
    """
    run_id = store.start_run("gmail_api", total_estimate=total_estimate, resume_token=after_page)

    def rows() -> DataFrame:
        landed = stream_messages(store.spark, folder, max_files)
        listed = landed.filter(~F.coalesce(F.arrays_overlap("labelIds", F.array(*map(F.lit, UNLISTED))), F.lit(False)))
        if after_page is None or not _has_page(store, folder, after_page):
            return listed
        return listed.filter(F.substring_index("landed.file", "/", -1) > after_page)

    return _drain(store, run_id, rows, store.apply_messages, checkpoint, "other", MAX_RETRIES)


def _has_page(store: StatsStore, folder: str, name: str) -> bool:
    """Whether a page file of the folder has this name; only names are read."""
    files = store.spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_path").alias("file"))
    return not files.filter(F.substring_index("file", "/", -1) == name).isEmpty()


def repair(store: StatsStore, folder: str, checkpoint: str, max_files: int | None = None) -> int:
    """Repair pass over landed metadata documents of unrepaired messages."""
    pending = unrepaired(store.seen()).count()
    run_id = store.start_run("backfill", total_estimate=pending)
    if pending == 0:
        store.finish_run(run_id, "done")
        return run_id
    rows = lambda: stream_messages(store.spark, folder, max_files)
    return _drain(store, run_id, rows, store.apply_repair, checkpoint, "other")


def watch_runs(store: StatsStore, checkpoint: str) -> StreamingQuery:
    """Keep the `latest_runs` table at the state the run log adds up to."""
    return (
        latest_runs(store.stream_events()).writeStream.outputMode("complete")
        .foreachBatch(lambda runs, _: store.replace("latest_runs", store.with_folded(runs)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def watch_senders(store: StatsStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the `live_senders` table at the running sums of all committed changes; the sums are the stream's state."""
    sums = store.stream_changes().groupBy("sender").agg(F.sum("n").alias("mails_sent"))
    writer = sums.writeStream.outputMode("complete").foreachBatch(lambda found, _: store.replace("live_senders", found)) \
        .option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_senders(store: StatsStore) -> DataFrame:
    """What watch_senders() wrote last."""
    return store.newest("live_senders", T.StructType.fromDDL("sender string, mails_sent long"))


def print_senders(rows: DataFrame) -> StreamingQuery:
    """Verbose listing: the sender of every message on the console."""
    return rows.select("sender").writeStream.format("console").start()
