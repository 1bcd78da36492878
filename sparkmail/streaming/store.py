"""Statistics tables as Parquet folders with one commit marker per batch.

Each batch has an epoch, `run-batch`. It writes its own partitions and, last,
its commit marker. Readers only use committed epochs, so a batch that dies
half way leaves nothing behind, a retry overwrites its own partitions, and a
batch that was committed before is not applied again. One query writes a
store at a time.

The ledger, its Message-IDs, repairs and sender counters are Spark tables
bucketed by the key they are looked up with. A batch is dealt into the same
buckets and joined bucket by bucket, so what is stored is never shuffled. Of
the counters a batch writes the senders it touched; the newest row of a sender
holds, and now and then all of them are written again as one epoch.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkmail import schemas
from sparkmail.operators import counters, dedupe, runs as run_ops, summary
from sparkmail.sources import mbox, mbox_ranges
from sparkmail.sources.messages import message_fields

BASELINE_EPOCH = f"{0:010d}-{0:012d}"
SENDER_EPOCHS = 16  # batches after which the counters are written as one epoch again
# The tables that are bucketed, and by what.
BUCKETED = {
    "ledger": (schemas.LEDGER_SCHEMA, "mail_id"), "ledger_ids": (schemas.LEDGER_IDS_SCHEMA, "rfc_message_id"),
    "repairs": (schemas.REPAIRS_SCHEMA, "mail_id"), "senders": (schemas.SENDERS_SCHEMA, "sender"),
}


def epoch_of(run_id: int, batch_id: int) -> str:
    return f"{run_id:010d}-{batch_id:012d}"


class StatsStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """`buckets` is for a store that does not exist yet; an existing one keeps its number. A bucket of the ids is one
        task of a batch, so size them as shuffle partitions are sized, whose number is the default."""
        self.spark, self.root = spark, root
        self._wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # --- files ----------------------------------------------------------

    def _path(self, *parts: str) -> str:
        return posixpath.join(self.root, *parts)

    def _file(self, *parts: str):
        """A path and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(*parts))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        """What a folder holds, in order; hidden names and a folder that is not there give nothing."""
        path, system = self._file(*parts)
        names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
        return sorted(n for n in names if n[0] not in "._")

    def _put_file(self, text: str, *parts: str) -> None:
        """A small file, visible as a whole or not at all."""
        target, system = self._file(*parts)
        hidden, _ = self._file(*parts[:-1], "_" + parts[-1])
        out = system.create(hidden, True)
        out.write(text.encode())
        out.close()
        if system.exists(target):
            system.delete(target, False)
        if not system.rename(hidden, target):
            raise OSError(f"cannot write {target.toString()}")

    def _read_file(self, *parts: str) -> str | None:
        path, system = self._file(*parts)
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _delete(self, *parts: str) -> None:
        path, system = self._file(*parts)
        system.delete(path, True)

    # --- tables ---------------------------------------------------------

    def exists(self, name: str) -> bool:
        path, system = self._file(name)
        return system.exists(path)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """A table; one that was never written is empty."""
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _few_rows(self, rows: list[tuple], schema: T.StructType) -> DataFrame:
        """A handful of literal rows in one partition."""
        structs = [
            F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(schema.fields, row)]) for row in rows
        ]
        return self.spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))

    def _write(self, df: DataFrame, name: str, epoch: str) -> DataFrame:
        """Replace one epoch of a table and read it back, so that what follows
        starts from stored rows."""
        path = self._path(name, f"epoch={epoch}")
        df.drop("epoch").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.drop("epoch").schema).parquet(path)

    def _drop(self, name: str, *epochs: str) -> None:
        """Delete epochs of a table that nothing reads any more."""
        for epoch in epochs:
            self._delete(name, f"epoch={epoch}")

    def _epochs(self, name: str) -> list[str]:
        """Epochs of a table from the listing of its folder, oldest first."""
        return [n.removeprefix("epoch=") for n in self._names(name) if n.startswith("epoch=")]

    def _drop_all_but(self, name: str, keep: int) -> None:
        """Keep the newest epochs: one to read, and the one a reader may be at."""
        self._drop(name, *self._epochs(name)[:-keep])

    # --- bucketed tables ------------------------------------------------

    @property
    def buckets(self) -> int:
        """The number of buckets, fixed when the store is first written."""
        text = self._read_file("layout.json")
        if text is None:
            text = json.dumps({"buckets": self._wanted})
            self._put_file(text, "layout.json")
        return json.loads(text)["buckets"]

    def _table(self, name: str) -> str:
        """The catalog's name of a bucketed table, which knows the epochs that are there now."""
        schema, key = BUCKETED[name]
        table = f"sparkmail_{name}_{hashlib.md5(self.root.encode()).hexdigest()[:16]}"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            place = self._path(name).replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (epoch) "
                f"CLUSTERED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        if self.exists(name):
            self.spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")
            self.spark.catalog.refreshTable(table)
        return table

    def dealt(self, df: DataFrame, key: str) -> DataFrame:
        """Rows in the buckets of the tables with this key. Reduce rows per key first: a bucket is one task."""
        return df.repartition(self.buckets, key)

    def _write_bucketed(self, df: DataFrame, name: str, epoch: str) -> DataFrame:
        """Write one epoch of a bucketed table, anew if it was not committed, and read it back. Rows that are dealt
        already make one file per bucket."""
        schema, _ = BUCKETED[name]
        self._drop(name, epoch)
        table = self._table(name)
        df.select(*[c for c in schema.names if c != "epoch"]).createOrReplaceTempView(f"{table}_rows")
        self.spark.sql(f"INSERT INTO TABLE {table} PARTITION (epoch = '{epoch}') SELECT * FROM {table}_rows")
        return self.spark.table(table).filter(F.col("epoch") == epoch)

    def _committed(self, name: str) -> DataFrame:
        """Rows of a bucketed table but for epochs without a commit marker. The few of these are left out by name, so
        the buckets stay as they are stored."""
        schema, _ = BUCKETED[name]
        if not self.exists(name):
            return self.spark.createDataFrame([], schema)
        table = self.spark.table(self._table(name))
        open_ = set(self._epochs(name)) - set(self._done()) - set(self._folds())
        return table.filter(~F.col("epoch").isin(sorted(open_))) if open_ else table

    # --- commits --------------------------------------------------------

    def _done(self) -> list[str]:
        """Committed epochs, oldest first."""
        return [n.removesuffix(".json") for n in self._names("commits")]

    def commits(self) -> DataFrame:
        if not self._done():
            return self.spark.createDataFrame([], schemas.COMMITS_SCHEMA)
        return self.spark.read.schema(schemas.COMMITS_SCHEMA).json(self._path("commits"))

    def totals(self, run_id: int) -> dict:
        """What a run has committed: its last marker, {} before the first."""
        mine = [e for e in self._done() if e.startswith(f"{run_id:010d}-")]
        return json.loads(self._read_file("commits", mine[-1] + ".json")) if mine else {}

    def _is_done(self, epoch: str) -> bool:
        path, system = self._file("commits", epoch + ".json")
        return system.exists(path)

    def _commit(
        self, epoch: str, run_id: int, batch_id: int, seen: int, new: int, bytes_done: int | None = None,
        resume_token: str | None = None,
    ) -> None:
        """Make the epoch visible, its page token with it, then report the run's totals."""
        before = self.totals(run_id)
        total_bytes = None if bytes_done is None else (before.get("total_bytes") or 0) + bytes_done
        row = {
            "epoch": epoch, "run_id": run_id, "batch_id": batch_id, "messages_seen": seen, "messages_new": new,
            "bytes_done": bytes_done, "resume_token": resume_token or before.get("resume_token"),
            "total_seen": before.get("total_seen", 0) + seen, "total_new": before.get("total_new", 0) + new,
            "total_bytes": total_bytes,
        }
        self._put_file(json.dumps(row) + "\n", "commits", epoch + ".json")
        if run_id:
            self.record(run_id, "progress", messages_seen=row["total_seen"], messages_new=row["total_new"],
                        bytes_done=total_bytes, resume_token=row["resume_token"])

    # --- what is stored -------------------------------------------------

    def ledger(self) -> DataFrame:
        return self._committed("ledger")

    def seen(self) -> DataFrame:
        """Recorded messages with the ids that repairs found since."""
        rows = self.ledger().select("mail_id", "rfc_message_id")
        return dedupe.apply_repairs(rows, self._committed("repairs")) if self.exists("repairs") else rows

    def known_ids(self) -> DataFrame:
        """Message-IDs of recorded messages; a repaired one may be there twice."""
        return self._committed("ledger_ids").select("rfc_message_id")

    def senders(self) -> DataFrame:
        """Counters after the latest committed batch."""
        return counters.newest(self._committed("senders"))

    def _count(self, deltas: DataFrame, change, epoch: str) -> None:
        """Write the counters of the senders in `deltas` as they are after this batch, and by how much each one moved."""
        touched = self.dealt(deltas, "sender")
        before = self._committed("senders").filter(F.col("epoch") < epoch)
        stored = counters.newest(before.join(touched.select("sender"), "sender", "left_semi"))
        after = self._write_bucketed(change(stored, touched), "senders", epoch)
        self._log_changes(after, stored, epoch)

    def _log_changes(self, after: DataFrame, before: DataFrame, epoch: str) -> None:
        """Changes of counters, hidden until their epoch is committed."""
        old = before.select("sender", F.col("mails_sent").alias("old"))
        moved = F.coalesce("mails_sent", F.lit(0)) - F.coalesce("old", F.lit(0))
        changes = after.join(old, "sender", "left").select("sender", moved.alias("n")).filter("n <> 0")
        changes.write.mode("overwrite").parquet(self._path("sender_log", "_" + epoch))

    def _publish(self) -> None:
        """Show the changes of committed epochs to streams, each once: a rename. A run that died in between is made up for."""
        path, system = self._file("sender_log")
        if not system.exists(path):
            return
        done = set(self._done())
        for hidden in sorted(f.getPath().getName() for f in system.listStatus(path)):
            if hidden[0] == "_" and hidden[1:] in done:
                system.rename(self._file("sender_log", hidden)[0], self._file("sender_log", hidden[1:])[0])

    def stream_changes(self) -> DataFrame:
        """sender and n of every committed batch, as they come."""
        path, system = self._file("sender_log")
        system.mkdirs(path)
        return self.spark.readStream.schema("sender string, n long").option("recursiveFileLookup", True) \
            .parquet(self._path("sender_log"))

    def _fold_senders(self) -> None:
        """After SENDER_EPOCHS batches write all counters as one epoch, right behind the newest. The epochs before it go
        when this happens again, so a reader may finish."""
        folds = self._folds()
        epochs = self._epochs("senders")
        if len([e for e in epochs if not folds or e > folds[-1]]) < SENDER_EPOCHS:
            return
        fold = epochs[-1] + "-all"
        self._write_bucketed(self.senders(), "senders", fold)
        self._put_file("{}\n", "sender_folds", fold + ".json")
        if folds:
            self._drop("senders", *[e for e in epochs if e < folds[-1]])
            self._delete("sender_folds", folds[-1] + ".json")

    def _folds(self) -> list[str]:
        return [n.removesuffix(".json") for n in self._names("sender_folds")]

    def rejected_files(self) -> DataFrame:
        """Files of the import folder that were refused, and why."""
        schema = T.StructType.fromDDL("file string, reason string, epoch string")
        return self.read("rejected", schema).filter(F.col("epoch").isin(self._done())).select("file", "reason").distinct()

    def offsets(self, checkpoint: str) -> dict[str, tuple[str, int]]:
        """file → (fingerprint, committed bytes) of imports with this checkpoint; one row per file."""
        if not self.exists("mbox_offsets"):
            return {}
        rows = self.read("mbox_offsets", schemas.OFFSETS_SCHEMA).filter(F.col("checkpoint") == checkpoint)
        open_ = set(self._epochs("mbox_offsets")) - set(self._done())
        newest = rows.filter(~F.col("epoch").isin(sorted(open_))).groupBy("file") \
            .agg(F.max_by(F.struct("fingerprint", "committed"), F.struct("epoch", "committed")).alias("r"))
        return {r["file"]: (r["r"]["fingerprint"], r["r"]["committed"]) for r in newest.toLocalIterator()}

    def replace(self, name: str, df: DataFrame) -> None:
        """Write a new version of a table beside the one that readers use."""
        self._write(df, name, f"{time.time_ns():020d}")
        self._drop_all_but(name, 2)

    def newest(self, name: str, schema: T.StructType) -> DataFrame:
        """The version of a table that was replaced last."""
        versions = self._epochs(name)
        return self.read(f"{name}/epoch={versions[-1]}" if versions else name, schema)

    # --- batches --------------------------------------------------------

    def _apply(
        self, batch: DataFrame, seen: int, run_id: int, batch_id: int, source: str, bytes_done: int | None = None,
        resume_token: str | None = None,
    ) -> None:
        epoch = epoch_of(run_id, batch_id)
        first = self.dealt(dedupe.first_per_key(batch, "mail_id"), "mail_id")
        fresh = self._write(first.join(self._committed("ledger").select("mail_id"), "mail_id", "left_anti"), "staged_fresh", epoch)
        ids = self.dealt(dedupe.holders(fresh), "rfc_message_id")
        holds = ids.join(self.known_ids(), "rfc_message_id", "left_anti").select("mail_id").withColumn("holds", F.lit(True))
        flagged = dedupe.flag_counted(self.dealt(fresh, "mail_id"), self.dealt(holds, "mail_id")).select(
            "mail_id", "rfc_message_id", "sender",
            F.lit(source).alias("source"), F.lit(run_id).cast("long").alias("run_id"), "counted",
        )
        mine = self._write_bucketed(flagged, "ledger", epoch)
        self._write_bucketed(ids.select("rfc_message_id"), "ledger_ids", epoch)
        self._count(counters.increments(mine), counters.add_counts, epoch)
        self._commit(epoch, run_id, batch_id, seen, mine.filter("counted").count(), bytes_done, resume_token)
        self._publish()
        self._drop("staged_fresh", epoch)
        self._fold_senders()

    def apply_ranges(
        self, ranges: list[mbox_ranges.Range], found: list[mbox_ranges.Archive], checkpoint: str, run_id: int, batch_id: int,
        watch=None,
    ) -> None:
        """Import the messages that begin in byte ranges of archives, and commit how far their files are done."""
        epoch = epoch_of(run_id, batch_id)
        if self._is_done(epoch):
            return
        rows = mbox_ranges.read_ranges(self.spark, ranges, watch=watch)
        staged = self._write(rows, "staged_mbox", epoch)
        prints = {a.file: a.fingerprint for a in found}
        reached = {r.file: r.stop for r in ranges}
        if reached:
            done = [(checkpoint, f, prints[f], stop, None) for f, stop in reached.items()]
            self._write(self._few_rows(done, schemas.OFFSETS_SCHEMA), "mbox_offsets", epoch)
        refused = [(a.file, a.refused) for a in found if a.refused] if batch_id == 0 else []
        if refused:
            self._write(self._few_rows(refused, T.StructType.fromDDL("file string, reason string")), "rejected", epoch)
        batch = mbox.import_batch(staged, F.struct("file", "start_offset"))
        self._apply(batch, staged.filter(~F.col("bad")).count(), run_id, batch_id, "mbox", sum(r.stop - r.start for r in ranges))
        self._drop("staged_mbox", epoch)

    def apply_messages(self, documents: DataFrame, run_id: int, batch_id: int) -> None:
        epoch = epoch_of(run_id, batch_id)
        if self._is_done(epoch):
            return
        token = F.max(F.substring_index("seq.file", "/", -1)) if "landed" in documents.columns else F.lit(None).cast("string")
        staged = self._write(message_fields(documents), "staged_messages", epoch)
        facts = staged.agg(F.count("*").alias("n"), token.alias("token")).first()
        self._apply(staged, facts["n"], run_id, batch_id, "gmail_api", resume_token=facts["token"])
        self._drop("staged_messages", epoch)

    def apply_repair(self, documents: DataFrame, run_id: int, batch_id: int) -> None:
        """Fill in missing ids from fetched documents and take back doubles."""
        epoch = epoch_of(run_id, batch_id)
        if self._is_done(epoch):
            return
        fetched = self._write(message_fields(documents), "staged_repairs", epoch)
        pending = self.seen().filter(F.col("rfc_message_id").isNull()).select("mail_id")
        first = self.dealt(dedupe.first_per_key(fetched, "mail_id"), "mail_id")
        applied = self._write(first.join(pending, "mail_id", "left_semi"), "staged_fresh", epoch)
        ids = self.dealt(dedupe.holders(applied), "rfc_message_id")
        holds = ids.join(self.known_ids(), "rfc_message_id", "left_anti").select("mail_id").withColumn("holds", F.lit(True))
        mine = self._write_bucketed(
            dedupe.flag_repairs(self.dealt(applied, "mail_id"), self.dealt(holds, "mail_id")), "repairs", epoch)
        self._write_bucketed(ids.select("rfc_message_id"), "ledger_ids", epoch)
        self._count(counters.decrements(mine), counters.take_back, epoch)
        done = dedupe.repair_outcome(fetched, mine).first()
        self._commit(epoch, run_id, batch_id, done["examined"], done["populated"] + done["missing_id"])
        self._drop("staged_repairs", epoch)
        self._publish()
        self._drop("staged_fresh", epoch)
        self._fold_senders()

    def import_baseline(self, seen: DataFrame, senders: DataFrame) -> None:
        """Start a store from older tables: collapse repeated mail_ids (needs
        `seq`) and fill the ids that import keys carry."""
        rows = summary.populate_embedded(dedupe.dedupe_stored(seen)).select(
            "mail_id", "rfc_message_id", F.lit(None).cast("string").alias("sender"),
            F.lit("baseline").alias("source"), F.lit(0).cast("long").alias("run_id"),
            F.lit(False).alias("counted"),
        )
        mine = self._write_bucketed(self.dealt(rows, "mail_id"), "ledger", BASELINE_EPOCH)
        self._write_bucketed(self.dealt(dedupe.known_ids(mine), "rfc_message_id"), "ledger_ids", BASELINE_EPOCH)
        kept = senders.select("sender", F.col("mails_sent").cast("long"))
        stored = self._write_bucketed(self.dealt(kept, "sender"), "senders", BASELINE_EPOCH)
        self._log_changes(stored, stored.filter(F.lit(False)), BASELINE_EPOCH)
        self._commit(BASELINE_EPOCH, 0, 0, 0, 0)
        self._publish()

    # --- runs -----------------------------------------------------------

    def events(self) -> DataFrame:
        """Events of the runs that are not folded into rows yet, and of the newest that is."""
        if not self._names("run_events"):
            return self.spark.createDataFrame([], schemas.RUN_EVENTS_SCHEMA)
        return self._event_columns(self.spark.read.schema(schemas.RUN_EVENTS_SCHEMA).json(self._path("run_events")))

    def stream_events(self) -> DataFrame:
        return self._event_columns(self.spark.readStream.schema(schemas.RUN_EVENTS_SCHEMA).json(self._path("run_events")))

    def _event_columns(self, events: DataFrame) -> DataFrame:
        return events.select(*schemas.RUN_EVENTS_SCHEMA.names)

    def folded_runs(self) -> DataFrame:
        """One row per run that was over when the newest one started."""
        schema = run_ops.latest_runs(self.spark.createDataFrame([], schemas.RUN_EVENTS_SCHEMA)).schema
        return self.newest("folded_runs", schema)

    def runs(self) -> DataFrame:
        return self.with_folded(run_ops.latest_runs(self.events()))

    def with_folded(self, runs: DataFrame) -> DataFrame:
        """Rows of runs from their events, but for those that are folded: their row is final."""
        if not self._epochs("folded_runs"):
            return runs
        folded = self.folded_runs()
        return folded.unionByName(runs.join(folded.select("run_id"), "run_id", "left_anti"))

    def record(self, run_id: int, event: str, **columns) -> None:
        """Append one event to the run log: a small file, written without a Spark job."""
        row = {"run_id": run_id, "event_seq": time.time_ns(), "event": event, "at_unix": int(time.time())} | columns
        line = json.dumps({k: v for k, v in row.items() if v is not None})
        self._put_file(line + "\n", "run_events", f"run={run_id:010d}", f"{row['event_seq']:020d}.json")

    def start_run(self, source: str, **columns) -> int:
        """Close the runs a dead ingester left open, fold all rows into one table, then open a new run.

        Of an abandoned run the row says what it has committed. Events go when their run was folded before this, so the
        log has the files of two runs at most.
        """
        self._publish()
        before = self._names("run_events")
        run_id = 1
        if before:
            now = int(time.time())
            totals = self.commits().groupBy("run_id").agg(
                F.max("total_seen").alias("seen"), F.max("total_new").alias("new"), F.max("total_bytes").alias("bytes"))
            known = self.runs()
            open_ = ~run_ops.is_terminal(F.col("state"))
            exact = known.join(totals, "run_id", "left").withColumns({
                "messages_seen": F.when(open_, F.coalesce("seen", F.lit(0))).otherwise(F.col("messages_seen")),
                "messages_new": F.when(open_, F.coalesce("new", F.lit(0))).otherwise(F.col("messages_new")),
                "bytes_done": F.when(open_, F.col("bytes")).otherwise(F.col("bytes_done")),
            }).select(*known.columns)
            self.replace("folded_runs", run_ops.abandon_stale(exact, now))
            for name in before[:-1]:
                self._delete("run_events", name)
            run_id = int(before[-1].removeprefix("run=")) + 1
        self.record(run_id, "created", source=source, state="running", **columns)
        return run_id

    def finish_run(self, run_id: int, state: str, error_kind: str | None = None, error: str | None = None) -> None:
        """Close a run; its counters are what it has committed, whatever was reported on the way."""
        totals = self.totals(run_id)
        self.record(run_id, "finished", state=state, error_kind=error_kind, error=error,
                    messages_seen=totals.get("total_seen", 0), messages_new=totals.get("total_new", 0),
                    bytes_done=totals.get("total_bytes"))

    # --- views ----------------------------------------------------------

    def readiness(self) -> str:
        """missing, empty or ready."""
        if not self.exists("commits"):
            return "missing"
        return "empty" if self.ledger().isEmpty() else "ready"

    def status(self, now_unix: int) -> DataFrame:
        """One row: readiness, mixed-source state, the two runs of note, rate
        and time left of the active one."""
        runs = self.runs()
        samples = self.events().filter("event = 'progress'").select(
            "run_id", F.floor(F.col("event_seq") / 1000).alias("t_us"), "messages_seen", "bytes_done")
        return summary.status(
            self.readiness(), now_unix, self.seen(), run_ops.active_run(runs), run_ops.last_run(runs), samples)
