"""Streaming ingest: replay, retry, resume, cross-source dedupe, repair."""

import json
import os
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sparkmail.operators import runs as run_ops, summary
from sparkmail.plans import queries
from sparkmail.sources import mbox_ranges
from sparkmail.streaming import ingest, store as store_module
from sparkmail.streaming.store import StatsStore, epoch_of


def document(mail_id, sender, message_id=None):
    headers = [{"name": "From", "value": sender}]
    if message_id is not None:
        headers.append({"name": "Message-ID", "value": message_id})
    return {"id": mail_id, "payload": {"headers": headers}}


def land(path, *documents):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(d) + "\n" for d in documents))


def mail(sender, message_id):
    return f"From x\nFrom: {sender}\nMessage-ID: {message_id}\n\nbody\n"


def senders(store):
    return rows(store.senders())


@pytest.fixture
def store(spark, tmp_path):
    return StatsStore(spark, str(tmp_path / "store"))


def test_missing_store_is_readable(store):
    assert store.readiness() == "missing"
    assert store.seen().count() == 0 and store.senders().count() == 0 and store.runs().count() == 0


def test_scan_then_import_counts_each_message_once(store, tmp_path):
    land(tmp_path / "scan" / "p1.json", document("g1", "A <a@x.com>", "<m1@x>"), document("g2", "b@x.com"))
    run = ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c1"))
    assert run == 1 and senders(store) == [("a@x.com", 1), ("b@x.com", 1)]

    (tmp_path / "mbox").mkdir()
    (tmp_path / "mbox" / "a.mbox").write_text(
        mail("a@x.com", "<m1@x>") + mail("c@x.com", "<m2@x>") + mail("c@x.com", "m2@x")
        + "From x\nFrom: d@x.com\n\nno id\n"
    )
    (tmp_path / "mbox" / "notes.txt").write_text("not mail\n")
    run = ingest.import_mbox(store, str(tmp_path / "mbox"), str(tmp_path / "c2"))
    assert run == 2 and senders(store) == [("a@x.com", 1), ("b@x.com", 1), ("c@x.com", 1)]
    assert store.ledger().count() == 5
    assert rows(store.rejected_files().select(F.substring_index("file", "/", -1), "reason")) == [("notes.txt", "no separator")]

    runs = store.runs().orderBy("run_id").collect()
    assert [(r.source, r.state, r.messages_seen, r.messages_new) for r in runs] == [
        ("gmail_api", "done", 2, 2), ("mbox", "done", 4, 1),
    ]
    size = (tmp_path / "mbox" / "a.mbox").stat().st_size  # refused files are not part of the work
    assert (runs[1].bytes_total, runs[1].bytes_done, runs[1].mbox_path) == (size, size, str(tmp_path / "mbox"))
    # The same checkpoint finds nothing new; a fresh one replays everything.
    ingest.import_mbox(store, str(tmp_path / "mbox"), str(tmp_path / "c2"))
    ingest.import_mbox(store, str(tmp_path / "mbox"), str(tmp_path / "c3"))
    ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c4"))
    assert senders(store) == [("a@x.com", 1), ("b@x.com", 1), ("c@x.com", 1)]
    assert store.readiness() == "ready"
    # What a batch has staged is gone.
    assert not any(list(Path(store.root).glob(f"{t}/epoch=*")) for t in ("staged_mbox", "staged_fresh", "staged_messages"))
    assert json.loads(store.status(100).first()["last_run"])["run_id"] == 5


def test_retried_and_unfinished_batches_count_once(spark, store):
    docs = lambda *d: spark.createDataFrame(
        [(json.dumps(x),) for x in d], "j string"
    ).select(F.from_json("j", "id string, payload struct<headers:array<struct<name:string,value:string>>>").alias("d")
             ).select("d.*")
    run = store.start_run("gmail_api")
    store.apply_messages(docs(document("g1", "a@x.com", "m1")), run, 0)
    store.apply_messages(docs(document("g1", "a@x.com", "m1")), run, 0)
    assert senders(store) == [("a@x.com", 1)]

    # Die after the ledger write, before the commit marker.
    commit, store._commit = store._commit, None
    with pytest.raises(TypeError):
        store.apply_messages(docs(document("g2", "a@x.com", "m2")), run, 1)
    store._commit = commit
    assert senders(store) == [("a@x.com", 1)] and store.ledger().count() == 1
    store.apply_messages(docs(document("g2", "a@x.com", "m2")), run, 1)
    assert senders(store) == [("a@x.com", 2)]
    assert rows(store.commits(), "epoch") == [(epoch_of(1, 0),), (epoch_of(1, 1),)]

    # The next run closes the one left open.
    assert store.start_run("mbox") == 2
    assert rows(store.runs(), "run_id", "state") == [(1, "abandoned"), (2, "running")]


def test_repair_collapses_history_and_is_resumable(spark, store, tmp_path):
    old_seen = spark.createDataFrame(
        [(1, "g1", None), (2, "g2", None), (3, "g3", None), (4, "mid:<m1@x>", None),
         (5, "mid:<m2@x>", None), (6, "mid:<>", None), (7, "g1", None)],
        "seq long, mail_id string, rfc_message_id string",
    )
    old_senders = spark.createDataFrame([("a@x.com", 3), ("b@x.com", 2)], "sender string, mails_sent long")
    store.import_baseline(old_seen, old_senders)
    assert rows(store.seen()) == [
        ("g1", None), ("g2", None), ("g3", None), ("mid:<>", ""),
        ("mid:<m1@x>", "m1@x"), ("mid:<m2@x>", "m2@x"),
    ]
    assert rows(summary.mixed_sources(store.seen())) == [(True, 3)]

    land(tmp_path / "meta" / "1.json", document("g1", "a@x.com", "<m1@x>"))
    ingest.repair(store, str(tmp_path / "meta"), str(tmp_path / "c"))
    assert senders(store) == [("a@x.com", 2), ("b@x.com", 2)]
    # Interrupted here; the next run gets the rest and one row again.
    land(tmp_path / "meta" / "2.json", document("g1", "a@x.com", "<m1@x>"),
         document("g2", "b@x.com", "<m2@x>"), document("g3", "a@x.com"))
    ingest.repair(store, str(tmp_path / "meta"), str(tmp_path / "c"))
    assert senders(store) == [("a@x.com", 2), ("b@x.com", 1)]
    assert rows(store.seen(), "mail_id", "rfc_message_id")[:3] == [("g1", "m1@x"), ("g2", "m2@x"), ("g3", "")]
    assert rows(summary.mixed_sources(store.seen())) == [(False, 0)]
    assert rows(store.runs(), "messages_seen", "messages_new", "total_estimate") == [(1, 1, 3), (3, 2, 2)]
    # Nothing left: the next run ends before it reads anything.
    ingest.repair(store, str(tmp_path / "nowhere"), str(tmp_path / "c9"))
    assert store.runs().filter("run_id = 3").first()["state"] == "done"


def test_signs_of_life(spark, store, tmp_path, monkeypatch):
    run = store.start_run("mbox")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    progress, before = mbox_ranges.Progress(spark), jobs()
    progress.messages.add(7)
    progress.bytes.add(900)
    written = store.record
    monkeypatch.setattr(store, "record", lambda *a, **k: 1 / 0)  # the first signs cannot be written
    with ingest.beating(store, run, progress, every=0.05):
        time.sleep(0.3)
        monkeypatch.setattr(store, "record", written)
        time.sleep(0.5)
    assert jobs() == before
    state = store.runs().first()
    assert (state["state"], state["messages_seen"], state["bytes_done"]) == ("running", 7, 900)
    with ingest.beating(store, run, every=0.05):
        time.sleep(0.2)
    assert store.events().filter("event = 'heartbeat'").count() > 0
    # Nothing was committed: that is what the row says once the run is over, or given up.
    store.start_run("mbox")
    state = store.runs().filter(F.col("run_id") == run).first()
    assert (state["state"], state["messages_seen"], state["bytes_done"]) == ("abandoned", 0, None)


def test_run_log_can_be_watched(spark, store, tmp_path):
    run = store.start_run("mbox", mbox_path="/a")
    ingest.watch_runs(store, str(tmp_path / "w")).awaitTermination()
    store.finish_run(run, "failed", "io", "disk")
    ingest.watch_runs(store, str(tmp_path / "w")).awaitTermination()
    latest = store.newest("latest_runs", store.runs().schema)
    assert rows(latest) == rows(store.runs())
    assert rows(latest, "state", "error_kind", "mbox_path") == [("failed", "io", "/a")]


def test_second_import_totals_what_is_left(store, tmp_path):
    folder = tmp_path / "mbox"
    folder.mkdir()
    (folder / "a.mbox").write_text(mail("a@x.com", "<m1@x>"))
    ingest.import_mbox(store, str(folder), str(tmp_path / "c"))
    added = mail("b@x.com", "<m2@x>") + mail("b@x.com", "<m3@x>")
    (folder / "b.mbox").write_text(added)
    run = ingest.import_mbox(store, str(folder), str(tmp_path / "c"))
    state = store.runs().filter(F.col("run_id") == run).first()
    assert (state.state, state.bytes_total, state.bytes_done) == ("done", len(added), len(added))


def test_first_landed_copy_counts(store, tmp_path):
    land(tmp_path / "scan" / "p1.json", document("g9", "first@x.com", "<m9@x>"), document("g9", "second@x.com", "<m9@x>"))
    land(tmp_path / "scan" / "p2.json", document("g9", "third@x.com", "<m9@x>"), document("g1", "first@x.com"))
    ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c"))
    assert senders(store) == [("first@x.com", 2)]


def test_failed_run_tells_its_kind(store, tmp_path):
    with pytest.raises(Exception):
        ingest.scan_messages(store, str(tmp_path / "nowhere"), str(tmp_path / "c"))
    state = store.runs().first()
    assert (state.state, state.error_kind) == ("failed", "missing_credentials")


def archive(n, first=0):
    return "".join(mail(f"s{i % 7}@x.com", f"<m{i}@x>") for i in range(first, first + n))


def test_killed_import_goes_on_inside_the_file(store, tmp_path, monkeypatch):
    folder = tmp_path / "mbox"
    folder.mkdir()
    (folder / "a.mbox").write_text(archive(100))
    size = (folder / "a.mbox").stat().st_size
    read, taken = mbox_ranges.read_ranges, []

    def dying(spark, ranges, **options):
        taken.extend(ranges)
        if len(taken) == 3:
            raise RuntimeError("killed")
        return read(spark, ranges, **options)

    monkeypatch.setattr(mbox_ranges, "read_ranges", dying)
    with pytest.raises(RuntimeError):
        ingest.import_mbox(store, str(folder), str(tmp_path / "c"), batch_bytes=1500)
    failed = store.runs().first()
    assert (failed["state"], failed["bytes_done"], failed["bytes_total"]) == ("failed", 3000, size)
    assert failed["mbox_fingerprint"] == mbox_ranges.archives(str(folder))[0].fingerprint
    done = store.ledger().count()
    assert 0 < done < 100

    taken.clear()
    monkeypatch.setattr(mbox_ranges, "read_ranges", lambda spark, ranges, **o: (taken.extend(ranges), read(spark, ranges, **o))[1])
    run = ingest.import_mbox(store, str(folder), str(tmp_path / "c"), batch_bytes=2500)
    assert taken[0].start == 3000 and taken[-1].stop == size
    state = store.runs().filter(F.col("run_id") == run).first()
    assert (state["state"], state["messages_seen"], state["bytes_done"]) == ("done", 100 - done, size - 3000)
    expected = sorted((f"s{k}@x.com", sum(i % 7 == k for i in range(100))) for k in range(7))
    assert senders(store) == expected

    # A changed file is read from its start; its known messages do not count again.
    taken.clear()
    (folder / "a.mbox").write_text(archive(100) + archive(10, first=100))
    ingest.import_mbox(store, str(folder), str(tmp_path / "c"))
    assert taken[0].start == 0 and store.ledger().count() == 110
    # One archive by its own path, and a folder that is not there.
    ingest.import_mbox(store, str(folder / "a.mbox"), str(tmp_path / "c9"))
    assert store.ledger().count() == 110
    with pytest.raises(FileNotFoundError):
        ingest.import_mbox(store, str(tmp_path / "none"), str(tmp_path / "c"))
    assert store.runs().orderBy(F.desc("run_id")).first()["state"] == "failed"


def test_stored_rows_are_not_shuffled(spark, store, tmp_path):
    """The joins of a batch exchange the batch alone, broadcasts aside."""
    folder = tmp_path / "mbox"
    folder.mkdir()
    (folder / "a.mbox").write_text(archive(100))
    ingest.import_mbox(store, str(folder), str(tmp_path / "c"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        batch = spark.createDataFrame([("mid:<m5@x>", "m5@x", "s5@x.com")], "mail_id string, rfc_message_id string, sender string")
        joins = [
            store.dealt(batch, "mail_id").join(store.ledger().select("mail_id"), "mail_id", "left_anti"),
            store.dealt(batch, "rfc_message_id").join(store.known_ids(), "rfc_message_id", "left_anti"),
            store._committed("senders").join(store.dealt(batch, "sender").select("sender"), "sender", "left_semi"),
        ]
        for joined in joins:
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1, plan
            assert "Bucketed: true" in plan
        assert [j.count() for j in joins] == [0, 0, 1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_write_the_senders_they_touch(spark, store, monkeypatch):
    monkeypatch.setattr(store_module, "SENDER_EPOCHS", 3)
    table = lambda i: spark.createDataFrame(
        [(f"g{i}", [("From", f"s{i % 2}@x.com")]), (f"h{i}", [("From", f"only{i}@x.com")])],
        "id string, headers array<struct<name:string,value:string>>").selectExpr("id", "struct(headers) AS payload")
    run = store.start_run("gmail_api")
    for i in range(7):
        store.apply_messages(table(i), run, i)
        if i == 1:
            written = spark.read.parquet(f"{store.root}/senders/epoch={epoch_of(run, 1)}")
            assert rows(written, "sender") == [("only1@x.com",), ("s1@x.com",)]
    assert senders(store) == sorted([("s0@x.com", 4), ("s1@x.com", 3), *((f"only{i}@x.com", 1) for i in range(7))])
    assert len(list(Path(store.root).glob("senders/epoch=*"))) < 7
    again = StatsStore(spark, store.root, buckets=99)  # another reader; the number of buckets stays
    assert senders(again) == senders(store) and again.buckets == store.buckets != 99


def test_live_sums_follow_the_commits(spark, store, tmp_path):
    old = spark.createDataFrame([(1, "g1", None), (2, "mid:<m1@x>", None)], "seq long, mail_id string, rfc_message_id string")
    store.import_baseline(old, spark.createDataFrame([("a@x.com", 5), ("b@x.com", 2)], "sender string, mails_sent long"))
    watch = lambda: ingest.watch_senders(store, str(tmp_path / "w")).awaitTermination()
    land(tmp_path / "scan" / "p1.json", document("g2", "a@x.com", "<m2@x>"), document("g3", "c@x.com"))
    ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c1"))
    watch()
    assert rows(ingest.live_senders(store)) == [("a@x.com", 6), ("b@x.com", 2), ("c@x.com", 1)]
    land(tmp_path / "meta" / "1.json", document("g1", "a@x.com", "<m1@x>"))
    publish, store._publish = store._publish, lambda: None  # a run that dies right behind its commit
    ingest.repair(store, str(tmp_path / "meta"), str(tmp_path / "c2"))
    store._publish = publish
    watch()
    assert rows(ingest.live_senders(store)) == [("a@x.com", 6), ("b@x.com", 2), ("c@x.com", 1)]
    store.start_run("mbox")
    watch()
    assert rows(ingest.live_senders(store)) == senders(store) == [("a@x.com", 5), ("b@x.com", 2), ("c@x.com", 1)]


def test_page_token_is_committed_with_its_page(store, tmp_path, monkeypatch):
    for i in range(4):
        land(tmp_path / "scan" / f"p{i}.json", document(f"g{i}", "a@x.com", f"<m{i}@x>"))
        os.utime(tmp_path / "scan" / f"p{i}.json", (1000 + i, 1000 + i))  # pages land one after another
    commit, pages = store._commit, []

    def dying(*a, **k):
        pages.append(a)
        if len(pages) == 3:
            raise RuntimeError("killed")
        commit(*a, **k)

    monkeypatch.setattr(store, "_commit", dying)
    with pytest.raises(Exception):
        ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c"), max_files=1)
    monkeypatch.setattr(store, "_commit", commit)
    token = run_ops.scan_resume_token(store.runs(), 1)
    assert token == "p1.json" and senders(store) == [("a@x.com", 2)]
    run = ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "lost"), after_page=token)
    assert senders(store) == [("a@x.com", 4)]
    state = store.runs().filter(F.col("run_id") == run).first()
    assert (state["messages_seen"], state["resume_token"]) == (2, "p3.json")


def test_token_without_its_page_starts_over(store, tmp_path):
    for i in range(3):
        land(tmp_path / "scan" / f"p {i}.json", document(f"g{i}", "a@x.com", f"<m{i}@x>"))
    ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c1"), after_page="p9.json")
    assert senders(store) == [("a@x.com", 3)]
    token = run_ops.scan_resume_token(store.runs(), 1)
    run = ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c2"), after_page=token)
    assert store.runs().filter(F.col("run_id") == run).first()["messages_seen"] == 0


def test_scan_leaves_out_spam_and_trash(store, tmp_path):
    labels = [["INBOX"], ["SPAM"], ["INBOX", "TRASH"], [], None, [None, "UNREAD"], [None, "SPAM"], "odd"]
    land(tmp_path / "scan" / "p.json", *(document(f"g{i}", f"s{i}@x.com") | {"labelIds": x} for i, x in enumerate(labels)),
         document("g8", "s8@x.com"))
    ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c"))
    assert senders(store) == [(f"s{i}@x.com", 1) for i in (0, 3, 4, 5, 7, 8)]
    assert store.runs().first()["messages_seen"] == 6


def failing(store, monkeypatch, errors, after=False):
    """Commits fail with these errors, None for none, one after another; `after`: once the marker is written."""
    commit, left, waits = store._commit, list(errors), []

    def sometimes(*a, **k):
        error = left.pop(0) if left else None
        if error is None or after:
            commit(*a, **k)
        if error is not None:
            raise error

    monkeypatch.setattr(store, "_commit", sometimes)
    monkeypatch.setattr(ingest, "_wait", waits.append)
    return waits


def pages(folder, n):
    for i in range(n):
        land(folder / f"p{i}.json", document(f"g{i}", "a@x.com", f"<m{i}@x>"))


def test_scan_tries_again_after_failures_that_pass(store, tmp_path, monkeypatch):
    pages(tmp_path / "scan", 3)
    lost = ConnectionResetError("connection reset by peer")
    waits = failing(store, monkeypatch, [lost, TimeoutError("too late"), lost, None, lost, lost])
    ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c"), max_files=1)
    assert waits == [1, 2, 3, 1, 2]  # a page that was done starts the count over
    state = store.runs().first()
    assert senders(store) == [("a@x.com", 3)] and (state["state"], state["messages_seen"]) == ("done", 3)


def test_scan_gives_up(store, tmp_path, monkeypatch):
    pages(tmp_path / "scan", 1)
    waits = failing(store, monkeypatch, [ConnectionResetError("reset")] * 4)
    with pytest.raises(Exception, match="reset"):
        ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c"))
    assert waits == [1, 2, 3] and store.runs().first()["state"] == "failed"
    waits = failing(store, monkeypatch, [RuntimeError("no such column")])
    with pytest.raises(Exception, match="no such column"):
        ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c2"))
    assert waits == []


def test_failure_behind_a_commit_counts_once(store, tmp_path, monkeypatch):
    pages(tmp_path / "scan", 2)
    failing(store, monkeypatch, [ConnectionResetError("reset")], after=True)
    ingest.scan_messages(store, str(tmp_path / "scan"), str(tmp_path / "c"))
    ingest.watch_senders(store, str(tmp_path / "w")).awaitTermination()
    assert senders(store) == rows(ingest.live_senders(store)) == [("a@x.com", 2)]


def test_stream_ingest_replays_both(spark, tmp_path, monkeypatch):
    spark.range(40).selectExpr("id AS event_id", "id % 5 AS user_id").write.parquet(str(tmp_path / "events.parquet"))
    stores = []
    monkeypatch.setattr(queries, "StatsStore", lambda *a: stores.append(StatsStore(*a)) or stores[0])
    counted = rows(queries.stream_ingest(spark, str(tmp_path)))
    runs = stores[0].runs().orderBy("run_id").collect()
    assert [(r["source"], r["messages_seen"]) for r in runs] == [("gmail_api", 30), ("mbox", 24), ("mbox", 24), ("gmail_api", 30)]
    assert [r["messages_new"] for r in runs[2:]] == [0, 0] and sum(n for _, n in counted) == sum(r["messages_new"] for r in runs[:2])


def test_run_log_stays_small(store):
    for i in range(9):
        run = store.start_run("mbox", mbox_path=f"/{i}")
        store.record(run, "progress", messages_seen=i)
        if i % 3:
            store.finish_run(run, "failed" if i % 3 == 1 else "done", "io" if i % 3 == 1 else None)
    assert len(list(Path(store.root).glob("run_events/run=*"))) == len(list(Path(store.root).glob("folded_runs/epoch=*"))) == 2
    found = store.runs().orderBy("run_id").collect()
    assert [r["run_id"] for r in found] == list(range(1, 10)) and [r["mbox_path"] for r in found] == [f"/{i}" for i in range(9)]
    assert [r["state"] for r in found] == [("abandoned", "failed", "done")[i % 3] for i in range(9)]
    assert [r["error_kind"] for r in found] == [(None, "io", None)[i % 3] for i in range(9)]
