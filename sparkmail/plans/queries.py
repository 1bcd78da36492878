"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkmail.functions import errors, identity, runs as run_x
from sparkmail.functions.mbox_headers import parse_headers
from sparkmail.operators import counters, dedupe, rates, runs as run_ops, summary
from sparkmail.plans import views as v
from sparkmail.session import cut_lineage, staging_path
from sparkmail.sources import documents as summaries, mbox, mbox_ranges, messages
from sparkmail.streaming import ingest
from sparkmail.streaming.store import StatsStore

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- shared steps -----------------------------------------------------------


def _clean(rows: DataFrame) -> DataFrame:
    return rows.select(
        "seq", "mail_id", identity.normalize_message_id(F.col("message_id")).alias("rfc_message_id"),
        identity.clean_sender(F.col("from_header")).alias("sender"),
    )


def _scan_batch(spark, sf):
    return _clean(v.replay_msgs(spark, sf))


def _import_batch(spark, sf):
    rows = v.import_msgs(spark, sf).filter(F.col("message_id").isNotNull())
    return _clean(rows.withColumn("mail_id", identity.mid_key(F.col("message_id"))))


def _nothing_seen(spark):
    return spark.createDataFrame([], "mail_id string, rfc_message_id string")


def _scan_new(spark, sf):
    # Later batches look this result up twice, as they would a stored ledger.
    return cut_lineage(dedupe.new_rows(_scan_batch(spark, sf), _nothing_seen(spark)))


def _import_new(spark, sf, scanned=None):
    return dedupe.new_rows(_import_batch(spark, sf), _scan_new(spark, sf) if scanned is None else scanned)


def _senders_after_both(spark, sf):
    none = spark.createDataFrame([], "sender string, mails_sent long")
    scanned = _scan_new(spark, sf)
    after_scan = counters.add_counts(none, counters.increments(scanned))
    return counters.add_counts(after_scan, counters.increments(_import_new(spark, sf, scanned)))


def _ranked(spark, sf):
    return summary.summary_senders(v.raw_senders(spark, sf))


def _repaired(spark, sf):
    return dedupe.repair_rows(v.repair_documents(spark, sf), v.historical_seen(spark, sf))


# --- sources ----------------------------------------------------------------


@query
def scan_sender_counts(spark, sf):
    """Land message documents as JSON, read them back, count per sender."""
    path = staging_path(spark, "documents")
    v.message_documents(spark, sf).write.json(path)
    return counters.sender_counts(messages.message_fields(messages.read_messages(spark, path)))


@query
def scan_refetched(spark, sf):
    """Ids that were landed again with other senders count for their first copy."""
    path = staging_path(spark, "pages")
    documents = v.message_documents(spark, sf)
    number = F.substring("id", 2, 18).cast("long")
    again = documents.select("id", F.struct(F.array(F.struct(
        F.lit("From").alias("name"), F.concat(F.lit("late"), (number % 5).cast("string"), F.lit("@example.net")).alias("value")
    )).alias("headers")).alias("payload"))
    documents.filter(number % 4 != 3).write.json(f"{path}/page=1")
    again.write.json(f"{path}/page=2")
    return counters.sender_counts(dedupe.first_per_key(messages.message_fields(messages.read_messages(spark, path)), "mail_id"))


@query
def metadata_fetch(spark, sf):
    documents = messages.metadata_only(v.message_documents(spark, sf))
    return documents.select(
        F.col("id").alias("mail_id"), F.size("payload.headers").cast("long").alias("kept_headers")
    )


def _archive(spark, sf, extra: DataFrame | None = None) -> DataFrame:
    path = staging_path(spark, "archive")
    v.archive_messages(spark, sf).select("value").write.text(path)
    if extra is not None:
        extra.write.mode("append").text(path)
    parsed = staging_path(spark, "parsed")
    # The text is scanned once; offsets and checks read the headers.
    mbox.parse_records(mbox.read_mbox(spark, path)).write.parquet(parsed)
    return mbox.with_status(mbox.with_offsets(spark.read.parquet(parsed)))


@query
def mbox_scan(spark, sf):
    """Write documents as an mbox archive and scan it: headers and byte spans."""
    found = _archive(spark, sf)
    return found.filter(F.col("status") == "message").select(
        "message_id", identity.clean_sender(F.col("from_")).alias("sender"),
        (F.col("end_offset") - F.col("start_offset")).alias("bytes"),
    )


@query
def mbox_sniff(spark, sf):
    """Files that do not begin with a separator are refused whole."""
    other = v.table(spark, sf, "benchmark").select(F.concat(
        F.lit("not mail\nFrom x\nFrom: a@example.com\nMessage-ID: <b"), F.col("item_id"), F.lit(">\n\n"), F.col("text")
    ).alias("value"))
    valid, _ = mbox.split_valid_files(_archive(spark, sf, other))
    return valid.groupBy("message_id", "status").agg(F.count("*").alias("n"))


@query
def mbox_import_summary(spark, sf):
    return mbox.import_counts(_archive(spark, sf))


@query
def mbox_fingerprint(spark, sf):
    """Size and hash of each file of an archive with known files."""
    path = staging_path(spark, "bundles")
    bundled = v.archive_messages(spark, sf).select(F.floor(F.col("doc_id") / 500).alias("bundle"), "doc_id", "value")
    bundled.repartition("bundle").sortWithinPartitions("bundle", "doc_id").drop("doc_id") \
        .write.partitionBy("bundle").text(path)
    prints = mbox.fingerprints(mbox.with_offsets(mbox.parse_records(mbox.read_mbox(spark, path))))
    parts = F.split("fingerprint", ":")
    return prints.select(parts[0].cast("long").alias("bytes"), parts[2].alias("hash"))


def _write_archive(spark, sf, path: str) -> None:
    v.import_msgs(spark, sf).select(F.concat(
        F.lit("From x\nFrom: "), F.col("from_header"),
        F.coalesce(F.concat(F.lit("\nMessage-ID: "), F.col("message_id")), F.lit("")), F.lit("\n\nbody"),
    ).alias("value")).write.text(path)


def _write_documents(spark, sf, path: str) -> None:
    v.message_documents(spark, sf).filter("CAST(substring(id, 2) AS BIGINT) % 4 <> 3").write.json(path)


@query
def stream_ingest(spark, sf):
    """Stream landed documents, then an archive, into a store; replay both."""
    root = staging_path(spark, "stream")
    _write_documents(spark, sf, f"{root}/documents")
    _write_archive(spark, sf, f"{root}/archive")
    store = StatsStore(spark, f"{root}/store")
    ingest.scan_messages(store, f"{root}/documents", f"{root}/c1")
    ingest.import_mbox(store, f"{root}/archive", f"{root}/c2")
    ingest.import_mbox(store, f"{root}/archive", f"{root}/c3")
    ingest.scan_messages(store, f"{root}/documents", f"{root}/c4")
    return store.senders()


def _stopped_and_resumed(spark, sf) -> StatsStore:
    """A store after a scan, an import that stops inside its files, and one that goes on."""
    root = staging_path(spark, "resume")
    _write_documents(spark, sf, f"{root}/documents")
    _write_archive(spark, sf, f"{root}/archive")
    store = StatsStore(spark, f"{root}/store")
    ingest.scan_messages(store, f"{root}/documents", f"{root}/c1")
    size = sum(a.size for a in mbox_ranges.archives(f"{root}/archive"))
    ingest.import_mbox(store, f"{root}/archive", f"{root}/c2", batch_bytes=max(1, size // 3), max_batches=1)
    ingest.import_mbox(store, f"{root}/archive", f"{root}/c2", batch_bytes=max(1, size // 2))
    return store


@query
def mbox_resume(spark, sf):
    """Counters after an import was stopped inside a file and gone on with."""
    return _stopped_and_resumed(spark, sf).senders()


@query
def run_rows_after_ingest(spark, sf):
    """What the rows of a store's runs add up to: a scan, a stopped import and the rest of it."""
    runs = _stopped_and_resumed(spark, sf).runs()
    return runs.groupBy("source").agg(
        F.count("*").alias("runs"), F.array_join(F.sort_array(F.collect_list("state")), ",").alias("states"),
        F.sum("messages_seen").alias("messages_seen"), F.sum("messages_new").alias("messages_new"),
        (F.max("bytes_total") == F.sum("bytes_done")).alias("all_bytes"))


@query
def live_summary(spark, sf):
    """Running sums of a stream over the changes that batches commit."""
    root = staging_path(spark, "live")
    _write_documents(spark, sf, f"{root}/documents")
    _write_archive(spark, sf, f"{root}/archive")
    store = StatsStore(spark, f"{root}/store")
    ingest.scan_messages(store, f"{root}/documents", f"{root}/c1")
    ingest.watch_senders(store, f"{root}/w").awaitTermination()
    ingest.import_mbox(store, f"{root}/archive", f"{root}/c2")
    ingest.watch_senders(store, f"{root}/w").awaitTermination()
    return ingest.live_senders(store)


@query
def mbox_refused(spark, sf):
    """Files of an import folder that are refused unread, by reason, and the messages of the others."""
    root = staging_path(spark, "refused")
    _write_archive(spark, sf, f"{root}/archive")
    text = v.table(spark, sf, "benchmark").select("text").repartition(1)
    text.write.mode("append").text(f"{root}/archive")
    text.select(F.concat(F.lit("From x\n"), "text").alias("text")).repartition(1).write.mode("append") \
        .text(f"{root}/archive", compression="gzip")
    store = StatsStore(spark, f"{root}/store")
    ingest.import_mbox(store, f"{root}/archive", f"{root}/c")
    refused = store.rejected_files().groupBy("reason").agg(F.count("*").alias("n"))
    return refused.unionByName(store.ledger().agg(F.count("*").alias("n")).withColumn("reason", F.lit("messages")))


def _write_repair_documents(spark, sf, path: str, rows) -> None:
    header = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value")))
    headers = F.array_compact(F.array(
        header("From", F.col("sender")), header("Message-ID", F.concat(F.lit("<"), "rfc_message_id", F.lit(">")))))
    v.repair_documents(spark, sf).filter(rows).select(
        F.col("mail_id").alias("id"), F.struct(headers.alias("headers")).alias("payload")).write.mode("append").json(path)


def _repaired_store(spark, sf) -> StatsStore:
    """A store with the history of both sources and two repair runs; the second finds the documents of the first again."""
    root = staging_path(spark, "repair")
    store = StatsStore(spark, f"{root}/store")
    store.import_baseline(v.historical_seen(spark, sf).withColumn("seq", F.lit(0)), v.historical_senders(spark, sf))
    _write_repair_documents(spark, sf, f"{root}/pages", F.col("seq") % 2 == 0)
    ingest.repair(store, f"{root}/pages", f"{root}/c1")
    _write_repair_documents(spark, sf, f"{root}/pages", F.col("seq") % 2 == 1)
    ingest.repair(store, f"{root}/pages", f"{root}/c2")
    return store


@query
def stream_repair(spark, sf):
    """Counters after repairs that stream landed metadata into a store."""
    return _repaired_store(spark, sf).senders()


@query
def stream_repair_seen(spark, sf):
    """The ledger after the same repairs."""
    return _repaired_store(spark, sf).seen().select("mail_id", "rfc_message_id")


@query
def run_estimates(spark, sf):
    """Totals that runs record as they start: what a repair has to do, and a mailbox total that is known or not."""
    store = _repaired_store(spark, sf)
    root = staging_path(spark, "estimate")
    _write_documents(spark, sf, f"{root}/documents")
    listed = messages.read_messages(spark, f"{root}/documents").count()
    ingest.scan_messages(store, f"{root}/documents", f"{root}/c1", total_estimate=listed)
    ingest.scan_messages(store, f"{root}/documents", f"{root}/c1")
    return store.runs().select("run_id", "source", "total_estimate", "messages_seen")


@query
def summary_read(spark, sf):
    """Summary documents, a file each, read back: their senders and the totals they name."""
    path, ranked = staging_path(spark, "summaries"), _ranked(spark, sf)
    shards = F.pmod(F.xxhash64("sender"), F.lit(ranked.count() // 1000 + 1))
    ranked.groupBy(shards.alias("shard")).agg(
        F.sum("mails_sent").alias("total_messages"), F.lit(v.NOW_UNIX).cast("long").alias("generated_at_unix"),
        F.collect_list(F.struct("sender", "mails_sent")).alias("senders"),
    ).select("shard", F.to_json(F.struct("total_messages", "generated_at_unix", "senders"), {"pretty": "true"}).alias("value")) \
        .repartition("shard").write.partitionBy("shard").text(path)
    head, senders = summaries.read_summary(spark, path)
    totals = head.agg(F.lit("documents").alias("kind"), F.max("generated_at_unix").cast("string").alias("sender"),
                      F.sum("total_messages").alias("mails_sent"))
    return totals.unionByName(senders.withColumn("kind", F.lit("sender")))


@query
def spec_read(spark, sf):
    """Dataset specs, read back: what their pinned senders leave over in each category."""
    path, customers = staging_path(spark, "specs"), v.table(spark, sf, "customer")
    shard = F.pmod(F.xxhash64("c_custkey"), F.lit(customers.count() // 1000 + 1)).alias("shard")
    pinned = F.struct(F.concat(F.lit("c"), "c_custkey").alias("sender"), F.col("c_custkey").cast("long").alias("mails_sent"),
                      F.col("c_mktsegment").alias("category"))
    customers.groupBy(shard, "c_mktsegment").agg(
        F.count("*").alias("n"), F.sum("c_custkey").alias("m"),
        F.collect_list(F.when(F.col("c_acctbal") > 9000, pinned)).alias("pinned"),
    ).groupBy("shard").agg(
        F.sum("m").alias("total_messages_min"), F.sum("n").alias("distinct_senders"),
        F.flatten(F.collect_list("pinned")).alias("top_senders"),
        F.collect_list(F.struct(F.col("c_mktsegment").alias("key"), F.col("n").alias("sender_count"),
                                F.col("m").alias("total_messages"))).alias("categories"),
    ).select("shard", F.to_json(F.struct("total_messages_min", "distinct_senders", "top_senders", "categories"),
                                {"pretty": "true"}).alias("value")).repartition("shard").write.partitionBy("shard").text(path)
    limits, categories, heroes = summaries.read_spec(spark, path)
    whole = categories.groupBy("key").agg(F.sum("sender_count").alias("sender_count"), F.sum("total_messages").alias("total_messages"))
    left = summary.category_budget(whole, heroes.select("category", "mails_sent"))
    return left.unionByName(limits.agg(F.lit("limits").alias("key"), F.sum("distinct_senders").alias("tail_count"),
                                       F.sum("total_messages_min").alias("tail_budget")))


# --- expressions ------------------------------------------------------------


@query
def header_lookup(spark, sf):
    headers = F.col("payload.headers")
    return v.message_documents(spark, sf).select(
        F.col("id").alias("mail_id"), identity.header_value(headers, "From").alias("from_value"),
        identity.header_value(headers, "Return-Path").alias("return_path"),
        identity.header_value(headers, "Message-ID").alias("message_id"),
    )


@query
def sender_priority(spark, sf):
    return messages.message_fields(v.message_documents(spark, sf)).select("mail_id", "sender")


@query
def clean_sender(spark, sf):
    cleaned = v.sender_headers(spark, sf).withColumn("sender", identity.clean_sender(F.col("header")))
    return cleaned.select(
        "src", "id", F.md5("sender").alias("sender_md5"), (F.col("sender") != F.col("header")).alias("changed")
    )


@query
def normalize_message_id(spark, sf):
    return v.raw_message_ids(spark, sf).select(
        "seq", identity.normalize_message_id(F.col("raw")).alias("rfc_message_id")
    )


def _headers(spark, sf):
    parsed = v.conversation_records(spark, sf).select("conv_id", "turn", parse_headers(F.col("value")).alias("h"))
    return parsed.select("conv_id", "turn", "h.*")


def _framed(spark, sf):
    # Every third record is text before the first separator of its file.
    junk = (F.col("conv_id") % 3 == 0) & (F.col("turn") == 0)
    return _headers(spark, sf).withColumn(
        "status", F.when(junk, "junk").when(F.col("bad"), "malformed").otherwise("message"))


@query
def mbox_headers(spark, sf):
    return _headers(spark, sf).filter(~F.col("bad")).drop("bad")


@query
def mbox_lossy(spark, sf):
    """Header values that are not UTF-8: each maximal broken part becomes one replacement character."""
    broken = F.get(F.array(*[F.lit(h) for h in v.BROKEN_BYTES]), (F.col("conv_id") % len(v.BROKEN_BYTES)).cast("int"))
    record = F.concat(
        F.encode(F.concat(F.lit("x\nFrom: é"), F.col("role")), "UTF-8"), F.unhex(broken), F.encode(F.concat(
            F.lit(" <a"), F.col("turn").cast("string"), F.lit("@example.com>\nMessage-ID: <"), F.col("conv_id").cast("string")),
            "UTF-8"), F.unhex(broken), F.encode(F.concat(F.lit(">\n\n"), "text"), "UTF-8"))
    parsed = v.table(spark, sf, "conversations").select("conv_id", "turn", parse_headers(record.cast("string")).alias("h"))
    return parsed.select("conv_id", "turn", "h.bad", "h.message_id", "h.from_")


@query
def mbox_skipped(spark, sf):
    return mbox.import_counts(_framed(spark, sf))


@query
def populate_mid_rows(spark, sf):
    return summary.populate_embedded(v.embedded_rows(spark, sf))


@query
def error_triage(spark, sf):
    return errors.with_transient(v.failures(spark, sf)).select(
        "event_id", "transient",
        errors.error_kind(F.col("message"), F.col("origin"), F.col("transient")).alias("error_kind"),
    )


@query
def consent_links(spark, sf):
    return v.links(spark, sf).select("page_id", run_x.is_consent_url(F.col("url")).alias("linked"))


# --- dedupe, counters, repair -----------------------------------------------


@query
def fetch_worklist(spark, sf):
    listing = v.replay_msgs(spark, sf).select("mail_id").distinct()
    seen = v.scan_msgs(spark, sf).filter(F.col("seq") % 3 == 0).select("mail_id")
    return dedupe.unseen(listing, seen)


@query
def dedupe_seen(spark, sf):
    rows = v.raw_message_ids(spark, sf).select(
        "seq", F.concat(F.lit("k"), (F.col("seq") % 700).cast("string")).alias("mail_id"), "raw"
    )
    return dedupe.dedupe_stored(rows)


@query
def ingest_scan_new(spark, sf):
    return _scan_new(spark, sf)


@query
def ingest_import_new(spark, sf):
    return _import_new(spark, sf)


@query
def import_summary(spark, sf):
    """Messages parsed, newly counted, and skipped for want of an id."""
    parsed = v.import_msgs(spark, sf).select(
        F.lit(1).alias("seen"), F.col("message_id").isNull().cast("int").alias("skipped"), F.lit(0).alias("new")
    )
    counted = _import_new(spark, sf).select(
        F.lit(0).alias("seen"), F.lit(0).alias("skipped"), F.col("counted").cast("int").alias("new")
    )
    return parsed.unionByName(counted).agg(
        F.sum("seen").alias("messages_seen"), F.sum("new").alias("messages_new"), F.sum("skipped").alias("skipped")
    )


@query
def senders_after_both(spark, sf):
    return _senders_after_both(spark, sf)


@query
def run_counters(spark, sf):
    run = lambda df, n: df.withColumn("run_id", F.lit(n).cast("long"))
    scanned = _scan_new(spark, sf)
    ledger = run(scanned, 1).unionByName(run(_import_new(spark, sf, scanned), 2))
    handed_in = run(v.replay_msgs(spark, sf), 1).select("run_id").unionByName(
        run(v.import_msgs(spark, sf), 2).select("run_id")
    )
    return counters.run_counters(ledger, handed_in)


@query
def backfill_batches(spark, sf):
    return summary.repair_batches(v.historical_seen(spark, sf))


@query
def backfill_rows(spark, sf):
    return _repaired(spark, sf)


@query
def backfill_outcome(spark, sf):
    return dedupe.repair_outcome(v.repair_documents(spark, sf), _repaired(spark, sf))


@query
def senders_after_backfill(spark, sf):
    return counters.take_back(v.historical_senders(spark, sf), counters.decrements(_repaired(spark, sf)))


@query
def seen_after_backfill(spark, sf):
    return dedupe.apply_repairs(v.historical_seen(spark, sf), _repaired(spark, sf))


# --- summary ----------------------------------------------------------------


def _states(spark, sf):
    """Stores in several states, by name."""
    before = v.historical_seen(spark, sf)
    return {
        "unrepaired": before, "repaired": dedupe.apply_repairs(before, _repaired(spark, sf)),
        "scanned": before.filter("NOT mail_id LIKE 'mid:%'"), "empty": before.limit(0),
    }


def _stacked(parts):
    out = None
    for name, df in parts.items():
        named = df.withColumn("store", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


@query
def mixed_sources(spark, sf):
    return _stacked({k: summary.mixed_sources(seen) for k, seen in _states(spark, sf).items()})


@query
def readiness(spark, sf):
    """Empty and filled stores, with a run under way and without."""
    runs = v.runs(spark, sf)
    idle = runs.filter(run_ops.is_terminal(F.col("state")))
    return _stacked({
        f"{k}, {when}": summary.readiness(seen, some)
        for k, seen in _states(spark, sf).items() if k in ("unrepaired", "empty")
        for when, some in (("busy", runs), ("idle", idle), ("new", None))
    })


@query
def status_document(spark, sf):
    """The status of a store whose runs and progress come from the event log."""
    runs, seen = run_ops.latest_runs(v.run_events(spark, sf)), v.historical_seen(spark, sf)
    samples = v.run_progress(spark, sf).select("run_id", "t_us", "messages_seen", "bytes_done")
    found = summary.status(
        summary.readiness(seen).select("db").scalar(), v.NOW_UNIX, seen, run_ops.active_run(runs), run_ops.last_run(runs), samples)
    run_id = lambda c: F.get_json_object(c, "$.run_id").cast("long")
    return found.withColumns({"active_run": run_id("active_run"), "last_run": run_id("last_run")})


def _both_seen(spark, sf):
    return v.replay_msgs(spark, sf).select("mail_id").unionByName(_import_batch(spark, sf).select("mail_id"))


@query
def total_messages(spark, sf):
    return summary.total_messages(_both_seen(spark, sf))


@query
def summary_senders(spark, sf):
    return _ranked(spark, sf)


@query
def summary_visible(spark, sf):
    return summary.visible(_senders_after_both(spark, sf), v.hidden_senders(spark, sf))


@query
def summary_tiles(spark, sf):
    return summary.tiles(_both_seen(spark, sf), _senders_after_both(spark, sf), v.hidden_senders(spark, sf))


@query
def summary_document(spark, sf):
    return summary.document_rows(_both_seen(spark, sf), _ranked(spark, sf), v.NOW_UNIX)


@query
def summary_written(spark, sf):
    """The summary document through its text sink."""
    path = staging_path(spark, "summary")
    rows = summary.document_rows(_both_seen(spark, sf), _ranked(spark, sf), v.NOW_UNIX)
    summary.write_document(rows, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def summary_quality(spark, sf):
    """The old counter table against what the customers should add up to."""
    rows = v.raw_senders(spark, sf).select("sender", summary.stored_count(F.col("mails_sent")).alias("mails_sent"))
    spec = v.table(spark, sf, "customer").agg(
        F.sum(F.col("c_custkey") % 97).alias("total"), F.countDistinct("c_custkey").alias("senders"))
    return summary.quality(rows, spec.select("total").scalar(), 84_000, spec.select("senders").scalar())


@query
def category_budget(spark, sf):
    customers = v.table(spark, sf, "customer")
    categories = customers.groupBy(F.col("c_mktsegment").alias("key")).agg(
        F.count("*").alias("sender_count"), F.sum("c_custkey").alias("total_messages")
    )
    heroes = customers.filter(F.col("c_acctbal") > 9000).select(
        F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("mails_sent")
    )
    return summary.category_budget(categories, heroes)


@query
def top_senders(spark, sf):
    return _ranked(spark, sf).orderBy(*summary.by_rank()).limit(20)


@query
def search_senders(spark, sf):
    return summary.search(_ranked(spark, sf), "  MACHINERY.Ex ")


@query
def sender_page(spark, sf):
    ranked, hidden = _ranked(spark, sf), v.hidden_customers(spark, sf)
    shown = summary.search(summary.listed(ranked, hidden), "c1")
    return summary.page(shown, page=3, size=25, hidden=summary.hidden_count(ranked, hidden))


@query
def sender_page_stored(spark, sf):
    """A later page and one past the end of an order that is stored once."""
    path = staging_path(spark, "order")
    summary.store_order(_ranked(spark, sf), path, slab=500)
    pages = {"later": summary.stored_page(spark, path, 7, 100), "last": summary.stored_page(spark, path, 1_000_000, 25)}
    return _stacked(pages)


@query
def sender_list(spark, sf):
    """The list with the toggle for hidden senders off and on."""
    ranked, hidden = _ranked(spark, sf), v.hidden_customers(spark, sf)
    return _stacked({"off": summary.listed(ranked, hidden), "on": summary.listed(ranked, hidden, show_hidden=True)})


@query
def sender_last_page(spark, sf):
    """A page number past the end."""
    return summary.page(_ranked(spark, sf), page=1_000_000, size=100)


# --- runs -------------------------------------------------------------------


@query
def run_latest_state(spark, sf):
    return run_ops.latest_runs(v.run_events(spark, sf))


@query
def run_active_last(spark, sf):
    runs = v.runs(spark, sf)
    return run_ops.public(run_ops.active_run(runs).unionByName(run_ops.last_run(runs)))


@query
def run_lookup(spark, sf):
    """The run that the newest order names."""
    newest = run_ops.max_run_id(v.runs(spark, sf)).first()[0]
    return run_ops.public(run_ops.run_by_id(v.runs(spark, sf), newest))


@query
def history_document(spark, sf):
    document = run_ops.history_document(v.runs(spark, sf), v.NOW_UNIX, 7)
    listed = "now_unix long, runs array<struct<run_id: long, source: string, state: string, messages_seen: long>>"
    return document.select(F.from_json("document", listed).alias("d")).select("d.now_unix", F.explode("d.runs").alias("run")) \
        .select("now_unix", "run.*")


@query
def run_history(spark, sf):
    return run_ops.history(v.runs(spark, sf), "500").select("run_id", "state", "source")


@query
def runs_public_projection(spark, sf):
    return run_ops.public(v.runs(spark, sf))


@query
def runs_abandoned(spark, sf):
    return run_ops.abandon_stale(v.runs(spark, sf), v.NOW_UNIX).select(
        "run_id", "state", "finished_at_unix", "updated_at_unix"
    )


@query
def process_newest_run(spark, sf):
    runs = v.runs(spark, sf)
    return run_ops.newest_of_process(runs, after=1000)


@query
def run_progress_fraction(spark, sf):
    runs = v.runs(spark, sf)
    return runs.select(
        "run_id", F.round(run_x.progress_fraction(runs), 6).alias("fraction"),
        F.when(F.col("bytes_done").isNotNull(), run_x.import_percent(F.col("bytes_done"), F.col("bytes_total")))
        .alias("percent"),
    )


@query
def run_display(spark, sf):
    runs, now = v.runs(spark, sf), F.lit(v.NOW_UNIX).cast("long")
    return runs.select(
        "run_id", run_x.source_label(F.col("source")).alias("source_label"),
        run_x.state_label(F.col("state")).alias("state_label"),
        run_x.duration_text(F.col("updated_at_unix") - F.col("started_at_unix")).alias("took"),
        run_x.duration_text(F.col("messages_seen")).alias("short_took"),
        run_x.relative_time(now, F.col("updated_at_unix")).alias("ago"),
        run_x.relative_time(F.col("updated_at_unix"), F.col("started_at_unix")).alias("started_before"),
        run_x.is_stalled(F.col("started_at_unix") + F.col("run_id") % 40, F.col("started_at_unix")).alias("stalled"),
    )


@query
def run_actions(spark, sf):
    runs = v.runs(spark, sf)
    return runs.select("run_id", F.concat_ws("|", run_x.recovery_actions(runs)).alias("actions"))


def _rates(spark, sf):
    return rates.sliding_rate(v.run_progress(spark, sf))


@query
def run_rate(spark, sf):
    return _rates(spark, sf).select(
        "run_id", "t_us", F.round("messages_per_sec", 4).alias("messages_per_sec"),
        F.round("bytes_per_sec", 3).alias("bytes_per_sec"),
    )


@query
def run_eta(spark, sf):
    rows = _rates(spark, sf)
    return rows.select("run_id", "t_us", rates.eta_seconds(rows).alias("eta_s"))


@query
def observed_rate(spark, sf):
    seen = v.observations(spark, sf).select("viewer", "t_us", "run_id", "messages_seen", "bytes_done")
    return rates.observed_rate(seen).select(
        "viewer", "t_us", "run_id", F.round("messages_per_sec", 4).alias("messages_per_sec")
    )


@query
def history_refreshes(spark, sf):
    seen = v.observations(spark, sf).select(
        "viewer", "t_us", "active_run_id", "active_state", "last_run_id", "last_state"
    )
    return run_ops.history_refreshes(seen, "viewer").select("viewer", "t_us", "runs_key")


@query
def retry_schedule(spark, sf):
    return run_ops.retry_schedule(v.attempts(spark, sf))


@query
def run_log(spark, sf):
    return run_ops.kept_log(v.log_lines(spark, sf)).select(
        "run_id", "line_no", F.octet_length("line").cast("long").alias("bytes"), F.md5("line").alias("line_md5")
    )


@query
def run_log_tail(spark, sf):
    return run_ops.log_tail(v.log_lines(spark, sf)).select("run_id", F.md5("tail").alias("tail_md5"))


