"""Mail-shaped views derived from the given tables.

The tables hold no mail, so messages, runs and logs are derived row by row:
every view grows with its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkmail.schemas import ERROR_KINDS

NOW_UNIX = 1_100_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[
        F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts
    ])


def _pick(selector: Column, *choices) -> Column:
    """choices[selector]; the last choice also takes what is left over."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, c in enumerate(choices[:-1]):
        out = out.when(selector == i, F.lit(c) if isinstance(c, str) else c)
    last = choices[-1]
    return out.otherwise(F.lit(last) if isinstance(last, str) else last)


# --- messages from `events` -----------------------------------------------


def mail_base(spark, sf) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), u,
        _text("User ", u, " <user", u, "@mail", u % 7, ".example.com>").alias("from_header"),
        F.when(F.col("event_id") % 10 != 0, _text("<e", F.col("event_id"), "@example.com>")).alias("message_id"),
    )


def scan_msgs(spark, sf) -> DataFrame:
    """The API-scan side."""
    return mail_base(spark, sf).filter(F.col("seq") % 4 != 3).withColumn("mail_id", _text("g", F.col("seq")))


def import_msgs(spark, sf) -> DataFrame:
    """The mbox side; messages without an id are skipped by the importer."""
    return mail_base(spark, sf).filter((F.col("seq") % 2 == 1) | (F.col("seq") % 10 == 0))


def replay_msgs(spark, sf) -> DataFrame:
    scan = scan_msgs(spark, sf)
    return scan.unionByName(scan.filter(F.col("seq") % 5 == 0))


def message_documents(spark, sf) -> DataFrame:
    """Message documents whose headers vary in case, value and presence."""
    e, u = F.col("event_id"), F.col("user_id")
    header = lambda n, v: F.struct(n.alias("name"), v.cast("string").alias("value"))
    address = _text("User ", u, " <user", u, "@mail", u % 7, ".example.com>")
    from_value = F.when(e % 7 == 0, None).when(e % 13 == 0, "").otherwise(address)
    headers = F.array_compact(F.array(
        header(F.lit("Subject"), _text("event ", e)),
        F.when(e % 11 != 0, header(_pick(e % 3, "From", "FROM", "from"), from_value)),
        header(_pick(e % 2, "Return-Path", "return-PATH"), _text("<bounce", u, "@example.net>")),
        F.when(e % 10 != 0, header(_pick(e % 3, "Message-ID", "MESSAGE-ID", "message-id"),
                                   _text("<e", e, "@example.com>"))),
        header(F.lit("From"), _text("second", u, "@example.org")),
    ))
    return table(spark, sf, "events").select(
        _text("g", e).alias("id"), F.struct(headers.alias("headers")).alias("payload")
    )


def sender_headers(spark, sf) -> DataFrame:
    """Sender headers in many shapes, and whole texts taken as headers."""
    e, u = F.col("event_id"), F.col("user_id")
    shaped = table(spark, sf, "events").select(
        F.lit("event").alias("src"), e.alias("id"),
        _pick(
            e % 12,
            _text("User ", u, " <user", u, "@mail", u % 7, ".example.com>"),
            _text("user", u, "@mail", u % 7, ".example.com"),
            _text("<deals-", u, "@shop.example>"),
            _text("user", u, "@example.museum"),
            _text("Jane <a+", u, "@x.com>"),
            _text("Foo ann", u, "@x.com <a+b@y.com>"),
            _text("not an email ", u),
            _text("Box Office <counter ", u, ">"),
            "",
            _text("Second.Third-", u, "@post-room.example.org"),
            _text("Üser <üser", u, "@exämple.org>"),
            _text("<a", u, "@b.c.d.example.com.x> tail\nsecond line"),
        ).alias("header"),
    )
    texts = table(spark, sf, "documents").select(
        F.lit("document").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("header")
    )
    return shaped.unionByName(texts)


def raw_message_ids(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("seq"),
        _pick(
            e % 10,
            _text("<e", e, "@example.com>"), _text("e", e, "@example.com"),
            _text("  <e", e, "@example.com>\t"), "<>", "<",
            _text("< e", e, " >"), "", _text(" <E", e, ">　"),
            _text("<e", e), F.lit(None).cast("string"),
        ).alias("raw"),
    )


def historical_seen(spark, sf) -> DataFrame:
    """Both sources ingested before ids were recorded for scanned rows."""
    none = F.lit(None).cast("string")
    scanned = scan_msgs(spark, sf).select("mail_id", none.alias("rfc_message_id"))
    imported = import_msgs(spark, sf).filter("message_id IS NOT NULL").select(
        _text("mid:", F.col("message_id")).alias("mail_id"),
        F.regexp_replace("message_id", "[<>]", "").alias("rfc_message_id"),
    )
    return scanned.unionByName(imported)


def historical_senders(spark, sf) -> DataFrame:
    u = F.col("user_id")
    address = _text("user", u, "@mail", u % 7, ".example.com").alias("sender")
    both = scan_msgs(spark, sf).select(address).unionByName(
        import_msgs(spark, sf).filter("message_id IS NOT NULL").select(address)
    )
    # A few counters were edited away, so that taking back stops at zero.
    return both.groupBy("sender").agg(F.count("*").alias("n")).select(
        "sender", F.when(F.endswith("sender", F.lit("mail3.example.com")), F.lit(5).cast("long"))
        .otherwise(F.col("n")).alias("mails_sent"),
    )


def repair_documents(spark, sf) -> DataFrame:
    """Fetched rows of the repair pass; every seventh row arrives twice."""
    u = F.col("user_id")
    fetched = scan_msgs(spark, sf).select(
        "seq", "mail_id", F.regexp_replace("message_id", "[<>]", "").alias("rfc_message_id"),
        _text("user", u, "@mail", u % 7, ".example.com").alias("sender"),
    )
    return fetched.unionByName(fetched.filter(F.col("seq") % 7 == 0))


def embedded_rows(spark, sf) -> DataFrame:
    """Stored rows from before ids had a column; import keys embed theirs."""
    raw = raw_message_ids(spark, sf)
    return raw.select(
        F.when(F.col("seq") % 4 == 0, _text("g", F.col("seq")))
        .when(F.col("seq") % 4 == 1, F.concat(F.lit("MID:"), F.coalesce("raw", F.lit(""))))
        .otherwise(F.concat(F.lit("mid:"), F.coalesce("raw", F.lit("")))).alias("mail_id"),
        F.when(F.col("seq") % 3 == 0, _text("kept", F.col("seq"))).alias("rfc_message_id"),
    )


def raw_senders(spark, sf) -> DataFrame:
    """An old counter table: NULL, empty, numeric and repeated senders, and
    counts that are no numbers, or begin with one."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.when(k % 50 == 0, F.lit(None).cast("string")).when(k % 50 == 1, "")
        .when(k % 50 == 2, (k % 1000).cast("string"))
        .otherwise(_text("C", F.floor(k / 2), "@", F.lower("c_mktsegment"), ".example")).alias("sender"),
        F.when(k % 89 == 0, "junk").when(k % 83 == 0, _text(k % 97, "abc")).when(k % 79 == 0, _text(" ", k % 97, ".7"))
        .otherwise((k % 97).cast("string")).alias("mails_sent"),
    )


def hidden_customers(spark, sf) -> DataFrame:
    """Hidden senders that the old counter table has, and one that it has not."""
    some = raw_senders(spark, sf).filter(F.col("sender").rlike("^C[0-9]*[37]@")).select("sender").distinct()
    return some.unionByName(hidden_senders(spark, sf))


def hidden_senders(spark, sf) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf, "events").select("user_id").distinct().filter(u % 11 == 0).select(
        _text("user", u, "@mail", u % 7, ".example.com").alias("sender")
    )


# --- archives from `conversations` and `documents` --------------------------


#: Bytes that are not UTF-8, in hex: a byte of no character, one cut short, a long form, a surrogate, none.
BROKEN_BYTES = ["FF", "C3", "E28C", "C080", "EDA080", ""]


def conversation_records(spark, sf) -> DataFrame:
    """One mbox record per turn: folded, repeated, missing and broken headers,
    overlong lines, CRLF. Text as the archive scan delivers it."""
    c, t, role = F.col("conv_id"), F.col("turn"), F.col("role")
    address = _text(role, ".", c, "@mail.example.com")
    pad = F.when(c % 5 == 1, F.repeat(F.lit("y"), F.lit(9000))).otherwise("")  # kept headers have no longest length
    sender = _pick(
        t % 4,
        _text('From: "', role, pad, '" <', address, ">\n"),
        _text("From: ", role, " of ", c, "\n\t<", address, ">\n"),
        _text("Return-Path: <bounce.", c, "@example.net>\n"),
        _text("FROM:\nfrom : ", address, "\nFrom: late@example.com\n"),
    )
    identity = _pick(
        c % 9, "", _text("Message-ID:\n <", c, ".", t, pad, "@example.com>\n"),
        _text("MESSAGE-ID: <", c, ".", t, pad, "@example.com>\n"),
    )
    long_line = F.when(t % 5 == 4, _text("X-Long: ", F.repeat(F.lit("a"), F.lit(9000)), "\n")).otherwise("")
    broken = F.when((c % 10 == 7) & (t == 1), "no colon here\n").otherwise("")
    head = F.concat(F.lit("sender@x Thu Jan  1 00:00:00 2020\n"), sender, long_line, identity, broken,
                    F.lit("Subject: s\n\tfolded\n\n"))
    crlf = F.when(c % 3 == 0, F.replace(head, F.lit("\n"), F.lit("\r\n"))).otherwise(head)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(crlf, F.col("text")).alias("value"))


def archive_messages(spark, sf) -> DataFrame:
    """Whole documents as mail messages, body lines escaped; `value` is the
    message without its last line end."""
    d = F.col("doc_id")
    body = F.regexp_replace("text", r"(?m)^(>*From )", ">$1")
    identity = F.when(d % 9 == 4, "").otherwise(_text("Message-ID: <d", d % 900, "@example.com>\n"))
    return table(spark, sf, "documents").select(
        "doc_id", "source",
        F.concat(
            _text("From ", F.col("source"), "@example.com Thu Jan  1 00:00:00 2020\n"),
            _text("From: ", F.col("lang"), " desk <", F.col("source"), "@", F.col("lang"), ".example.com>\n"),
            identity,
            F.when(d % 17 == 3, "broken header line\n").otherwise(""),
            F.lit("\n"), body,
        ).alias("value"),
    )


# --- runs and logs ----------------------------------------------------------


def runs(spark, sf) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    long = lambda col: col.cast("long")
    none = F.lit(None)
    source = _pick(k % 3, "gmail_api", "mbox", "backfill")
    open_state = _pick(F.instr(F.lit("OPF"), F.col("o_orderstatus")) - 1, "running", "awaiting_auth", "starting")
    states = ["failed", "cancelled", "done", "abandoned"]  # by priority
    state = _pick(F.substring("o_orderpriority", 1, 1).cast("int") - 1, *states, open_state)
    started = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf, "orders").select(
        long(k).alias("run_id"), source.alias("source"), state.alias("state"), long(c % 50).alias("pid"),
        started.alias("started_at_unix"), long(started + c % 400_000).alias("updated_at_unix"),
        long(c).alias("messages_seen"), long(F.floor(c / 2)).alias("messages_new"),
        F.when(k % 4 != 0, long(c + k % 1000)).alias("total_estimate"),
        F.floor("o_totalprice").alias("price"),
    )
    k, mbox = F.col("run_id"), F.col("source") == "mbox"
    return rows.select(
        "run_id", "source", "state", "pid", "started_at_unix", "updated_at_unix",
        F.when(F.col("state").isin(states), F.col("updated_at_unix")).alias("finished_at_unix"),
        "messages_seen", "messages_new", "total_estimate",
        F.when(mbox, F.col("price")).alias("bytes_total"),
        F.when(mbox, F.floor(F.col("price") * (k % 12) / 10)).alias("bytes_done"),
        F.when(mbox & (k % 5 != 0), _text("/mail/", k, ".mbox")).alias("mbox_path"),
        F.when(F.col("state") == "failed", _pick(k % 8, *ERROR_KINDS)).alias("error_kind"),
        F.when(F.col("state") == "failed", _text("run ", k, " failed")).alias("error"),
        F.when(F.col("state") == "awaiting_auth", _text("https://accounts.google.com/o?run=", k)).alias("auth_url"),
        F.when(k % 2 == 0, _text("token-", k)).alias("resume_token"),
        F.when(mbox, _text("fp-", k)).alias("mbox_fingerprint"),
    )


def run_events(spark, sf) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    progress = kind.isin("view", "click")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), e.alias("event_seq"),
        F.when(kind == "signup", "created").when(progress, "progress").when(kind == "purchase", "auth")
        .otherwise("finished").alias("event"),
        (e + 1_000).alias("at_unix"),
        F.when(kind == "signup", _pick(e % 3, "gmail_api", "mbox", "backfill")).alias("source"),
        F.when(kind == "signup", "running")
        .when(kind == "purchase", _pick(e % 2, "awaiting_auth", "running"))
        .when(kind == "error", _pick(e % 3, "done", "failed", "cancelled")).alias("state"),
        F.when(kind == "signup", e % 100).alias("pid"),
        F.when(progress, e).alias("messages_seen"), F.when(progress, F.floor(e / 2)).alias("messages_new"),
        F.when((kind == "click") & (e % 3 == 0), e * 2).alias("total_estimate"),
        F.when((kind == "signup") & (e % 2 == 0), e * 100).alias("bytes_total"),
        F.when((kind == "view") & (e % 3 != 0), e * 10).alias("bytes_done"),
        F.when((kind == "view") & (e % 5 == 0), _text("token-", e)).alias("resume_token"),
        F.lit(None).cast("string").alias("mbox_path"), F.lit(None).cast("string").alias("mbox_fingerprint"),
        F.when((kind == "error") & (e % 3 == 1), "other").alias("error_kind"),
        F.when((kind == "error") & (e % 3 == 1), _text("error ", e)).alias("error"),
        F.when((kind == "purchase") & (e % 2 == 0), _text("https://accounts.google.com/o?e=", e)).alias("auth_url"),
    )


def _micros(divisor: int) -> Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / divisor)


def run_progress(spark, sf) -> DataFrame:
    """Samples of each run; an hour of events is a second of progress."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), _micros(3600).alias("t_us"), e.alias("messages_seen"),
        F.when(e % 17 != 0, e * 4096).alias("bytes_done"),
        F.when(F.col("user_id") % 2 == 0, F.lit(1_000_000_000).cast("long")).alias("bytes_total"),
        F.when(F.col("user_id") % 5 != 0, F.lit(150_000).cast("long")).alias("total_estimate"),
    )


def observations(spark, sf) -> DataFrame:
    """What three viewers saw: the active run, or none, and its counters."""
    e = F.col("event_id")
    polls = table(spark, sf, "events").groupBy(
        _text("v", F.col("user_id") % 3).alias("viewer"), _micros(100).alias("t_us")
    ).agg(F.max("event_id").alias("event_id"))
    return polls.select(
        "viewer", "t_us", F.when(e % 13 != 0, F.floor(e / 40)).alias("run_id"),
        e.alias("messages_seen"), (e * 10).alias("bytes_done"),
        F.when(e % 9 < 6, F.floor(e / 50)).alias("active_run_id"),
        F.when(e % 20 < 10, "running").otherwise("awaiting_auth").alias("active_state"),
        F.when(e >= 50, F.floor(e / 50) - 1).alias("last_run_id"), F.lit("done").alias("last_state"),
    )


def attempts(spark, sf) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.floor(e / 1000).alias("run_id"), (e % 1000 + 1).alias("attempt_no"),
        (F.col("event_type") == "view").alias("made_progress"),
        (F.col("event_type") != "error").alias("transient"),
    )


def log_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        (F.col("doc_id") % 3).alias("run_id"), F.col("doc_id").alias("line_no"), F.col("text").alias("line")
    )


def failures(spark, sf) -> DataFrame:
    """Landed fetch errors: body, HTTP status, network flag, origin, message."""
    e = F.col("event_id")
    envelope = lambda rest: _text('{"error": {"message": "boom ', e, '", ', rest, "}}")
    reason = lambda r: envelope(f'"code": 403, "errors": [{{"domain": "d"}}, {{"reason": "{r}"}}]')
    return table(spark, sf, "events").select(
        e.alias("event_id"),
        _pick(
            e % 16, F.when(e % 3 == 1, envelope('"code": 400, "code": 429')).otherwise(envelope('"code": 429')),
            envelope('"code": 503'), envelope('"code": 400'),
            envelope('"code": 403, "status": "RESOURCE_EXHAUSTED"'), reason("rateLimitExceeded"),
            reason("userRateLimitExceeded"),
            F.when(e % 3 == 1, envelope('"code": 403, "errors": ["odd", 7, {"reason": "backendError"}]'))
            .otherwise(reason("backendError")), reason("insufficientPermissions"),
            reason("dailyLimitExceeded"), '{"message": "no envelope"}', "<html>busy</html>",
            "plain text", "", envelope('"code": "429"'), envelope('"code": 404, "status": "INTERNAL"'),
            F.lit(None).cast("string"),
        ).alias("body"),
        F.when(e % 32 < 16, 403).otherwise(404).alias("http_status"),
        ((e % 16 == 15) & (e % 3 == 0)).alias("network_error"),
        _pick(e % 7, "consent", "not_found", "io", "db", "api", "api", "other").alias("origin"),
        F.when(e % 19 == 0, _text("Error 400: policy_enforced ", e)).otherwise(_text("failed ", e)).alias("message"),
    )


def links(spark, sf) -> DataFrame:
    p = F.col("page_id")
    return table(spark, sf, "pages").select(
        "page_id",
        _pick(
            p % 5, F.col("url"), _text("https://accounts.google.com/o/oauth2?x=", p),
            _text("https://accounts.google.com-", p, ".example/"), _text("http://accounts.google.com/", p),
            F.lit(None).cast("string"),
        ).alias("url"),
    )
