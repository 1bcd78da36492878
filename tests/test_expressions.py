"""Literal tables for the column expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sparkmail.functions import errors, identity, runs as run_x
from sparkmail.sources import documents, messages


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


SENDERS = {
    "Harbour Office <ferry.times@port.test>": "ferry.times@port.test",
    "<tickets@port.test>": "tickets@port.test",
    "tickets@port.test": "tickets@port.test",
    "night-shift.7@dock-3.port.test": "night-shift.7@dock-3.port.test",
    "Dock <night-shift.7@dock-3.port.test>": "night-shift.7@dock-3.port.test",
    "plain words only": "plain words only",
    "Pier <gate seven>": "Pier <gate seven>",
    "": "",
    "<offers@quay.harbour>": "offers@quay.harb",
    "b@port.harbour": "b@port.harbour",
    "Pilot <one+two@quay.net>": "Pilot <one+two@quay.net>",
    "Crew tom@quay.net <one+two@pier.net>": "m@quay.net",
    "P <p@port.test>\nsecond line": "P <p@port.test>\nsecond line",
    "PILOT@Port.TEST": "PILOT@Port.TEST",
    "Ö <ö@häfen.test>": "ö@häfen.test",
}


def test_clean_sender(spark):
    assert apply(spark, list(SENDERS), identity.clean_sender) == list(SENDERS.values())


def test_clean_sender_matches_backtracking_expression(spark):
    bracket = re.compile(r"^[^<]*<?([\w\-\.]+@([\w-]+\.)+[\w-]{2,4}).*\Z")
    bare = re.compile(r"^([\w\-\.]+@([\w-]+\.)+[\w-]{2,4})\Z")

    def model(s):
        m = (bracket if "<" in s else bare).match(s)
        return m.group(1) if m else s

    rng = random.Random(5)
    bits = ["a", "b1", "é", ".", "..", "-", "@", "<", ">", " ", "\n", "com", "x", "+", ".c", ".co", ".shop", "a@b.co"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(20_000)]
    # Some thousand labels must not overflow the stack of the regex engine.
    texts += ["x <x@" + "a." * 4000 + "com>", "x@" + "a." * 4000 + "com", "x <x@" + "a." * 4000 + "c>"]
    assert apply(spark, texts, identity.clean_sender) == [model(t) for t in texts]


def test_normalize_message_id(spark):
    table = {
        "<77.ferry@port.test>": "77.ferry@port.test", "77.ferry@port.test": "77.ferry@port.test",
        "\t<77.ferry@port.test>\n": "77.ferry@port.test", "< q >": "q", "\u2003<q>\u205f": "q",
        "<Upper@lower>": "Upper@lower", "<<q>>": "<q>", "<": "<", ">": ">", "<q": "<q", "q>": "q>",
        "<>": None, "<\t>": None, "": None, "\n\n": None,
    }
    assert apply(spark, list(table), identity.normalize_message_id) == list(table.values())


def test_embedded_ids(spark):
    df = spark.createDataFrame(
        [("mid:<m1@x>", None), ("MID: m2 ", None), ("mid:<>", None), ("g1", None), ("mid:<m3>", "kept")],
        "mail_id string, rfc string",
    )
    got = df.select(identity.embedded_message_id(F.col("mail_id"), F.col("rfc"))).collect()
    assert [r[0] for r in got] == ["m1@x", "m2", "", None, "kept"]


def test_header_lookup_and_sender_priority(spark, tmp_path):
    (tmp_path / "docs.json").write_text("\n".join([
        '{"id":"1","payload":{"headers":[{"name":"Return-Path","value":"b@x.com"},{"name":"fRoM","value":"a@x.com"}]}}',
        '{"id":"2","payload":{"headers":[{"name":"From"},{"name":"Return-Path","value":"b@x.com"}]}}',
        '{"id":"3","payload":{"headers":[{"name":"From","value":""},{"name":"Return-Path","value":"b@x.com"}]}}',
        '{"id":"4","payload":{"headers":[{"name":"Subject","value":"s"},{"name":"MESSAGE-ID","value":" <m4@x> "}]}}',
        '{"id":"5"}',
    ]))
    found = messages.read_messages(spark, str(tmp_path))
    assert rows(messages.message_fields(found), "mail_id", "rfc_message_id", "sender") == [
        ("1", None, "a@x.com"), ("2", None, "b@x.com"), ("3", None, ""), ("4", "m4@x", ""), ("5", None, ""),
    ]
    kept = messages.metadata_only(found).select("id", F.size("payload.headers"))
    assert rows(kept) == [("1", 2), ("2", 2), ("3", 2), ("4", 1), ("5", None)]


def test_duration_and_relative_time(spark):
    assert apply(spark, [-5, 0, 89, 90, 150, 5369, 5370, 5400, 7230], run_x.duration_text, "long") == [
        "0s", "0s", "89s", "2 min", "3 min", "89 min", "1 h 30 min", "1 h 30 min", "2 h 1 min",
    ]
    ago = lambda then: run_x.relative_time(F.lit(1_000_000).cast("long"), then)
    thens = [1_000_005, 1_000_000 - 59, 1_000_000 - 60, 1_000_000 - 3599, 1_000_000 - 5400, 1_000_000 - 172_799, 1_000_000 - 172_800]
    assert apply(spark, thens, ago, "long") == [
        "just now", "just now", "1 min ago", "60 min ago", "2 h ago", "48 h ago", "2 d ago",
    ]


def test_labels(spark):
    assert apply(spark, ["mbox", "gmail_api", "backfill", "other", "", None], run_x.source_label) == [
        "Takeout import", "Gmail scan", "Message-ID backfill", "other", "Ingestion", "Ingestion",
    ]
    assert apply(spark, ["awaiting_auth", "done"], run_x.state_label) == ["awaiting authorization", "done"]


def test_progress_and_percent(spark):
    df = spark.createDataFrame(
        [(1, 100, 50, None, 0), (2, 100, 300, None, 0), (3, 0, 5, 10, 5), (4, None, None, 10, 50),
         (5, None, None, None, 5), (6, 100, None, 10, 5), (7, None, None, 0, 5)],
        "i int, bytes_total long, bytes_done long, total_estimate long, messages_seen long",
    )
    assert [r[0] for r in df.orderBy("i").select(run_x.progress_fraction(df)).collect()] == [
        0.5, 1.0, 0.5, 1.0, None, 0.5, None,
    ]
    percent = df.filter("i < 4").orderBy("i").select(run_x.import_percent(F.col("bytes_done"), F.col("bytes_total")))
    assert [r[0] for r in percent.collect()] == [50, 100, 100]


def test_recovery_actions(spark):
    cases = [
        ("mbox", "failed", 10, "/a", 5, None, ["Resume import"]),
        ("mbox", "failed", 0, "/a", 5, None, ["Retry"]),
        ("mbox", "cancelled", 10, None, 5, None, []),
        ("gmail_api", "failed", None, None, 0, "policy_enforced", ["Retry", "Use Takeout instead →"]),
        ("gmail_api", "abandoned", None, None, 3, None, ["Retry", "Resume — may restart from the beginning"]),
        ("gmail_api", "cancelled", None, None, 0, None, ["Start again"]),
        ("gmail_api", "cancelled", None, None, 3, None, ["Resume — may restart from the beginning"]),
        ("gmail_api", "done", None, None, 3, None, []),
        ("backfill", "failed", None, None, 3, None, []),
    ]
    df = spark.createDataFrame(
        [(i, *c[:6]) for i, c in enumerate(cases)],
        "i int, source string, state string, bytes_done long, mbox_path string, messages_seen long, error_kind string",
    )
    assert [r[0] for r in df.orderBy("i").select(run_x.recovery_actions(df)).collect()] == [c[6] for c in cases]


def test_consent_link(spark):
    table = {
        "https://accounts.google.com/pier?x=7": True, "https://accounts.google.com": False,
        "https://accounts.google.com-port.test/": False, "http://accounts.google.com/pier": False,
        "https://accounts.google.com:pw@port.test/": False, "data:text/plain,x": False,
    }
    assert apply(spark, [*table, None], run_x.is_consent_url) == [*table.values(), False]


def test_error_triage(spark):
    env = lambda rest: '{"error":{"message":"boom",' + rest + "}}"
    reason = lambda r: env(f'"code":403,"errors":[{{"domain":"d","reason":"{r}"}}]')
    cases = [
        (env('"code":429'), 429, False, True), (env('"code":500'), 500, False, True), (env('"code":503'), 503, False, True),
        (env('"code":400'), 400, False, False), (env('"code":401'), 401, False, False),
        (env('"code":403'), 403, False, False), (env('"code":404'), 404, False, False),
        (reason("rateLimitExceeded"), 403, False, True), (reason("userRateLimitExceeded"), 403, False, True),
        (reason("backendError"), 403, False, True), (reason("insufficientPermissions"), 403, False, False),
        (reason("dailyLimitExceeded"), 403, False, False), (reason("domainPolicy"), 403, False, False),
        (env('"code":403,"status":"RESOURCE_EXHAUSTED"'), 403, False, True),
        ('{"message":"no envelope"}', 403, False, False), ("[1]", 503, False, False),
        ("<html>", 403, False, True), ("<html>", 429, False, True), ("<html>", 502, False, True), ("<html>", 404, False, False),
        (None, None, True, True), (None, None, False, False),
        (env('"code":400,"code":429'), 400, False, True), (env('"code":429,"code":400'), 429, False, False),
        (env('"code":403,"errors":["odd",3,null,{"reason":"backendError"}]'), 403, False, True),
        (env('"code":403,"errors":["backendError",{"reason":7}]'), 403, False, False),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)],
                               "i int, body string, http_status int, network_error boolean")
    got = errors.with_transient(df).orderBy("i").select("transient").collect()
    assert [r[0] for r in got] == [c[3] for c in cases]


def test_error_kind_and_backoff(spark):
    cases = [
        ("Error 400: policy_enforced", "consent", False, "policy_enforced"), ("timeout", "consent", False, "auth_required"),
        ("x", "not_found", False, "missing_credentials"), ("x", "io", False, "io"), ("x", "db", False, "db"),
        ("x", "api", True, "rate_limited"), ("x", "api", False, "gmail_api"), ("x", None, False, "other"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, m string, o string, t boolean")
    got = df.orderBy("i").select(errors.error_kind(F.col("m"), F.col("o"), F.col("t"))).collect()
    assert [r[0] for r in got] == [c[3] for c in cases]
    assert apply(spark, [0, 1, 2, 3, 6, 7, 50], errors.backoff_seconds, "long") == [1, 1, 2, 4, 32, 32, 32]


def test_summary_and_spec_documents(spark, tmp_path):
    (tmp_path / "summary.json").write_text(
        '{\n "total_messages": 5,\n "generated_at_unix": 7,\n "senders": [\n'
        '  {"sender": "a@x.example", "mails_sent": 3},\n  {"sender": "b@x.example", "mails_sent": 2}\n ]\n}\n'
    )
    head, senders = documents.read_summary(spark, str(tmp_path / "summary.json"))
    assert rows(head) == [(5, 7)] and rows(senders) == [("a@x.example", 3), ("b@x.example", 2)]
    (tmp_path / "spec.json").write_text(
        '{"total_messages_min": 5, "distinct_senders": 2, "seed": 1,'
        ' "top_senders": [{"sender": "a@x.example", "mails_sent": 3, "category": "k"}],'
        ' "categories": [{"key": "k", "sender_count": 2, "total_messages": 5, "zipf_s": 1}]}'
    )
    limits, categories, heroes = documents.read_spec(spark, str(tmp_path / "spec.json"))
    assert rows(limits) == [(5, 2)] and rows(categories) == [("k", 2, 5)] and rows(heroes) == [("a@x.example", 3, "k")]


@pytest.mark.parametrize("name", ["ſubject", "From ", "ﬁ"])
def test_header_names_are_ascii(spark, name):
    from sparkmail.functions.mbox_headers import parse_headers
    got = apply(spark, [f"sep\n{name}: v\n\n"], lambda x: parse_headers(x)["from_"])
    assert got == (["v"] if name == "From " else [None])
