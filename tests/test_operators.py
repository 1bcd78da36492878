"""Set-based operators against one-message-at-a-time models."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sparkmail.operators import counters, dedupe, ordered, rates, runs as run_ops, summary

SEEN = "mail_id string, rfc_message_id string"
BATCH = "seq long, mail_id string, rfc_message_id string, sender string"
SENDERS = "sender string, mails_sent long"


def forward_model(batch, seen, senders):
    seen, senders = dict(seen), dict(senders)
    flags = {}
    for seq, mail, rfc, sender in batch:
        if mail in seen:
            continue
        dup = rfc is not None and any(v == rfc for v in seen.values())
        seen[mail] = rfc
        flags[mail] = (seq, not dup)
        if not dup:
            senders[sender] = max(senders.get(sender) or 0, 0) + 1
    return flags, senders


def repair_model(batch, seen, senders):
    seen, senders = dict(seen), dict(senders)
    out = dict(examined=0, populated=0, missing_id=0, decremented=0, already_done=0)
    for _, mail, rfc, sender in batch:
        out["examined"] += 1
        if mail not in seen or seen[mail] is not None:
            out["already_done"] += 1
        elif rfc is None:
            seen[mail] = ""
            out["missing_id"] += 1
        else:
            dup = any(k != mail and v == rfc for k, v in seen.items())
            seen[mail] = rfc
            out["populated"] += 1
            if dup:
                out["decremented"] += 1
                if senders.get(sender) is not None and senders[sender] > 0:
                    senders[sender] -= 1
    return seen, senders, out


def random_state(rng):
    ids = [None, "", "a", "b", "c", "d"]
    seen = {f"m{i}": rng.choice(ids) for i in rng.sample(range(14), rng.randrange(8))}
    senders = {f"s{i}": rng.choice([-2, 0, 1, 5]) for i in rng.sample(range(4), rng.randrange(4))}
    batch = [(q, f"m{rng.randrange(14)}", rng.choice([None, "a", "b", "c", "e"]), f"s{rng.randrange(4)}")
             for q in range(rng.randrange(16))]
    return seen, senders, batch


def stack(spark, cases, schema):
    """All cases in one frame: keys of a case carry its number."""
    return spark.createDataFrame([r for case in cases for r in case], schema)


def tag(n, x):
    return None if x is None else f"{n}/{x}" if x != "" else ""


def test_forward_matches_message_loop(spark):
    rng = random.Random(11)
    seen, senders, batch, want_flags, want_senders = [], [], [], {}, {}
    for n in range(150):
        s, c, b = random_state(rng)
        rng.shuffle(b)
        flags, after = forward_model(sorted(b), s, c)
        seen.append([(tag(n, k), tag(n, v)) for k, v in s.items()])
        senders.append([(tag(n, k), v) for k, v in c.items()])
        batch.append([(q, tag(n, m), tag(n, r), tag(n, x)) for q, m, r, x in b])
        want_flags |= {tag(n, m): f for m, f in flags.items()}
        want_senders |= {tag(n, k): v for k, v in after.items()}
    new = dedupe.new_rows(stack(spark, batch, BATCH), stack(spark, seen, SEEN))
    assert {r.mail_id: (r.seq, r.counted) for r in new.collect()} == want_flags
    after = counters.add_counts(stack(spark, senders, SENDERS), counters.increments(new))
    assert {r.sender: r.mails_sent for r in after.collect()} == want_senders


def test_repair_matches_message_loop(spark):
    rng = random.Random(12)
    seen, senders, batch, want_seen, want_senders, total = [], [], [], {}, {}, {}
    for n in range(150):
        s, c, b = random_state(rng)
        after_seen, after, out = repair_model(b, s, c)
        seen.append([(tag(n, k), tag(n, v)) for k, v in s.items()])
        senders.append([(tag(n, k), v) for k, v in c.items()])
        batch.append([(q, tag(n, m), tag(n, r), tag(n, x)) for q, m, r, x in b])
        want_seen |= {tag(n, k): tag(n, v) for k, v in after_seen.items()}
        want_senders |= {tag(n, k): v for k, v in after.items()}
        total = {k: total.get(k, 0) + v for k, v in out.items()}
    fetched, state = stack(spark, batch, BATCH), stack(spark, seen, SEEN)
    repaired = dedupe.repair_rows(fetched, state)
    assert dedupe.repair_outcome(fetched, repaired).first().asDict() == total
    assert dict(rows(dedupe.apply_repairs(state, repaired))) == want_seen
    after = counters.take_back(stack(spark, senders, SENDERS), counters.decrements(repaired))
    assert dict(rows(after)) == want_senders


def test_key_with_a_third_of_all_rows(spark):
    """One copied message and one shared Message-ID, without broadcast joins."""
    n = 60_000
    base = spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), "id")).alias("mail_id"),
        F.when(F.col("id") % 3 == 1, "hot-id").when(F.col("id") % 3 == 2, F.concat(F.lit("r"), "id")).alias("rfc_message_id"),
        F.lit("s").alias("sender"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        new = dedupe.new_rows(base, spark.createDataFrame([("x", "r2")], SEEN))
        assert new.agg(F.count("*"), F.count_if("counted")).first()[:] == (1 + 2 * n // 3, 1 + 1 + n // 3 - 1)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert plan.count("partial_min_by") >= 2 and "CartesianProduct" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_add_and_take_back_leave_others_alone(spark):
    senders = spark.createDataFrame([("a", 3), ("b", -4), ("c", None), ("d", 0), (None, 2)], SENDERS)
    deltas = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("e", 5)], "sender string, n long")
    assert rows(counters.add_counts(senders, deltas)) == sorted(
        [("a", 5), ("b", 1), ("c", 1), ("d", 0), ("e", 5), (None, 2)], key=repr)
    assert rows(counters.take_back(senders, deltas)) == sorted(
        [("a", 1), ("b", -4), ("c", None), ("d", 0), (None, 2)], key=repr)


# --- ordered ----------------------------------------------------------------


@pytest.mark.parametrize("inclusive", [False, True])
def test_carry_last_crosses_tiles_and_groups(spark, inclusive, monkeypatch):
    monkeypatch.setattr(ordered, "TILES_PER_GROUP", 3)
    rng = random.Random(3)
    data, want = [], {}
    for key in "ab":
        last, times = None, sorted(rng.sample(range(400), 120))
        for t in times:
            value = rng.choice([None, None, None, t])
            want[key, t] = value if inclusive and value is not None else last
            last = value if value is not None else last
            data.append((key, t, value))
    df = spark.createDataFrame(data, "k string, t long, v long")
    got = ordered.carry_last(df, ["k"], "t", F.col("v"), "last", 10, inclusive)
    assert {(r.k, r.t): r.last for r in got.collect()} == want


def test_positions_are_global(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x")).repartition(7)
    got = ordered.with_position(df, F.col("x"))
    assert got.filter("position <> x").count() == 0 and got.count() == 5000


def test_repair_batches(spark):
    ids = [(f"g{i:04d}", None) for i in range(1203)] + [("mid:x", None), ("g9", "known"), ("", None)]
    got = summary.repair_batches(spark.createDataFrame(ids, SEEN))
    assert rows(got.groupBy("batch_no").agg(F.count("*"), F.min("mail_id"))) == [
        (0, 500, "g0000"), (1, 500, "g0500"), (2, 203, "g1000"),
    ]


# --- rates ------------------------------------------------------------------


def rate_model(samples):
    """Sliding window of one observer: (t, run, messages, bytes) in order."""
    window, current, out = [], None, []
    for t, run, m, b in samples:
        if run is None:
            window, current = [], None
            continue
        if run != current:
            window, current = [], run
        window.append((t, m, b))
        while t - window[0][0] > 30_000_000 and len(window) > 2:
            window.pop(0)
        t0, m0, b0 = window[0]
        if t - t0 < 500_000:
            out.append((t, None, None))
            continue
        secs = (t - t0) / 1e6
        out.append((t, max(m - m0, 0) / secs, None if b is None or b0 is None else max(b - b0, 0) / secs))
    return out


def random_samples(rng, n, runs):
    t = 0
    for _ in range(n):
        t += rng.choice([100_000, 400_000, 3_000_000, 9_000_000, 31_000_000, 95_000_000])
        yield t, rng.choice(runs), rng.randrange(1000), rng.choice([None, rng.randrange(10_000)])


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_sliding_rate_matches_window(spark):
    rng = random.Random(8)
    series = {run: list(random_samples(rng, 120, [run])) for run in range(12)}
    df = spark.createDataFrame(
        [(run, t, m, b) for run, s in series.items() for t, _, m, b in s],
        "run_id long, t_us long, messages_seen long, bytes_done long",
    )
    got = {(r.run_id, r.t_us): (r.messages_per_sec, r.bytes_per_sec) for r in rates.sliding_rate(df).collect()}
    for run, s in series.items():
        for t, m, b in rate_model(s):
            assert close(got[run, t][0], m) and close(got[run, t][1], b), (run, t)


def test_observed_rate_starts_over(spark):
    rng = random.Random(9)
    series = {f"v{i}": list(random_samples(rng, 150, [1, 1, 1, 2, None])) for i in range(8)}
    df = spark.createDataFrame(
        [(v, *s) for v, ss in series.items() for s in ss],
        "viewer string, t_us long, run_id long, messages_seen long, bytes_done long",
    )
    got = {(r.viewer, r.t_us): (r.messages_per_sec, r.bytes_per_sec) for r in rates.observed_rate(df).collect()}
    want = {(v, t): (m, b) for v, s in series.items() for t, m, b in rate_model(s)}
    assert got.keys() == want.keys()
    assert all(close(got[k][0], want[k][0]) and close(got[k][1], want[k][1]) for k in want)


def test_rate_and_eta_literals(spark):
    df = spark.createDataFrame(
        [(1, 0, 100, 1000, 50_000, None), (1, 2_000_000, 180, 9000, 50_000, None),
         (2, 0, 100, None, None, 580), (2, 2_000_000, 180, None, None, 580),
         (3, 0, 180, None, None, 580), (3, 2_000_000, 180, None, None, 580)],
        "run_id long, t_us long, messages_seen long, bytes_done long, bytes_total long, total_estimate long",
    )
    got = rates.sliding_rate(df).filter("t_us > 0")
    got = got.select("run_id", "messages_per_sec", "bytes_per_sec", rates.eta_seconds(got))
    assert rows(got) == [(1, 40.0, 4000.0, 11), (2, 40.0, None, 10), (3, 0.0, None, None)]


# --- runs -------------------------------------------------------------------


def test_history_limits(spark):
    runs = spark.createDataFrame([(i,) for i in range(1, 151)], "run_id long")
    count = lambda limit: run_ops.history(runs, limit).count()
    assert [count(x) for x in (3, "3", None, "bogus", 0, -4, 500)] == [3, 3, 20, 20, 1, 1, 100]
    assert [r[0] for r in run_ops.history(runs, 2).collect()] == [150, 149]


def test_history_document(spark):
    runs = spark.createDataFrame(
        [(i, "mbox", "done", i, None, f"secret{i}") for i in range(1, 6)],
        "run_id long, source string, state string, messages_seen long, error string, resume_token string",
    )
    doc = json.loads(run_ops.history_document(runs, 9, 3).first()["document"])
    assert [r["run_id"] for r in doc["runs"]] == [5, 4, 3] and doc["now_unix"] == 9
    assert doc["runs"][0] == {"run_id": 5, "source": "mbox", "state": "done", "messages_seen": 5, "error": None}


def test_scan_resume_token(spark):
    runs = spark.createDataFrame([(1, "gmail_api", "t"), (2, "gmail_api", ""), (3, "mbox", None)],
                                 "run_id long, source string, resume_token string")
    assert [run_ops.scan_resume_token(runs, i) for i in (1, 2)] == ["t", None]
    for bad in (3, 9):
        with pytest.raises(ValueError):
            run_ops.scan_resume_token(runs, bad)


def test_log_keeps_lines_whole_or_cut(spark):
    lines = [(1, i, f"line {i}") for i in range(230)] + [(1, 230, "é" * 3000)]
    table = spark.createDataFrame(lines, "run_id long, line_no long, line string")
    assert max(r.line for r in run_ops.kept_log(table).collect()) == "é" * 3000
    got = run_ops.kept_log(table, line_bytes=4096)
    kept = sorted((r.line_no, r.line) for r in got.collect())
    assert len(kept) == 200 and kept[0] == (31, "line 31") and kept[-1][1] == "é" * 2048
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    tail = run_ops.log_tail(spark.createDataFrame(lines[:7], "run_id long, line_no long, line string"))
    assert tail.first()["tail"] == "line 2 | line 3 | line 4 | line 5 | line 6"


# --- summary ----------------------------------------------------------------


def test_summary_merges_loose_senders(spark):
    old = spark.createDataFrame([(None, "4"), ("", "1"), ("40404", "7"), ("a@b.com", "x")], "sender string, mails_sent string")
    assert rows(summary.summary_senders(old)) == [("", 5), ("40404", 7), ("a@b.com", 0)]


def test_mixed_sources_states(spark):
    state = lambda *r: rows(summary.mixed_sources(spark.createDataFrame(list(r), SEEN)))
    assert state() == [(False, 0)]
    assert state(("g1", None), ("g2", None)) == [(False, 0)]
    assert state(("g1", None), ("g2", None), ("mid:<m1>", "m1")) == [(True, 2)]
    assert state(("g1", "m2"), ("g2", ""), ("mid:<m1>", "m1")) == [(False, 0)]
    assert state(("mid:<m1>", "m1"), ("MID:<m2>", None)) == [(False, 0)]


def test_stored_counts(spark):
    table = {"12abc": 12, "3.7": 3, " 5": 5, "-4x": -4, "+6": 6, "junk": 0, "": 0, "1e3": 1, "9" * 30: 2**63 - 1, "-" + "9" * 30: -(2**63)}
    counts = spark.createDataFrame([(k,) for k in table], "c string").select("c", summary.stored_count(F.col("c")).alias("n"))
    assert {r.c: r.n for r in counts.collect()} == table


def test_pages(spark):
    ranked = spark.range(120).select(F.format_string("s%03d", "id").alias("sender"), (F.col("id") % 4).alias("mails_sent"))
    order = [r.sender for r in ranked.orderBy(*summary.by_rank()).collect()]
    for number, size, at, pages in [(1, 25, 1, 5), (5, 25, 5, 5), (99, 50, 3, 3), (-3, 100, 1, 2), (2, 7, 2, 3)]:
        got = summary.page(ranked, number, size).orderBy("rank").collect()
        step = size if size in summary.PAGE_SIZES else 50
        assert [r.sender for r in got] == order[(at - 1) * step: at * step]
        assert {(r.page, r.pages, r.listed) for r in got} == {(at, pages, 120)}


@pytest.mark.parametrize("n", [0, 120])
def test_stored_pages(spark, tmp_path, n):
    ranked = spark.range(n).select(F.format_string("s%03d", "id").alias("sender"), (F.col("id") % 4).alias("mails_sent"))
    summary.store_order(ranked, str(tmp_path), slab=100)
    for number, size in [(1, 25), (5, 25), (99, 50), (-3, 100), (2, 7)]:
        got = summary.stored_page(spark, str(tmp_path), number, size, hidden=3)
        wanted = summary.page(ranked, number, size, hidden=3)
        assert got.columns == wanted.columns and rows(got) == rows(wanted)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "Exchange" not in plan and (not n or "PartitionFilters: [isnotnull(slab" in plan)
    with pytest.raises(ValueError):
        summary.stored_page(spark, str(tmp_path), 1, 500)


def test_carry_by_volume_spreads_a_dense_key(spark):
    """One viewer, all samples within a moment: the same as one by one, and spread over all tiles."""
    seen = spark.range(20_000).select(
        F.when(F.col("id") % 7 > 0, "v").alias("viewer"), F.col("id").alias("t_us"),
        F.when(F.hash("id") % 50 == 0, F.col("id").cast("string")).alias("mark"))
    got = ordered.carry_by_volume(seen, ["viewer"], "t_us", F.col("mark"), "before")
    assert got.columns == ["viewer", "t_us", "mark", "before"]
    last, wanted = {}, []
    for r in seen.orderBy("t_us").collect():
        wanted.append((*r, last.get(r.viewer)))
        if r.mark is not None:
            last[r.viewer] = r.mark
    assert rows(got) == sorted(wanted, key=repr)
    tiles = spark.conf.get("spark.sql.shuffle.partitions")
    placed = seen.repartitionByRange(int(tiles), "viewer", "t_us").groupBy(F.spark_partition_id()).count()
    assert max(r[1] for r in placed.collect()) < 20_000 / int(tiles) * 1.5


def test_quality_flags_problems(spark):
    listed = spark.createDataFrame([("a@x.example", 3), ("a@x.example", 1), ("b@evil.test", 2), ("no-at", 1)], SENDERS)
    got = summary.quality(listed, F.lit(8), 7, F.lit(3)).first()
    assert got[:] == (7, 4, 1, 2, False, True, False)


def test_document_reads_back_in_rank_order(spark, tmp_path):
    ranked = spark.createDataFrame([("b", 1), ("a", 1), ("c", 9)], SENDERS)
    seen = spark.createDataFrame([("g1", None), ("g2", None)], SEEN)
    path = str(tmp_path / "doc")
    summary.write_document(summary.document_rows(seen, ranked, 5), path)
    assert [r.value for r in spark.read.text(path).coalesce(1).collect()][0].startswith('{"total_messages":2')
    lines = [line for f in sorted((tmp_path / "doc").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ['{"total_messages":2,"generated_at_unix":5}', '{"sender":"c","mails_sent":9}',
                     '{"sender":"a","mails_sent":1}', '{"sender":"b","mails_sent":1}']


def test_readiness_and_onboarding(spark):
    empty, some = spark.createDataFrame([], SEEN), spark.createDataFrame([("g1", None)], SEEN)
    active = spark.createDataFrame([(1, "running")], "run_id long, state string")
    assert rows(summary.readiness(empty)) == [("empty", True)]
    assert rows(summary.readiness(empty, active)) == [("empty", False)]
    assert rows(summary.readiness(some)) == [("ready", False)]
