"""mbox scan: framing, headers, offsets, sniff, fingerprint, resume."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sparkmail.sources import mbox

SEP_A = "From a@example.com Thu Jan  1 00:00:00 2020\n"
SEP_B = "From b@example.com Thu Jan  1 00:00:00 2020\n"
TWO = (
    SEP_A + "From: Alice <a@example.com>\nMessage-ID: <m1@example.com>\nSubject: hello\n\n"
    "body line one\nbody line two\n"
    + SEP_B + "Return-Path: <bounce@example.com>\nMessage-ID: <m2@example.com>\n\nbody\n"
)


def scan(spark, folder):
    return mbox.with_status(mbox.with_offsets(mbox.parse_records(mbox.read_mbox(spark, str(folder)))))


def scan_text(spark, tmp_path, data):
    if isinstance(data, str):
        data = data.encode()
    (tmp_path / "in.mbox").write_bytes(data)
    return scan(spark, tmp_path).orderBy("start_offset").collect()


def good(found):
    return [r for r in found if r.status == "message"]


def skipped(found):
    return sum(r.status in ("malformed", "junk") for r in found)


@pytest.mark.parametrize("data", [TWO, TWO.replace("\n", "\r\n")])
def test_two_messages(spark, tmp_path, data):
    found = scan_text(spark, tmp_path, data)
    assert [(r.from_, r.return_path, r.message_id) for r in found] == [
        ("Alice <a@example.com>", None, "<m1@example.com>"),
        (None, "<bounce@example.com>", "<m2@example.com>"),
    ]
    second = data.index("From b@")
    assert [(r.start_offset, r.end_offset) for r in found] == [(0, second), (second, len(data))]


CASES = {
    "escaped separators stay in the body": (
        SEP_A + "From: a@example.com\nMessage-ID: <m1@x>\n\n>From the archive\n>>From twice\nend\n",
        [("a@example.com", "<m1@x>")], 0),
    "unescaped separator splits": (
        SEP_A + "From: a@example.com\nMessage-ID: <m1@x>\n\nFrom here on, body\nmore body\n",
        [("a@example.com", "<m1@x>")], 1),
    "no id": (SEP_A + "From: a@example.com\nSubject: none\n\nbody\n", [("a@example.com", None)], 0),
    "malformed header section": (
        SEP_A + "From: a@example.com\nnot a header\ngarbage\n" + SEP_B
        + "From: b@example.com\nMessage-ID: <m2@x>\n\nbody\n",
        [("b@example.com", "<m2@x>")], 1),
    "junk first": (
        "random junk\nmore junk\n" + SEP_A + "From: a@example.com\nMessage-ID: <m1@x>\n\nbody\n",
        [("a@example.com", "<m1@x>")], 1),
    "blank lines first": (
        "\n\r\n\n" + SEP_A + "From: a@example.com\nMessage-ID: <m1@x>\n\nbody\n",
        [("a@example.com", "<m1@x>")], 0),
    "folded": (
        SEP_A + "From: A Long Name\n\t<folded@example.com>\nMessage-ID:\n <f@x>\n\nbody\n",
        [("A Long Name <folded@example.com>", "<f@x>")], 0),
    "continuation first": (SEP_A + " folded\nMessage-ID: <m1@x>\n\nbody\n", [], 1),
    "long lines": (
        SEP_A + "X-Long: " + "a" * 24576 + "\nMessage-ID: <m1@x>\n\n" + "a" * 24576 + "\n"
        + SEP_B + "Message-ID: <m2@x>\n\nbody\n",
        [(None, "<m1@x>"), (None, "<m2@x>")], 0),
    "no body, no line end": (SEP_A + "From: a@x\nMessage-ID: <m1@x>", [("a@x", "<m1@x>")], 0),
    "separator right after headers": (
        SEP_A + "Message-ID: <m1@x>\n" + SEP_B + "Message-ID: <m2@x>\n\nbody\n",
        [(None, "<m1@x>"), (None, "<m2@x>")], 0),
}


@pytest.mark.parametrize("name", CASES)
def test_literal_cases(spark, tmp_path, name):
    data, messages, bad = CASES[name]
    found = scan_text(spark, tmp_path, data)
    assert [(r.from_, r.message_id) for r in good(found)] == messages
    assert skipped(found) == bad
    assert max(r.end_offset for r in found) == len(data)


def test_names_ignore_case_and_first_value_wins(spark, tmp_path):
    found = scan_text(
        spark, tmp_path,
        SEP_A + "RETURN-PATH:\nreturn-path: <first@x>\nReturn-Path: <second@x>\nMESSAGE-id: <m@x>\n\nb\n",
    )
    assert (found[0].return_path, found[0].message_id) == ("<first@x>", "<m@x>")


# --- randomized check against a line-by-line model ---------------------------

SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                          0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def model(data: bytes):
    """(messages, skipped) of a sequential header-only reader."""
    lines, at = [], 0
    for raw in data.split(b"\n")[:-1] if data.endswith(b"\n") else data.split(b"\n"):
        end = min(at + len(raw) + 1, len(data))
        lines.append((at, raw[:-1] if raw.endswith(b"\r") else raw))
        at = end
    starts = [i for i, (_, l) in enumerate(lines) if l.startswith(b"From ")]
    out, bad = [], 0
    head = lines[: starts[0]] if starts else lines
    bad += any(l for _, l in head)
    for k, i in enumerate(starts):
        stop = starts[k + 1] if k + 1 < len(starts) else len(lines)
        end = lines[stop][0] if stop < len(lines) else len(data)
        got, cur, broken = {}, None, False

        def close():
            if cur and cur[0] in (b"from", b"return-path", b"message-id") and cur[1]:
                got.setdefault(cur[0], cur[1])

        for _, l in lines[i + 1: stop]:
            if not l:
                break
            if l[:1] in (b" ", b"\t"):
                if cur is None:
                    broken = True
                    break
                part = l.decode("utf-8", "replace").strip(SPACE)
                if part:
                    cur[1] = f"{cur[1]} {part}" if cur[1] else part
                continue
            name, colon, rest = l.partition(b":")
            if not colon or not name:
                broken = True
                break
            close()
            cur = [name.strip(b"\t\n\x0c\r ").lower(), rest.decode("utf-8", "replace").strip(SPACE)]
        if broken:
            bad += 1
            continue
        close()
        out.append((lines[i][0], end, *[got.get(h) for h in (b"from", b"return-path", b"message-id")]))
    return out, bad


def random_mbox(rng):
    pieces = [
        b"From: ", b"from:", b"Return-Path: <r@x>", b"Message-ID: <m%d@x>" % rng.randrange(9),
        b"MESSAGE-ID :\t", b"Subject: s", b" folded", b"\t", b" ", b"", b"", b"body", b">From x", b"From x",
        b"From ", b"From \xff: y", b"bad line", b":", b"\x0cFrom: ff", b"From: \xc3\xa9\xe2\x82",
        b"From: " + b"z" * rng.choice([10, 8180, 8186, 8190, 9000]),
        b" " + b"y" * rng.choice([5, 4000, 8191, 9000]), b"From: \xe2\x80\x83<u@x>\xc2\xa0", b"\r",
    ]
    eol = rng.choice([b"\n", b"\r\n"])
    body = eol.join(rng.choice(pieces) for _ in range(rng.randrange(1, 40)))
    start = rng.choice([b"From start" + eol, b"From start" + eol, b""])
    return start + body + rng.choice([eol, b"", eol + b"From ", eol + b"From " + eol + b"From "])


@pytest.mark.parametrize("files, split_bytes", [(25, 300), (200, 128 * 1024 * 1024)])
def test_matches_sequential_reader(spark, tmp_path, files, split_bytes):
    rng = random.Random(20)
    expected = {}
    for i in range(files):
        data = random_mbox(rng)
        path = tmp_path / f"f{i:03d}.mbox"
        path.write_bytes(data)
        expected[path.name] = model(data)
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        found = scan(spark, tmp_path).withColumn("name", F.substring_index("file", "/", -1)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    got = {name: ([], 0) for name in expected}
    for r in found:
        messages, bad = got[r.name]
        if r.status == "message":
            messages.append((r.start_offset, r.end_offset, r.from_, r.return_path, r.message_id))
        got[r.name] = (messages, bad + (r.status in ("malformed", "junk")))
    got = {n: (sorted(m, key=lambda t: t[:2]), b) for n, (m, b) in got.items()}
    wrong = {n: (got[n], expected[n]) for n in expected if got[n] != expected[n]}
    assert not wrong, next(iter(wrong.items()))


def test_sniff_rejects_other_files(spark, tmp_path):
    (tmp_path / "good.mbox").write_text(TWO)
    (tmp_path / "notes.txt").write_text("not mail\nFrom x\nFrom: a@x\nMessage-ID: <m@x>\n\n")
    valid, rejected = mbox.split_valid_files(scan(spark, tmp_path))
    name = F.substring_index("file", "/", -1)
    assert rows(valid.select(name).distinct()) == [("good.mbox",)]
    assert rows(rejected.select(name)) == [("notes.txt",)]


def test_fingerprint_and_resume(spark, tmp_path):
    path = tmp_path / "a.mbox"
    path.write_text(TWO)
    located = scan(spark, tmp_path)
    prints = mbox.fingerprints(located)
    value = prints.first()["fingerprint"]
    size, mtime, digest = value.split(":")
    assert int(size) == len(TWO) and int(mtime) > 0 and digest
    second = TWO.index("From b@")
    runs = spark.createDataFrame(
        [(1, "mbox", value, second), (2, "mbox", "other", second), (3, "mbox", value, None),
         (4, "gmail_api", None, None)],
        "run_id long, source string, mbox_fingerprint string, bytes_done long",
    )
    offset = lambda run: mbox.resume_offsets(prints, runs, run).first()["resume_offset"]
    assert [offset(1), offset(2), offset(3)] == [second, 0, 0]
    rest = mbox.resume_from(located, mbox.resume_offsets(prints, runs, 1))
    assert rows(rest, "message_id") == [("<m2@example.com>",)]
    with pytest.raises(ValueError, match="came from gmail_api"):
        offset(4)
    with pytest.raises(ValueError, match="unknown run"):
        offset(9)
    path.write_text(TWO.replace("Alice", "Alicf"))
    assert mbox.fingerprints(scan(spark, tmp_path)).first()["fingerprint"].split(":")[2] != digest


def test_import_batch_and_counts(spark, tmp_path):
    (tmp_path / "a.mbox").write_text(
        SEP_A + "From: A <a@example.com>\nMessage-ID: <m1@x>\n\nx\n"
        + SEP_A + "Return-Path: <b@example.com>\nMessage-ID: <m2@x>\n\n>From y\n"
        + SEP_A + "From: c@example.com\n\nno id\n"
        + SEP_A + "broken\n"
    )
    parsed = scan(spark, tmp_path)
    assert rows(mbox.import_batch(parsed), "mail_id", "rfc_message_id", "sender") == [
        ("mid:<m1@x>", "m1@x", "a@example.com"), ("mid:<m2@x>", "m2@x", "b@example.com"),
    ]
    assert rows(mbox.import_counts(parsed)) == [(3, 2)]


def test_junk_is_a_skipped_region(spark, tmp_path):
    (tmp_path / "a.mbox").write_text("junk line\n" + SEP_A + "From: a@example.com\nMessage-ID: <m1@x>\n\nx\n")
    assert rows(mbox.import_counts(scan(spark, tmp_path))) == [(1, 1)]


def test_fingerprint_covers_the_file_and_no_splits(spark, tmp_path):
    path = tmp_path / "a.mbox"
    text = "".join(f"From x\nMessage-ID: <m{i}@x>\n\n" + "body line\n" * 40 for i in range(600))

    def fingerprint():
        return mbox.fingerprints(scan(spark, tmp_path)).first()["fingerprint"].split(":")[2]

    path.write_text(text)
    whole = fingerprint()
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 16 * 1024)
    try:
        assert fingerprint() == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    path.write_text(text[:200_000] + "B" + text[200_001:])
    assert fingerprint() != whole


def test_long_headers_stay_whole(spark, tmp_path):
    ids = ["i" * 9000 + end for end in "ab"]
    (tmp_path / "a.mbox").write_text("".join(f"From x\nFrom: {'n' * 9000} <a@example.com>\nMessage-ID: <{i}>\n\nx\n" for i in ids))
    assert rows(mbox.import_batch(scan(spark, tmp_path)), "rfc_message_id", "sender") == [(i, "a@example.com") for i in ids]
