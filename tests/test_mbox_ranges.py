"""Byte ranges of archives: framing against a line-by-line model, refusal, plans."""

import gzip
import io
import random
import time

import pytest

from conftest import rows
from sparkmail.sources import mbox, mbox_ranges
from sparkmail.sources.mbox_ranges import Archive, Range


def plain(data):
    """(offset, section) of each message, line by line."""
    out, at, inside = [], 0, False
    for line in data.splitlines(keepends=True) if b"\r" not in data else io.BytesIO(data).readlines():
        if line.startswith(b"From "):
            out.append((at, line[5:]))
            inside = True
        elif inside and line in (b"\n", b"\r\n"):
            inside = False
        elif inside:
            out[-1] = (out[-1][0], out[-1][1] + line)
        at += len(line)
    return out


def random_archive(rng):
    pieces = [b"From a\n", b"From ", b"\nFrom b\n", b"X: y\n", b" fold\n", b"\n", b"\r\n", b">From c\n", b"From: a@x.com\n", b"body " * 5,
              b"Message-ID: <1@x>\n", b"Fro", b"m ", b"\xff\xfe\n", b"no newline"]
    return b"From first\n" + b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))


@pytest.mark.parametrize("chunk", [1, 3, 7, 4 << 20])
def test_ranges_of_any_cut_give_each_message_once(monkeypatch, chunk):
    monkeypatch.setattr(mbox_ranges, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(150):
        data = random_archive(rng)
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randint(0, 5)))})
        found = [m for a, b in zip(cuts, cuts[1:]) for m in mbox_ranges.messages(io.BytesIO(data), a, b)]
        assert [(o, s.rstrip(b"\r\n")) for o, s, _ in found] == [(o, s.rstrip(b"\r\n")) for o, s in plain(data)]
        assert not any(cut for _, _, cut in found)


class Counting(io.BytesIO):
    """A file that knows how much of it was asked for."""

    asked = 0

    def read(self, n=-1):
        self.asked += n
        return super().read(n)


def test_bodies_are_not_held(monkeypatch):
    monkeypatch.setattr(mbox_ranges, "CHUNK", 1000)
    sizes = []
    more = mbox_ranges._Window.more
    monkeypatch.setattr(mbox_ranges._Window, "more", lambda w, keep: (more(w, keep), sizes.append(len(w.data)))[0])
    data = b"From a\nFrom: a@x\n\n" + b"long body " * 100_000 + b"\nFrom b\nX: y\n\n" + b"z" * 500_000
    assert [o for o, _, _ in mbox_ranges.messages(io.BytesIO(data), 0, len(data))] == [0, 1_000_019]
    assert max(sizes) < 3000
    monkeypatch.setattr(mbox_ranges, "HEAD_BYTES", 5000)
    cut = list(mbox_ranges.messages(io.BytesIO(b"From a\n" + b"x" * 100_000 + b"\nFrom b\n"), 0, 200_000))
    assert [(o, len(s), long) for o, s, long in cut] == [(0, 5000, True), (100_008, 2, False)] and max(sizes) < 8000


def test_a_range_reads_little_beyond_its_end():
    data = b"From a\nX: y\n\n" + b"b" * 50_000_000
    stream = Counting(data)
    assert [o for o, _, _ in mbox_ranges.messages(stream, 0, 100)] == [0]
    assert stream.asked <= 2 * mbox_ranges.CHUNK


@pytest.mark.parametrize("blank", [b"\n", b"\r\n", b""])
def test_many_small_messages_cost_no_more_each_than_few(blank):
    """A look for the end of a header section stops there, also if one kind of blank line is nowhere in the file."""
    data = b"".join(b"From a\nX: header of message %06d\n" % i + blank for i in range(60_000))
    start = time.process_time()
    found = list(mbox_ranges.messages(io.BytesIO(data), 0, len(data)))
    assert time.process_time() - start < 5
    assert len(found) == 60_000 and all(b"%06d" % i in head for i, (_, head, _) in enumerate(found))


def test_files_are_refused_before_they_are_read(tmp_path):
    (tmp_path / "a.mbox").write_bytes(b"From a\n\nbody")
    (tmp_path / "b.mbox.gz").write_bytes(gzip.compress(b"From a\n\nbody"))
    with open(tmp_path / "c.bin", "wb") as f:
        f.truncate(1 << 30)  # a gigabyte without a line
    (tmp_path / "d.mbox").write_bytes(gzip.compress(b"From a\n\nbody"))
    (tmp_path / "e.mbox").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"From a\n")
    (tmp_path / "f.GZ").write_bytes(b"From a\n")
    found = mbox_ranges.archives(str(tmp_path))
    assert [(a.file.rsplit("/", 1)[1], a.refused) for a in found] == [
        ("a.mbox", None), ("b.mbox.gz", "compressed"), ("c.bin", "no separator"), ("d.mbox", "no separator"), ("f.GZ", "compressed")]
    size, _, digest = found[0].fingerprint.split(":")
    assert size == "12" and len(digest) == 16
    assert mbox_ranges.archives(f"file://{tmp_path}/a.mbox")[0].fingerprint == found[0].fingerprint
    with pytest.raises(FileNotFoundError):
        mbox_ranges.archives(str(tmp_path / "none"))


def test_plan():
    found = [Archive("a", 100, 0, "fa", None), Archive("b", 30, 0, "fb", None), Archive("c", 50, 0, "fc", None)]
    done = {"a": ("fa", 70), "b": ("other", 20), "c": ("fc", 50)}
    assert mbox_ranges.plan_batches(found, done, 40) == [[Range("a", 70, 100), Range("b", 0, 10)], [Range("b", 10, 30)]]
    assert mbox_ranges.plan_batches(found, {}, 1000, max_files=2) == [
        [Range("a", 0, 100), Range("b", 0, 30)], [Range("c", 0, 50)]]
    assert mbox_ranges.plan_batches(found, {x.file: (x.fingerprint, x.size) for x in found}, 10) == []


def test_spark_reads_what_the_text_scan_reads(spark, tmp_path):
    rng = random.Random(9)
    for i in range(6):
        (tmp_path / f"{i}.mbox").write_bytes(random_archive(rng))
    found = mbox_ranges.archives(str(tmp_path))
    ranges = [Range(a.file, 0, a.size) for a in found]
    parsed = mbox.with_offsets(mbox.parse_records(mbox.read_mbox(spark, str(tmp_path))))
    columns = ["start_offset", "bad", "message_id", "from_", "return_path"]
    name = lambda df: df.selectExpr("substring_index(file, '/', -1) AS name", *columns)
    expected = rows(name(parsed))
    assert expected and rows(name(mbox_ranges.read_ranges(spark, ranges))) == expected
    assert rows(name(mbox_ranges.read_ranges(spark, ranges, tile=11))) == expected
    assert mbox_ranges.read_ranges(spark, []).count() == 0
