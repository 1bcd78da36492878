"""Archives: exact round trips, dictionary, revisits."""

import base64
import glob
import hashlib
import random
import struct

import pytest
import zstandard

from sparkmail.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, id string, sha string, place string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def plain(rows, least=0):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == raw and r[0] is not None]
        first = min(same, default=None)
        again = len(raw) >= least and page_id != first
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "revisit" if again else "response", first if again else None))
    return out


def result(spark, path):
    rows = warc.read(spark, path).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return [(r[0] and int(r[0]), *r[1:4], r[4] and int(r[4])) for r in rows]


def some(n, seed=1):
    rng = random.Random(seed)
    words = "<p>alpha</p> <b>beta</b> ü 中文 gamma".split()
    bodies = ["<html>" + " ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(n // 2)]
    return [(i * 3 % 1009, f"http://x/{i}", rng.choice(bodies)) for i in range(n)]


@pytest.mark.parametrize("least, files", [(0, 5000), (300, 7)])
def test_round_trip(spark, tmp_path, least, files):
    rows = some(400) + [(5001, None, None), (5002, "http://a\r\nb c", ""), (5003, "u", "x" * 3_000_000), (None, "n", "only"),
                        (5004, "u", "\r\n\r\nContent-Length: 9\r\n\r\n"), (5005, "u", "\x00퟿")]
    path = str(tmp_path / "w")
    warc.write(pages(spark, rows), path, least=least, records_per_file=files)
    assert sorted(result(spark, path), key=repr) == sorted(plain(rows, least), key=repr)
    payloads = {r["id"]: bytes(r["payload"]) for r in warc.read(spark, path, payloads=True).collect() if r["payload"] is not None}
    html = {str(i): (h or "").encode() for i, _, h in rows if i is not None}
    assert all(html[k] == v for k, v in payloads.items() if k is not None)


def test_repeated_rows(spark, tmp_path):
    rows = [(7, "u", "same"), (7, "u", "same"), (9, "u", "same"), (8, "u", "other")]
    path = str(tmp_path / "w")
    warc.write(pages(spark, rows), path)
    found = sorted((r[0], r[3], r[4]) for r in result(spark, path))
    assert found == [(7, "response", None), (7, "revisit", 7), (8, "response", None), (9, "revisit", 7)]


def test_each_file_leads_with_its_dictionary(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark, some(300)).coalesce(1), path, records_per_file=100)
    found = [open(f, "rb").read() for f in glob.glob(path + "/part-*")]
    assert sum(map(len, found)) and len(found) >= 3
    for raw in found:
        magic, size = struct.unpack_from("<II", raw)
        assert magic == warc.DICTIONARY_MAGIC
        known = zstandard.ZstdCompressionDict(raw[8:8 + size])
        records = list(warc.frames_of(raw))
        assert 1 <= len(records) <= 100 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
        # a plain reader that knows the dictionary gets the same bytes, and passes over the empty frames
        with zstandard.ZstdDecompressor(dict_data=known).stream_reader(raw, read_across_frames=True) as reader:
            assert reader.read() == b"".join(records)


def test_damage_is_told(spark):
    raw = warc.record(1, "u", b"payload", warc._digest(b"payload"))
    assert warc.parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r\n", b"paYload\r\n"))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(pages(spark, []), path)
    assert warc.read(spark, path).collect() == []
