"""Prefix tables against the tokenizer library, whole and after edits."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from sparkmail.llm import prefix_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
ALPHABET = [*"aab'stremvldll   \n\t\r　.,!59é漢字ß😀²Ⅷ٣​́'’<|>", "  ", "'ll", "'re", " the", "\n\n", "\x00", "􏿿"]


@pytest.fixture(scope="module")
def known():
    return prefix_bpe.vocabulary(prefix_bpe.default_ranks())


@pytest.fixture(scope="module")
def library():
    with open(prefix_bpe.default_ranks(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def text(rng, most):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


def numbers(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_pattern():
    assert prefix_bpe.PATTERN == public_tokenizers.PATTERN


def test_texts(known, library):
    rng = random.Random(1)
    texts = [text(rng, 40) for _ in range(4000)] + ["", None, "a" * 3000, " " * 3000, "\n" * 500, "ab " * 900, "=" * 777, "'s's'ly"]
    texts += ["".join(rng.choice("abcdefghth") for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    found = prefix_bpe.encode_texts(known, pa.array(texts, pa.string())).to_pylist()
    assert [numbers(x) for x in found] == [library.encode_ordinary(t or "") for t in texts]


def test_every_prefix_has_its_encoding(known, library):
    """The table of a word holds the encodings of all its prefixes."""
    rng = random.Random(2)
    for _ in range(60):
        word = "".join(rng.choice("abcdehilnorst") for _ in range(40)).encode()
        last = []
        known.extend(word, last)
        for end in range(1, len(word) + 1):
            assert known.walk(word[:end], last[:end]) == library.encode_ordinary(word[:end].decode())


def test_long_and_short_words_agree(known, monkeypatch):
    words = list({w.encode() for w in text(random.Random(3), 4000).split()})
    short = known.words(words)
    monkeypatch.setattr(prefix_bpe, "SHORT", 0)
    known._words.clear()
    assert known.words(words) == short


def test_edits(known, library):
    rng = random.Random(4)
    for k in range(400):
        table = prefix_bpe.PrefixTable(known, (text(rng, 60) if k % 2 else "".join(rng.choices("abcde", k=500))).encode())
        for _ in range(4):
            now = table.text.decode()
            a = rng.randint(0, len(now))
            b = rng.randint(a, min(len(now), a + 8))
            if rng.random() < 0.3:
                a = b = len(now)
            new = text(rng, 6)
            table.replace(len(now[:a].encode()), len(now[:b].encode()), new.encode())
            now = now[:a] + new + now[b:]
            fresh = prefix_bpe.PrefixTable(known, now.encode())
            assert table.text == now.encode() and table.ids() == library.encode_ordinary(now)
            assert (table.ends == fresh.ends).all() and (table.last == fresh.last).all()


def test_only_entries_near_an_edit_are_found(known):
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh") for _ in range(60_000)).encode()
    prose = ("The quick brown fox, isn't it? " * 3000).encode()
    for whole in (line, prose):
        table = prefix_bpe.PrefixTable(known, whole)
        assert len(table.last) == len(whole)
        assert table.replace(30_000, 30_003, b"xyz") < 1000
        assert table.append(b"more") < 1000


SCHEMA = "doc_id long, text string, ids string, decoded string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def test_encode_and_decode(spark, library, monkeypatch):
    rng = random.Random(6)
    rows = [(i, text(rng, 300)) for i in range(200)] + [(None, "no id"), (7, "again"), (7, "again"), (1000, None), (1001, ""),
                                                       (1002, "word " * 200_000), (1003, "<|endoftext|>")]
    found = prefix_bpe.decode(prefix_bpe.encode(docs(spark, rows))).collect()
    expected = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert sorted([(r[0], numbers(r["ids"]), bytes(r["decoded"])) for r in found], key=repr) == sorted(expected, key=repr)
    assert prefix_bpe.decode(prefix_bpe.encode(docs(spark, []))).collect() == []


def test_revise(spark, library):
    rows = [(1, "Hello wor"), (2, "naïve café 漢字"), (3, None), (4, "no edit"), (None, "no id")]
    tables = prefix_bpe.prefix_tables(docs(spark, rows))
    assert tables.count() == 5
    edits = [(1, None, None, "ld!"), (2, 2, 5, "IVE"), (2, 99, None, " end"), (3, None, None, "new"), (9, 0, 1, "none"),
             (4, 0, 3, None), (None, 0, 0, "x")]
    found = prefix_bpe.revise(tables, spark.createDataFrame(edits, "doc_id long, start int, stop int, addition string")).collect()
    expected = ["Hello world!", "naIVE café 漢字", "naïve café 漢字 end", "new", "edit"]
    assert sorted((r["doc_id"], bytes(r["text"]).decode(), numbers(r["ids"])) for r in found) \
        == sorted((i, t, library.encode_ordinary(t)) for i, t in zip([1, 2, 2, 3, 4], expected))
