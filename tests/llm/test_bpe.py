"""Encoding against the tokenizers library, and decoding back to the text."""

import hashlib
import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from sparkmail.llm import bpe  # noqa: E402

SCHEMA = "doc_id long, text string, block string, ids string, counts string"

TEXTS = [
    None, "", " ", "\n\n", "a", "Hello world, it's we'll  go\t\tnow \n", "<|endoftext|>", "x<|endoftext|><|endoftext|> y",
    "<|endoftext", "straße ÉÉ 中文 ½Ⅷ 🙂 a‍b é", "   x\u0085y", "\x00\x01\x7f", "tail   ", "DON'T don't 'S 's",
    "՘ ֋႔0౜ new letters\U00010940", "12345678901234567890", "�", "a" * 5000,
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


def plain(texts):
    tokenizer = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    out = []
    for text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert back == (text or "")
        out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(back.encode()).hexdigest(), ids))
    return out


@pytest.mark.parametrize("block", [30, bpe.BLOCK_CHARS])
def test_encode(spark, monkeypatch, block):
    rng = random.Random(4)
    alphabet = "ab cé's \n\t.,1½中🙂<|endoftext|>"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(150)]
    texts += [" ".join(f"word{i % 777}" for i in range(30_000))]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "no id"), (None, None)]
    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    found = bpe.encode(docs(spark, rows).repartition(3), with_ids=True).collect()
    expected = [(i, *p) for (i, _), p in zip(rows, plain([t for _, t in rows]))]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_empty_table(spark):
    assert bpe.encode(docs(spark, [])).collect() == []


def test_words_split_as_the_tokenizer_splits():
    own = tokenizers.Tokenizer.from_file(bpe.default_tokenizer()).pre_tokenizer
    split, rng = bpe._splitter(bpe.default_tokenizer()), random.Random(9)
    for start in range(0, 0x30000, 97):
        text = "".join(f"a{c}1{c} {c}'s" for c in map(chr, range(start, start + 97)) if not "\ud800" <= c <= "\udfff")
        assert split(text) == [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)], hex(start)
    for _ in range(2000):
        text = "".join(rng.choices("ab1 '\n\t  st.é½\r", k=12))
        assert split(text) == [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]


def test_what_is_shuffled_comes_back_and_stays_small():
    rng = random.Random(3)
    words = sorted({" " + "".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 8))) for _ in range(3000)}, key=lambda w: rng.random())
    words = [w.encode() for w in [*words, "", " ", "  ", "\n", "中", "a b", "\x00"]]
    lengths, joined = bpe._pack_words(words)
    assert bpe._unpack_words(lengths, joined) == words and bpe._unpack_words(*bpe._pack_words([])) == []
    whole = bpe.zstandard.ZstdCompressor(3).compress(b"".join(words)), bpe._pack(np.array([len(w) for w in words]))
    assert len(lengths) + len(joined) < 0.95 * sum(map(len, whole))
    tokenizer = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    ids = np.array([i for w in words for i in tokenizer.encode(w.decode(), add_special_tokens=False).ids], np.uint32)
    assert bpe._unpack_ids(bpe._pack_ids(ids)).tolist() == ids.tolist() and len(bpe._pack_ids(ids)) < 0.95 * len(bpe._pack(ids))
    for some in ([], [65535], [65536, 7]):
        assert bpe._unpack_ids(bpe._pack_ids(np.array(some, np.uint32))).tolist() == some
