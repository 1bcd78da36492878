"""Byte-level BPE through a table of distinct words.

Texts are split into words, in blocks of documents. A block keeps, per document, the numbers of its words, and lists each
distinct word once; only these lists are shuffled by word. There each distinct word is encoded once. The ids come back to
the block, where they are joined by position; the text is decoded by looking up each id's piece in the vocabulary.
Columns of numbers travel as compressed bytes, a row per block and word bucket.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

BLOCK_CHARS = 2_000_000  # characters of text in a block; a longer text is a block of its own
BUCKET_BYTES = 16_000_000  # of text for each bucket of words, so a bucket's size does not grow with the input
LEVEL = 9  # of compression; shuffles are most of the disk that a run needs
ENCODED_AT_ONCE = 4096  # distinct words handed to the library in one call
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def _specials(path: str) -> list[str]:
    """Contents of added tokens, longest first; they are matched in raw text before words are split."""
    return sorted((t.content for t in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[bytes]:
    """The bytes of each id. Pieces are spelled with one printable character per byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = dict(zip(map(chr, plain), plain))
    spelled |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        known = all(c in spelled for c in piece)
        out[i] = bytes(spelled[c] for c in piece) if known else piece.encode()
    return out


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(LEVEL).compress(raw)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: most high bytes are zero."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return _squeeze(planes.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids one after the other, so that repeated runs of them are found; their width in bytes comes first."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([width]) + _squeeze(ids.astype(f"<u{width}").tobytes())


def _unpack_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), f"<u{raw[0]}").astype(np.uint32)


def _pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    """Lengths and bytes of words. Most begin with a blank: it is left out, and the lowest bit of the length tells."""
    blank = [w[:1] == b" " for w in words]
    bare = [w[1:] if b else w for w, b in zip(words, blank)]
    return _pack(np.array([2 * len(w) + b for w, b in zip(bare, blank)], np.uint32)), _squeeze(b"".join(bare))


def _unpack_words(lengths: bytes, joined: bytes) -> list[bytes]:
    raw, sizes = zstandard.ZstdDecompressor().decompress(joined), _unpack(lengths)
    ends, blank = np.cumsum(sizes >> 1, dtype=np.int64).tolist(), (sizes & 1).tolist()
    return [b" " + raw[a:b] if k else raw[a:b] for a, b, k in zip([0, *ends], ends, blank)]


class _Numbering(dict):
    """Numbers new words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_RARE = bytes(range(0xD5))  # no first byte of a character that releases of Unicode differ in


@lru_cache(maxsize=1)
def _newer() -> regex.Pattern:
    """Characters of which one release of Unicode says letter or number and another does not."""
    kinds = regex.compile(r"[\p{L}\p{N}]")
    odd = [c for c in range(0x110000) if bool(kinds.match(chr(c))) != (unicodedata.category(chr(c))[0] in "LN")]
    return regex.compile("[" + "".join(f"\\U{c:08x}" for c in odd) + "]")


def _splitter(path: str) -> Callable[[str], list[str]]:
    find, own = regex.compile(PATTERN).findall, _tokenizer(path).pre_tokenizer

    def words(text: str) -> list[str]:
        if text.encode("utf-8", "surrogatepass").translate(None, _RARE) and _newer().search(text):
            return [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]  # exact whatever its release, but slower
        return find(text)

    specials = _specials(path)
    marked = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None

    def split(text: str) -> list[str]:
        if marked is None or not any(s in text for s in specials):
            return words(text)
        return [w for i, part in enumerate(marked.split(text)) for w in ([part] if i % 2 else words(part))]

    return split


def _blocks(path: str, buckets: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def finish(name: str, ids: list, counts: list[int], codes: list[int], numbering: _Numbering) -> pa.RecordBatch:
        codes, words = np.array(codes, np.int64), np.array([w.encode("utf-8", "surrogatepass") for w in numbering], object)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # frequent words get small numbers
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words = words[order]
        bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
        listed = []
        for b in np.unique(bucket).tolist():
            own = words[bucket == b].tolist()
            listed.append((b, *_pack_words(own)))
        total = zlib.crc32(b"".join(lengths + joined for _, lengths, joined in listed))  # a rerun with other rows gets another name
        kind = pa.list_(pa.struct([("bucket", pa.int64()), ("lengths", pa.binary()), ("joined", pa.binary())]))
        return pa.RecordBatch.from_arrays([
            pa.array([f"{name}-{total:08x}"]), pa.array([ids], pa.list_(id_type)), pa.array([_pack(np.array(counts))], pa.binary()),
            pa.array([_pack(place[codes])], pa.binary()), pa.array([_pack(bucket)], pa.binary()),
            pa.array([[dict(zip(("bucket", "lengths", "joined"), x)) for x in listed]], kind),
        ], names=["block", "ids", "counts", "codes", "buckets", "words"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part, done = _splitter(path), TaskContext.get().partitionId(), 0
        ids, counts, codes, numbering, chars = [], [], [], _Numbering(), 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                found = split(text.as_py() or "")
                ids.append(key.as_py())
                counts.append(len(found))
                codes.extend(map(numbering.__getitem__, found))
                chars += sum(map(len, found))
                if chars >= BLOCK_CHARS:
                    yield finish(f"{part}-{done}", ids, counts, codes, numbering)
                    done += 1
                    ids, counts, codes, numbering, chars = [], [], [], _Numbering(), 0
        if ids:
            yield finish(f"{part}-{done}", ids, counts, codes, numbering)

    return blocks


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, words in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
            yield pa.RecordBatch.from_arrays([
                pa.array([w["bucket"] for w in words], pa.int64()), pa.array([block] * len(words), pa.string()),
                pa.array([w["lengths"] for w in words], pa.binary()), pa.array([w["joined"] for w in words], pa.binary()),
            ], names=["bucket", "block", "lengths", "joined"])


def _encode(path: str) -> Callable[[pa.Table], pa.Table]:
    def encode(listed: pa.Table) -> pa.Table:
        """All lists of one bucket: each distinct word is encoded once, each list gets its ids."""
        lists = [_unpack_words(a, b) for a, b in zip(listed.column("lengths").to_pylist(), listed.column("joined").to_pylist())]
        distinct = list(dict.fromkeys(w for words in lists for w in words))
        ids_of, tokenizer = {}, _tokenizer(path)
        for start in range(0, len(distinct), ENCODED_AT_ONCE):  # the library's result for a word is some hundred times its size
            part = distinct[start:start + ENCODED_AT_ONCE]
            found = tokenizer.encode_batch([w.decode("utf-8", "surrogatepass") for w in part], add_special_tokens=False)
            ids_of.update(zip(part, (e.ids for e in found)))
        counts, flat = [], []
        for words in lists:
            found = [ids_of[w] for w in words]
            counts.append(_pack(np.array([len(x) for x in found], np.uint32)))
            flat.append(_pack_ids(np.array([i for x in found for i in x], np.uint32)))
        return pa.table({"block": listed.column("block"), "bucket": listed.column("bucket"),
                         "counts": pa.array(counts, pa.binary()), "flat": pa.array(flat, pa.binary())})

    return encode


def _assemble(path: str, id_col: str, id_type: pa.DataType, with_ids: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def assemble(blocks: pa.Table, encoded: pa.Table) -> pa.Table:
        pieces, parts = _pieces(path), []
        for block in blocks.to_pylist():  # one
            counts, codes, buckets = (_unpack(block[k]).astype(np.int64) for k in ("counts", "codes", "buckets"))
            size, start = np.zeros(len(buckets), np.int64), np.zeros(len(buckets), np.int64)
            chunks, at = [], 0
            for row in encoded.select(["bucket", "counts", "flat"]).to_pylist():
                own = np.flatnonzero(buckets == row["bucket"])
                sizes, flat = _unpack(row["counts"]).astype(np.int64), _unpack_ids(row["flat"])
                if len(own) != len(sizes):
                    raise RuntimeError(f"block {block['block']} and its word list differ; the input changed between reads")
                size[own], start[own] = sizes, at + np.cumsum(sizes) - sizes
                chunks.append(flat)
                at += len(flat)
            ids = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
            if (size == 0).any():
                raise RuntimeError(f"words of block {block['block']} have no ids; the input changed between reads")
            word_ids = [ids[a:a + n].tolist() for a, n in zip(start.tolist(), size.tolist())]
            spelled = [",".join(map(str, x)).encode() for x in word_ids]
            decoded = [b"".join([pieces[i] for i in x]) for x in word_ids]
            ends = np.cumsum(counts).tolist()
            n_tokens, id_hash, text_hash = [], [], []
            for a, b in zip([0, *ends], ends):
                own = codes[a:b]
                places = own.tolist()
                n_tokens.append(int(size[own].sum()))
                id_hash.append(hashlib.sha256(b",".join([spelled[c] for c in places])).hexdigest())
                text = b"".join([decoded[c] for c in places]).decode("utf-8", "replace")
                text_hash.append(hashlib.sha256(text.encode()).hexdigest())
            columns = {id_col: pa.array(block["ids"], id_type), "n_tokens": pa.array(n_tokens, pa.int64()),
                       "ids_sha256": pa.array(id_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
            if with_ids:
                sizes = size[codes]
                before = np.cumsum(sizes) - sizes
                flat = ids[np.repeat(start[codes] - before, sizes) + np.arange(sizes.sum())].astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(n_tokens)]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            parts.append(pa.table(columns))
        return pa.concat_tables(parts) if parts else pa.table({f.name: pa.array([], f.type) for f in _shape(id_col, id_type, with_ids)})

    return assemble


def _shape(id_col: str, id_type: pa.DataType, with_ids: bool) -> pa.Schema:
    fields = [(id_col, id_type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """A row per input row: id_col, n_tokens, SHA-256 of the ids and of the decoded text, and the ids if asked for.

    Null text counts as empty: no tokens. Repeated rows and null ids give a row each. An empty table gives no rows. Other
    columns are not read. docs should give the same rows in the same order when a task is run again, as scans of files do;
    if it does not, the job fails rather than mixing up words.
    """
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

    path = path or default_tokenizer()
    picked = docs.select(id_col, text_col)
    size = picked.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    id_type = to_arrow_type(picked.schema[id_col].dataType)
    listed = T.StructType.fromDDL("bucket long, lengths binary, joined binary")
    shape = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(picked.schema[id_col].dataType)),
        T.StructField("counts", T.BinaryType()), T.StructField("codes", T.BinaryType()),
        T.StructField("buckets", T.BinaryType()), T.StructField("words", T.ArrayType(listed))])
    blocks = picked.mapInArrow(_blocks(path, buckets, id_type), shape).repartition("block")
    encoded = blocks.mapInArrow(_listed, "bucket long, block string, lengths binary, joined binary") \
        .groupBy("bucket").applyInArrow(_encode(path), "block string, bucket long, counts binary, flat binary")
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")) \
        .applyInArrow(_assemble(path, id_col, id_type, with_ids), from_arrow_schema(_shape(id_col, id_type, with_ids)))
