"""Byte-level BPE by dynamic programming over byte prefixes.

Every byte prefix of a word has one encoding, so it has one last token; that of a prefix is the only token at its end that
fits behind the last token of the shorter prefix before it. The tokens found this way, a table of one number per byte, hold
the encodings of all prefixes: walking back from the end of a word gives its ids. A table goes on exactly where it ended when
text is appended, and after an edit only the entries near the edit are found again.

Words are found by the splitting pattern, worked out for many texts at once on arrays of character classes; each distinct
word of a slice of texts is encoded once. Ids travel as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmail.llm.common import slices, texts_of

# Fixed value: the pattern that split_words() works out.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE_BYTES = 1 << 21  # of text that are split together; a longer text is a slice of its own
SHORT = 48  # bytes of a word up to which words are encoded together and remembered
MEMO_WORDS, MEMO_PAIRS, SLOTS = 1 << 19, 1 << 20, 1 << 21  # what a worker remembers at most
NO_RANK = 1 << 32
LOOK_AHEAD = 3  # characters from a word's start that the pattern looks at even if the word is shorter
OTHER, LETTER, NUMBER, SPACE = range(4)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point, as the pattern's own engine sees it."""
    single = {bytes([b]): b for b in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = kind
    return table


def split_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte starts of the words of the texts data[offsets[i]:offsets[i + 1]], valid UTF-8 all together.

    Words are runs of one class. A run takes along the space character before it, white space before another run leaves its
    last character to it, and an apostrophe not taken along by a space begins a contraction if the letters behind it allow.
    """
    code = np.frombuffer(bytes(data).decode().encode("utf-32-le"), "<u4")
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the byte where each character begins
    if not len(code):
        return at
    kind = _classes()[code]
    first = np.zeros(len(code) + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    begin = first[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begin)
    of, end = kind[run], np.append(run[1:], len(code))
    space, size, alone = of == SPACE, end - run, first[run]
    joined = ~first[end]  # the next run belongs to the same text
    after_space = np.zeros(len(run), bool)
    after_space[1:] = space[:-1] & ~alone[1:] & (code[run[1:] - 1] == 32)
    starts = space | ~after_space
    mark = np.zeros(len(code) + 1, bool)
    mark[run[starts]] = True
    mark[end[space & joined & (size > 1)] - 1] = True
    quote = np.flatnonzero((code[run] == 39) & (size == 1) & starts & joined)
    quote = quote[of[quote + 1] == LETTER]
    one = code[run[quote] + 1]
    two = np.where(size[quote + 1] > 1, code[np.minimum(run[quote] + 2, len(code) - 1)], 0)
    letters = np.isin(one, [*map(ord, "stmd")]).astype(np.int64)
    for pair in ("re", "ve", "ll"):
        letters[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
    quote, letters = quote[letters > 0], letters[letters > 0]
    mark[run[quote] + 1] = False
    rest = letters < size[quote + 1]
    mark[(run[quote] + 1 + letters)[rest]] = True
    return at[np.flatnonzero(mark[:-1])]


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """The tokens of a file of ranks, and which of them may follow each other."""

    def __init__(self, path: str):
        self.ranks = _ranks(path)
        self.pieces = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.ends = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.sizes = {rank: len(token) for rank, token in self.pieces.items()}
        self.size_of = np.zeros(max(self.pieces) + 1, np.int64)
        self.size_of[list(self.sizes)] = list(self.sizes.values())
        tree, ends = {}, {}  # (node, byte) -> node, and the token that ends at a node
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                node = tree.setdefault(node << 8 | byte, len(tree) + 1)
            ends[node] = rank
        self.tree_keys, order = np.unique(np.fromiter(tree, np.int64, len(tree)), return_index=True)
        self.tree_nodes = np.fromiter(tree.values(), np.int64, len(tree))[order]
        self.token_at = np.full(len(tree) + 1, -1, np.int64)
        self.token_at[list(ends)] = list(ends.values())
        self._slot_keys, self._slot_fits = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self._fits: dict[int, bool] = {}
        self._words: dict[bytes, bytes] = {}

    def merged(self, raw: bytes) -> list[bytes]:
        """A few bytes merged in the order of ranks, the leftmost of equals first."""
        rank = self.ranks.get
        parts = [raw[i:i + 1] for i in range(len(raw))]
        pairs = [rank(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == NO_RANK:
                break
            i = pairs.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NO_RANK)
        return parts

    def fits(self, before: int, token: int) -> bool:
        """Whether merging leaves the bytes of two tokens as these tokens. -1 stands for the start of a word."""
        if len(self._fits) >= MEMO_PAIRS:
            self._fits.clear()
        pieces = [self.pieces[t] for t in (before, token) if t >= 0]
        known = self._fits[before << 32 | token] = self.merged(b"".join(pieces)) == pieces
        return known

    def extend(self, word: bytes, last: list[int], same: list[int] | None = None) -> int:
        """Add the last tokens of the longer prefixes of `word` to `last`; returns how many had to be found.

        `same` gives tokens that an earlier table has for the final bytes of the word. An entry depends on as many entries
        before it as the longest token has bytes, so once that many agree, the others are taken over.
        """
        known, have, agree = len(last), len(last), 0
        origin = max(0, known - self.longest)
        shift = len(word) - len(same) if same else len(word)
        fits = self._fits.get
        for end, (token, size) in self.ends.iter(word[origin:].decode("latin-1")):
            end += origin
            if end != have:
                if end < have:
                    continue
                break
            before = last[end - size] if size <= end else -1
            fit = fits(before << 32 | token)
            if fit or fit is None and self.fits(before, token):
                last.append(token)
                have += 1
                if end >= shift:
                    agree = agree + 1 if same[end - shift] == token else 0
                    if agree == self.longest:
                        last.extend(same[end + 1 - shift:])
                        return have - known
        if have < len(word):
            raise ValueError(f"no token for byte {word[have]}")
        return have - known

    def walk(self, word: bytes, last: list[int]) -> list[int]:
        """The ids of a word: its last token, the last token of what is before that, and so on."""
        whole = self.ranks.get(word)
        if whole is not None:  # a word that is a token is that token, though merging may not lead there
            return [whole]
        ids, at, sizes = [], len(last), self.sizes
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return ids

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, packed."""
        if len(self._words) + len(words) > MEMO_WORDS:
            self._words.clear()
        memo, made = self._words, {}
        new = [w for w in words if w not in memo]
        short = sorted((w for w in new if len(w) <= SHORT), key=len, reverse=True)
        if short:
            memo.update(zip(short, self._together(short)))
        for word in new:
            if len(word) > SHORT:
                last: list[int] = []
                self.extend(word, last)
                made[word] = _pack(self.walk(word, last))
        return [memo[w] if w in memo else made[w] for w in words]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """The ids of many short words, the longest first: their tables are filled together, a byte of all words at a time.

        For each start in a word the walk through the tokens goes on by that byte, as long as some token begins like this.
        """
        sizes = np.array([len(w) for w in words])
        longest, n = int(sizes[0]), len(words)
        bytes_ = np.zeros((n, longest), np.uint8)
        bytes_[np.arange(longest) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        bytes_ = np.ascontiguousarray(bytes_.T)
        last, whole = np.full((longest, n), -1, np.int64), np.full(n, -1, np.int64)
        walks: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(longest):
            count = int(np.searchsorted(-sizes, -i))  # words longer than i
            walks.append((np.arange(count), np.zeros(count, np.int64)))
            for b, (rows, node) in enumerate(walks):
                if not len(rows):
                    continue
                if rows[-1] >= count:
                    inside = int(np.searchsorted(rows, count))
                    rows, node = rows[:inside], node[:inside]
                node = self._step(node, bytes_[i, rows])
                on = node >= 0
                rows, node = rows[on], node[on]
                walks[b] = rows, node
                token = self.token_at[node]
                if b == 0:
                    ends = (token >= 0) & (sizes[rows] == i + 1)
                    whole[rows[ends]] = token[ends]
                asked = (token >= 0) & (last[i, rows] < 0)
                rows, token = rows[asked], token[asked]
                fit = self._fit_all(last[b - 1, rows] if b else np.full(len(rows), -1), token)
                last[i, rows[fit]] = token[fit]
            if (last[i, :count] < 0).any():
                raise ValueError(f"no token for byte {bytes_[i, int(last[i, :count].argmin())]}")
        ids, steps = np.zeros((longest, n), "<u4"), np.zeros(n, np.int64)
        rows, at = np.arange(n), sizes.copy()
        for step in range(longest):
            token = last[at[rows] - 1, rows]
            token = np.where(whole[rows] >= 0, whole[rows], token)
            ids[step, rows] = token
            steps[rows] += 1
            at[rows] -= self.size_of[token]
            rows = rows[at[rows] > 0]
            if not len(rows):
                break
        ends = np.cumsum(steps)
        row = np.repeat(np.arange(n), steps)
        flat = ids[ends[row] - 1 - np.arange(len(row)), row].tobytes()
        cuts = (4 * ends).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that bytes lead to in the tree of the tokens, -1 where no token goes on like this."""
        key = node << 8 | byte
        place = np.minimum(np.searchsorted(self.tree_keys, key), len(self.tree_keys) - 1)
        return np.where(self.tree_keys[place] == key, self.tree_nodes[place], -1)

    def _fit_all(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """fits() of many pairs, remembered in slots by a hash of the pair."""
        key = (before + 1) << 32 | token
        slot = (key * 0x9E3779B97F4A7C1 >> 20) & (SLOTS - 1)
        odd = np.flatnonzero(self._slot_keys[slot] != key)
        if len(odd):
            pairs, back = np.unique(key[odd], return_inverse=True)
            known = [self._fits.get((k >> 32) - 1 << 32 | k & 0xFFFFFFFF) for k in pairs.tolist()]
            known = [self.fits((k >> 32) - 1, k & 0xFFFFFFFF) if x is None else x for k, x in zip(pairs.tolist(), known)]
            out = self._slot_fits[slot]
            out[odd] = np.array(known)[back]
            self._slot_keys[slot[odd]] = key[odd]
            self._slot_fits[slot[odd]] = out[odd]
            return out
        return self._slot_fits[slot]


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if len(ids) > 16 else b"".join([i.to_bytes(4, "little") for i in ids])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _pieces(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(path).items()}


def _settled(begins: np.ndarray, ends: np.ndarray, place: int) -> int:
    """How many words were found without looking at bytes from `place` on. A word of white space looks at the character
    behind its run, and the run's last one belongs to the next word; so the last word that ends early enough is left out."""
    return max(0, int(np.count_nonzero((ends < place) & (begins + LOOK_AHEAD <= place))) - 1)


class PrefixTable:
    """One text with its words and the last token of each prefix of a word."""

    def __init__(self, known: Vocabulary, text: bytes = b"", ends: np.ndarray | None = None, last: np.ndarray | None = None):
        self.known, self.text, self.ends, self.last = known, b"", np.zeros(0, np.int64), np.zeros(0, np.uint32)
        if ends is None:
            self.replace(0, 0, text)
        else:
            self.text, self.ends, self.last = text, ends.astype(np.int64), last

    def append(self, text: bytes) -> int:
        return self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, text: bytes) -> int:
        """Put `text` in place of the bytes from start to stop (bounds of characters); returns the table entries found.

        Words that the pattern found without looking at a changed byte stay. From there on words are found again, in growing
        windows, until one begins where a word began before; what follows stays as well.
        """
        changed = self.text[:start] + text + self.text[stop:]
        shift, tail = len(changed) - len(self.text), start + len(text)
        begins = np.append(0, self.ends[:-1])[:len(self.ends)]
        keep = _settled(begins, self.ends, start)
        origin = int(self.ends[keep - 1]) if keep else 0
        old_begins = begins[begins >= stop] + shift  # in places of the changed text
        window = max(256, 2 * (tail - origin))
        while True:
            part = changed[origin:origin + window]
            while origin + len(part) < len(changed) and changed[origin + len(part)] & 0xC0 == 0x80:
                part = changed[origin:origin + len(part) + 1]
            found = origin + split_words(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
            over = origin + len(part) == len(changed)
            if not over:  # the last words may have seen the end of the window
                found = found[:_settled(found, np.append(found[1:], origin + len(part)), origin + len(part)) + 1]
            meet = found[(found >= tail) & np.isin(found, old_begins)]
            if len(meet) or over:
                break
            window *= 4
        stop_new = int(meet[0]) if len(meet) else len(changed)
        bounds = [*found[found < stop_new].tolist(), stop_new]
        last, work = [], 0
        first_end = min(start, int(self.ends[keep])) if keep < len(self.ends) else start
        for a, b in zip(bounds, bounds[1:]):
            entries = self.last[a:min(b, first_end)].tolist() if a == origin else []  # the word begins as it did
            place = int(np.searchsorted(self.ends, b - shift)) if b >= tail else len(self.ends)
            same = None
            if place < len(self.ends) and self.ends[place] == b - shift:  # and ends as one did
                same = self.last[max(int(begins[place]), stop, a - shift):b - shift].tolist()
            work += self.known.extend(changed[a:b], entries, same)
            last += entries
        kept = np.count_nonzero(begins >= stop_new - shift) if stop_new < len(changed) else 0
        rest = len(self.ends) - kept
        self.last = np.concatenate([self.last[:origin], np.array(last, np.uint32),
                                    self.last[stop_new - shift:] if kept else self.last[:0]])
        self.ends = np.concatenate([self.ends[:keep], np.array(bounds[1:], np.int64)[:len(bounds) - 1],
                                    self.ends[rest:] + shift])
        self.text = changed
        return work

    def ids(self) -> list[int]:
        out, start = [], 0
        for end in self.ends.tolist():
            out += self.known.walk(self.text[start:end], self.last[start:end].tolist())
            start = end
        return out


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes that end at the given places of data."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encode_texts(known: Vocabulary, column: pa.Array) -> pa.Array:
    """The ids of each text of a column."""
    data, offsets = texts_of(column)
    starts = split_words(data, offsets)
    bounds = np.append(starts, len(data)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    ids = known.words(words.dictionary.to_pylist())
    code = words.indices.to_numpy()
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    sizes, begins = size[code], (np.cumsum(size) - size)[code]
    ends = np.cumsum(sizes)
    chosen = flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
    upto = np.append(0, ends)[np.searchsorted(starts, offsets[1:])]
    return _binary(chosen, 4 * upto)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """A row per input row: id_col and ids, the text's tokens as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Bytes that are not UTF-8 count as U+FFFD. Repeated rows and null ids give a row each,
    an empty table none; other columns are not read. `path` is a file of ranks that every worker has.
    """
    path = path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for rows in slices(batch, 1, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([rows.column(0), encode_texts(known, rows.column(1))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType
    shape = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType())])
    rows = docs.select(F.col(id_col), F.make_valid_utf8(text_col))
    return rows.mapInArrow(run, shape).select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """A row per input row: id_col, ids_col and decoded, the bytes of the tokens; null ids give no bytes."""
    path = path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = _pieces(path).__getitem__
        for batch in batches:
            for rows in slices(batch, 1, SLICE_BYTES):
                data, offsets = texts_of(rows.column(1))
                ids = np.frombuffer(data.tobytes(), "<u4").tolist()
                cuts = (offsets // 4).tolist()
                texts = [b"".join(map(piece, ids[a:b])) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.binary())], names=["id", "ids", "decoded"])

    kind = encoded.schema[id_col].dataType
    shape = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return encoded.select(id_col, ids_col).mapInArrow(run, shape) \
        .select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")


def _stored(tables: list[PrefixTable]) -> list[pa.Array]:
    """A table as columns: the text, the ends of its words and the last token of each byte, as packed numbers."""
    return [pa.array([t.text for t in tables], pa.binary()), pa.array([t.ends.astype("<u4").tobytes() for t in tables], pa.binary()),
            pa.array([t.last.astype("<u4").tobytes() for t in tables], pa.binary())]


TABLE_COLUMNS = ("text", "word_ends", "last_tokens")


def prefix_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """A row per input row: id_col, text (UTF-8 bytes), word_ends, last_tokens: what append and replace go on from.

    Null text counts as empty. Texts of 4 GB and more do not fit the numbers, nor Spark's rows.
    """
    path = path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for rows in slices(batch, 1, SLICE_BYTES // 4):
                made = [PrefixTable(known, t or b"") for t in rows.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), *_stored(made)], names=["id", *TABLE_COLUMNS])

    kind = docs.schema[id_col].dataType
    shape = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.BinaryType()) for c in TABLE_COLUMNS)])
    rows = docs.select(F.col(id_col), F.make_valid_utf8(text_col))
    return rows.mapInArrow(run, shape).select(F.col("id").alias(id_col), *TABLE_COLUMNS)


def revise(tables: DataFrame, edits: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Stored tables after one edit each: the columns of prefix_tables(), ids, and found, the table entries not taken over.

    `edits` has id_col, start, stop (code points, the part that goes) and addition (text). A null start means the end of the
    text, a null stop the start, a null addition nothing; places beyond the text mean its end. Several edits of one id give a
    row each, every one of them of the stored text. Tables without an edit and edits without a table give no row.
    """
    path = path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for rows in slices(batch, 1, SLICE_BYTES // 4):
                made, found = [], []
                for r in rows.select(list(rows.schema.names[1:])).to_pylist():
                    one = PrefixTable(known, r["text"], np.frombuffer(r["word_ends"], "<u4"), np.frombuffer(r["last_tokens"], "<u4"))
                    place = np.append(np.flatnonzero((np.frombuffer(one.text, np.uint8) & 0xC0) != 0x80), len(one.text))
                    chars = len(place) - 1
                    start = chars if r["start"] is None else min(max(r["start"], 0), chars)
                    stop = start if r["stop"] is None else min(max(r["stop"], start), chars)
                    found.append(one.replace(int(place[start]), int(place[stop]), (r["addition"] or "").encode()))
                    made.append(one)
                ids = [_pack(t.ids()) for t in made]
                yield pa.RecordBatch.from_arrays([rows.column(0), *_stored(made), pa.array(ids, pa.binary()),
                                                  pa.array(found, pa.int64())], names=["id", *TABLE_COLUMNS, "ids", "found"])

    kind = tables.schema[id_col].dataType
    shape = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.BinaryType()) for c in (*TABLE_COLUMNS, "ids")),
                          T.StructField("found", T.LongType())])
    wanted = edits.select(F.col(id_col), F.col("start").cast("long"), F.col("stop").cast("long"),
                          F.make_valid_utf8("addition").alias("addition"))
    joined = tables.select(id_col, *TABLE_COLUMNS).join(wanted, id_col)
    return joined.mapInArrow(run, shape).select(F.col("id").alias(id_col), *TABLE_COLUMNS, "ids", "found")
