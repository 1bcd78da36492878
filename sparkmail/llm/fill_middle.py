"""Fill-in-the-middle: documents cut at two ranks of units, found in an indexable skip list.

The units (lines) of a slice of documents are the nodes of one skip list. Each link of a lane carries how many units and how
many code points it passes. A search for a rank descends from the top lane, takes every link that does not pass the rank and
adds up what it passed: at the bottom it has the rank exactly, and with it the code points before the cut. All ranks of a
slice descend together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmail.llm.common import slices, texts_of

SLICE_BYTES = 1 << 22  # of text whose units share a list; a longer text is a slice of its own
FAN = 4  # one node of so many rises to the next lane
# What marks the prefix, suffix and middle of an output.
MARKS = ("<P>", "<S>", "<M>")
NO_LINK = np.iinfo(np.int64).max


@dataclass
class Lane:
    """The links of one level, in order: the units and code points that each passes, and the place of the node it leaves in
    the lane below. One more entry stands for the end of the list, which no link leaves."""

    units: np.ndarray
    chars: np.ndarray
    below: np.ndarray


class SkipList:
    """Units by rank, with the code points before them."""

    def __init__(self, chars: np.ndarray, seed: int = 0):
        """`chars` has the code points of each unit. Which nodes rise to the next lane is drawn from the seed."""
        rng = np.random.default_rng(seed)
        units, chars = np.ones(len(chars), np.int64), chars.astype(np.int64)
        self.lanes = [self._lane(units, chars, np.arange(len(units)), 0)]  # top lane first
        while len(units) > 2 * FAN:
            rises = rng.random(len(units)) < 1 / FAN
            rises[0] = True  # every lane begins with the first node
            below = np.flatnonzero(rises)
            self.lanes.insert(0, self._lane(np.add.reduceat(units, below), np.add.reduceat(chars, below), below, len(units)))
            units, chars = self.lanes[0].units[:-1], self.lanes[0].chars[:-1]

    @staticmethod
    def _lane(units: np.ndarray, chars: np.ndarray, below: np.ndarray, end: int) -> Lane:
        return Lane(np.append(units, NO_LINK), np.append(chars, 0), np.append(below, end))

    def seek(self, ranks: np.ndarray) -> np.ndarray:
        """Code points before the units of the given ranks, 0 to the number of units."""
        left, at, chars = ranks.astype(np.int64), np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for lane in self.lanes:
            going = np.arange(len(ranks))
            while True:
                going = going[lane.units[at[going]] <= left[going]]
                if not len(going):
                    break
                left[going] -= lane.units[at[going]]
                chars[going] += lane.chars[at[going]]
                at[going] += 1
            at = lane.below[at]
        return chars


def line_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each line of the texts data[offsets[i]:offsets[i + 1]], and the number of lines before each text."""
    mark = np.zeros(len(data) + 1, bool)
    mark[offsets] = True
    mark[np.flatnonzero(data == 10) + 1] = True
    starts = np.flatnonzero(mark[:-1])
    chars = np.add.reduceat(((data & 0xC0) != 0x80).astype(np.int64), starts) if len(starts) else starts
    return chars, np.searchsorted(starts, offsets)


def _cut(batches: Iterator[pa.RecordBatch], marks: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Rows of n, prefix_chars, middle_chars and output for rows of id, text, first, second and form."""
    before, after, between = marks
    for batch in batches:
        for rows in slices(batch, 1, SLICE_BYTES):
            data, offsets = texts_of(rows.column(1))
            chars, begins = line_units(data, offsets)
            n = np.diff(begins)
            draws = np.stack([rows.column(k).to_numpy() for k in (2, 3)]) % (n + 1)
            places = np.concatenate([begins[:-1], begins[:-1] + draws.min(axis=0), begins[:-1] + draws.max(axis=0)])
            start, low, high = SkipList(chars).seek(places).reshape(3, -1)
            prefix, middle, out = (low - start).tolist(), (high - low).tolist(), []
            for k, (text, form) in enumerate(zip(rows.column(1).to_pylist(), rows.column(4).to_pylist())):
                text, a, b = text or "", prefix[k], prefix[k] + middle[k]
                if form == "plain":
                    prefix[k] = middle[k] = None
                    out.append(text)
                elif form == "psm":
                    out.append("".join([before, text[:a], after, text[b:], between, text[a:b]]))
                else:
                    out.append("".join([after, text[b:], before, text[:a], between, text[a:b]]))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n, pa.int64()), rows.column(4), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(out, pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _check_marks(marks: tuple[str, str, str]) -> None:
    """Marks can be told from the text around them if no end of one begins another, or itself, and none holds another."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            shared = any(a.endswith(b[:k]) for k in range(1, len(b) + (i != j)))
            if not a or shared or i != j and a in b:
                raise ValueError(f"marks {marks} overlap")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100,
                   spm_rate: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """A row per input row: id_col, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Draws come from the SHA-256 of seed and id, so reruns agree, and rows of one id get the same draws: two for the cuts, one
    below `rate` of 100 for being transformed and one below `spm_rate` of 100 for the form spm. Null text is empty; empty
    texts and those that hold a mark stay plain. Bytes that are not UTF-8 count as U+FFFD. A null id is drawn for like an
    empty one. An empty table gives no rows; other columns are not read. Marks must not overlap (ValueError).
    """
    _check_marks(marks)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce(F.make_valid_utf8(text_col), F.lit(""))
    plain = (text == "") | (draw[2] % 100 >= rate)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(draw[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), draw[0].alias("first"), draw[1].alias("second"),
                       form.alias("form"))
    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
                          T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                          T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return rows.mapInArrow(lambda batches: _cut(batches, marks), shape) \
        .select(F.col("id").alias(id_col), *shape.names[1:])


def restored(form: str | Column = "form", output: str | Column = "output", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from."""
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    before, after, between = marks
    middle = F.substring_index(output, between, -1)
    rest = F.substring_index(output, between, 1)
    head = F.when(form == "psm", F.substring_index(F.substring_index(rest, after, 1), before, -1)) \
        .otherwise(F.substring_index(rest, before, -1))
    tail = F.when(form == "psm", F.substring_index(rest, after, -1)) \
        .otherwise(F.substring_index(F.substring_index(rest, before, 1), after, -1))
    return F.when(form == "plain", output).otherwise(F.concat(head, middle, tail))
