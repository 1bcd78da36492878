"""Vector code compression: product codes whose entries are found over a trie of distinct parts.

Components become integers and vectors are cut into parts. The distinct parts of a batch of vectors, sorted, are the leaves
of a trie with a level per dimension. A walk through it, depth first, keeps the squared distances to all codebook entries
over the dimensions so far, so parts that begin alike share them. At a leaf the nearest entry is the least of them, and the
part is added to that entry's sum as often as it occurs. Only these sums are shuffled, never vectors or parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparkmail.llm.common import stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BATCH_ROWS = 1 << 15  # vectors whose parts share tries
SUBTREE = 1 << 12  # leaves up to which all nodes of a level are taken in one step
LARGEST = 1 << 27  # of an integer component, so that squared distances stay exact in 64 bits

Books = dict[int, np.ndarray]  # per vector length the entries of all parts side by side: entries x length


def cuts(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Bounds of the parts: equal where `parts` divides the length, else equal but for one component."""
    return [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of each row among them, and how often each occurs."""
    if not rows.shape[1]:
        return rows[:1], np.zeros(len(rows), np.int64), np.array([len(rows)])[:len(rows[:1])]
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return ordered[starts], place, np.diff(np.append(starts, len(rows)))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the first of equals, and its squared distance. Parts are distinct and in order.

    The walk visits the trie's nodes in order, depth first; a node's children share its distances. Below a node with few
    leaves the levels are taken one by one, all nodes of a level together.
    """
    entry, least = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    depth_of = parts.shape[1]
    todo = [(0, len(parts), 0, np.zeros(len(book), np.int64))]
    while todo:
        start, stop, depth, reached = todo.pop()
        if stop - start <= SUBTREE or depth == depth_of:
            entry[start:stop], least[start:stop] = _leaves(parts[start:stop], book, depth, reached)
            continue
        value = parts[start:stop, depth]
        bounds = [start, *(start + 1 + np.flatnonzero(value[1:] != value[:-1])).tolist(), stop]
        for a, b in reversed(list(zip(bounds, bounds[1:]))):
            todo.append((a, b, depth + 1, reached + (parts[a, depth] - book[:, depth]) ** 2))
    return entry, least


def _leaves(parts: np.ndarray, book: np.ndarray, depth: int, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() below one node, whose distances up to `depth` are given."""
    distances, node = reached[None, :], np.zeros(len(parts), np.int64)
    new = np.zeros(len(parts), bool)
    new[:1] = True
    for d in range(depth, parts.shape[1]):
        new[1:] |= parts[1:, d] != parts[:-1, d]
        first = np.flatnonzero(new)  # of the leaves below each node of this level
        distances = distances[node[first]] + (parts[first, d, None] - book[:, d]) ** 2
        node = np.cumsum(new) - 1
    best = distances.argmin(axis=1)
    return best[node], distances[np.arange(len(best)), best][node]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    scaled = np.floor(values * SCALE)
    if np.abs(scaled).max(initial=0) > LARGEST:
        raise ValueError(f"a vector has a component beyond {LARGEST / SCALE}; squared distances would leave 64 bits")
    return scaled.astype(np.int64)


def _by_length(rows: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, integer vectors) for the vectors of each length in a batch."""
    vectors = rows.column(column)
    sizes = vectors.value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == dim)
        yield dim, places, _matrix(vectors.take(pa.array(places)), dim)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of up to BATCH_ROWS rows, however they come in."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= BATCH_ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH_ROWS)
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH_ROWS)


def _sums(books: Books, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per length, entry and component: how many parts went to the entry, and the sum of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {dim: np.zeros((2, *book.shape), np.int64) for dim, book in books.items()}
        seen = set()
        for rows in _pieces(batches):
            for dim, _, vectors in _by_length(rows, 0):
                seen.add(dim)
                for a, b in cuts(dim, parts):
                    some, _, times = distinct(vectors[:, a:b])
                    entry, _ = nearest(some, books[dim][:, a:b])
                    np.add.at(total[dim][0, :, a:b], entry, times[:, None])
                    np.add.at(total[dim][1, :, a:b], entry, some * times[:, None])
        for dim in sorted(seen):
            used = np.flatnonzero(total[dim][0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), dim)), pa.array(used), *(pa.array(x.ravel()[used]) for x in total[dim])],
                names=["dim", "slot", "times", "total"])

    return run


def _codes(books: Books, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _pieces(batches):
            code, error = np.zeros((len(rows), parts), np.int64), np.zeros(len(rows), np.int64)
            for dim, places, vectors in _by_length(rows, 0):
                for p, (a, b) in enumerate(cuts(dim, parts)):
                    some, place, _ = distinct(vectors[:, a:b])
                    entry, least = nearest(some, books[dim][:, a:b])
                    code[places, p] = entry[place]
                    error[places] += least[place]
            packed = code.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*rows.columns[1:], pa.array([r.tobytes() for r in packed], pa.binary()),
                                              pa.array(error)], names=["id", "label", "code", "error"])

    return run


def _first_books(rows: DataFrame, entries: int) -> Books:
    """The vectors of the smallest ids of each length; ids that are null come last, equal ones by vector."""
    ranked = rows.select("v", F.size("v").alias("dim"),
                         F.row_number().over(W.partitionBy(F.size("v")).orderBy(F.asc_nulls_last("id"), "v")).alias("k"))
    chosen = ranked.where(F.col("k") <= entries).groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("x"))
    return {r["dim"]: _matrix(pa.array([x["v"] for x in r["x"]], pa.list_(pa.float64())), r["dim"]) for r in chosen.collect()}


def kept(table: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.col(vector_col).isNotNull() & finite)


def train(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> Books:
    """Codebooks per vector length, as integers; no rows, no books.

    They start as the vectors of the smallest ids, fewer than `entries` if there are no more. Each round assigns the parts of
    all kept vectors and replaces every entry by the mean of its parts, rounded down; unused entries stay. The driver holds
    `entries` vectors of each length that occurs. The table is read once a round and once before.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    rows = kept(table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v")
    books = _first_books(rows, entries)
    for _ in range(rounds if books else 0):
        sums = rows.select("v").mapInArrow(_sums(books, parts), "dim long, slot long, times long, total long") \
            .groupBy("dim", "slot").agg(F.sum("times").alias("times"), F.sum("total").alias("total"))
        changed = {dim: book.copy() for dim, book in books.items()}
        for r in sums.toLocalIterator():
            changed[r["dim"]].ravel()[r["slot"]] = r["total"] // r["times"]
        books = changed
    return books


def encode(table: DataFrame, books: Books, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           parts: int = PARTS) -> DataFrame:
    """A row per kept row: id_col, label_col, code (a byte a part), error (squared distances summed over the parts)."""
    kind = {c: table.schema[c].dataType for c in (id_col, label_col)}
    shape = T.StructType([T.StructField("id", kind[id_col]), T.StructField("label", kind[label_col]),
                          T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    rows = kept(table.select(F.col(vector_col).alias("v"), F.col(id_col).alias("id"), F.col(label_col).alias("label")), "v")
    return rows.mapInArrow(_codes(books, parts), shape).select(
        F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error")


def digest(books: Books, parts: int = PARTS) -> str:
    """SHA-256 of all entries' components by length, part, entry and place, joined by commas."""
    numbers = [str(x) for dim in sorted(books) for a, b in cuts(dim, parts) for x in books[dim][:, a:b].ravel().tolist()]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def decode(encoded: DataFrame, books: Books, dim: int, id_col: str = "vec_id", code_col: str = "code",
           parts: int = PARTS) -> DataFrame:
    """A row per input row: id_col and approximate, the vector of length `dim` that its code stands for."""
    book = books[dim].astype(np.float64) / SCALE
    owner = np.repeat(np.arange(parts), [b - a for a, b in cuts(dim, parts)])  # the part that each component lies in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            values = pa.array(book[code[:, owner], np.arange(dim)].ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * dim, pa.int32()), values)],
                names=["id", "approximate"])

    shape = T.StructType([T.StructField("id", encoded.schema[id_col].dataType),
                          T.StructField("approximate", T.ArrayType(T.DoubleType()))])
    return encoded.select(id_col, code_col).mapInArrow(run, shape).select(F.col("id").alias(id_col), "approximate")


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Books]:
    """(rows of encode() with label_error, the error summed over equal labels; the codebooks).

    Vectors that are null or hold null or non-finite components give no row. Vectors of another length have codebooks of
    their own; a length that the number of parts does not divide is cut as evenly as possible. Null labels are one label.
    Repeated rows and ids, and null ids, give a row each. An empty table gives no rows. Other columns are not read. A
    component beyond LARGEST / SCALE raises ValueError.
    """
    books = train(table, id_col, vector_col, parts, entries, rounds)
    coded = stage(encode(table, books, id_col, vector_col, label_col, parts), "codes")
    sums = coded.groupBy(F.col(label_col).alias("label")).agg(F.sum("error").alias("label_error"))
    joined = coded.alias("c").join(sums.alias("s"), F.col(f"c.{label_col}").eqNullSafe(F.col("s.label")))
    return joined.select("c.*", "s.label_error"), books
