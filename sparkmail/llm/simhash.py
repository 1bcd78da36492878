"""SimHash near-duplicates by ball hashing from both sides.

A fingerprint is a majority vote, bit by bit, over the XXH64 of a text's word shingles. Two fingerprints that differ
in k bits meet half way: each sends out every variant of itself within half of the radius, and rows of one variant meet
in the shuffle. For an odd radius the halves are unequal; at the full distance the bit counts of both fingerprints have
different parity, so only those with an even count send the larger half, and of that only masks whose bits lie in one
32-bit word (of k differing bits, one word holds at least half).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmail.llm.common import stage
from sparkmail.llm.graph import connected_components

SEED = 42
VOTES = 1 << 16  # shingles whose bits are counted at once: memory per step, not a limit
SENT_AT_ONCE = 1024  # fingerprints whose variants are made at once
BUCKET = 400_000  # variants that meet in one group, about
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplying by it mixes without collisions


def _fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for start in range(0, n, VOTES):
        bits = np.unpackbits(hashes[start:start + VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Columns id_col and fp (signed 64-bit). A null text counts as empty; a text without words has fingerprint zero."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=[id_col, "fp"])

    picked = docs.select(id_col, text_col)
    schema = T.StructType([picked.schema[id_col], T.StructField("fp", T.LongType())])
    return picked.mapInArrow(vote, schema)


def _masks(radius: int) -> tuple[list[int], int]:
    """Flips of at most half the radius, then the larger flips of an odd radius; and how many the first are."""
    def flips(size: int, bits: range) -> list[int]:
        return [sum(1 << b for b in picked) for picked in combinations(bits, size)]

    half = radius // 2
    masks = [m for size in range(half + 1) for m in flips(size, range(64))]
    near = len(masks)
    if radius % 2:
        more = flips(half + 1, range(32)) + flips(half + 1, range(32, 64))
        masks += more
    return masks, near


def _send(masks: list[int], near: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array(masks, np.uint64)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(every), SENT_AT_ONCE):
                prints = every[start:start + SENT_AT_ONCE]
                even = np.bitwise_count(prints) % 2 == 0
                parts = [(prints[even], len(flips)), (prints[~even], near)]
                variants = np.concatenate([(x[:, None] ^ flips[None, :n]).ravel() for x, n in parts])
                picks = np.concatenate([np.tile(np.arange(n, dtype=np.uint16), len(x)) for x, n in parts])
                bucket = ((variants * SPREAD) >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                found, starts = np.unique(bucket[order], return_index=True)
                cuts = list(zip(starts, [*starts[1:], len(order)]))
                variants, picks = variants[order], picks[order]
                yield pa.RecordBatch.from_arrays([
                    pa.array(found.astype(np.int64)),
                    pa.array([variants[a:b].tobytes() for a, b in cuts], pa.binary()),
                    pa.array([picks[a:b].tobytes() for a, b in cuts], pa.binary()),
                ], names=["bucket", "variants", "picks"])

    return send


def _meet(masks: list[int], near: int, radius: int) -> Callable[[pa.Table], pa.Table]:
    def meet(sent: pa.Table) -> pa.Table:
        variants = np.frombuffer(b"".join(sent.column("variants").to_pylist()), np.uint64)
        picks = np.frombuffer(b"".join(sent.column("picks").to_pylist()), np.uint16)
        order = np.argsort(variants)
        variants, picks = variants[order], picks[order]
        starts = np.flatnonzero(np.r_[True, variants[1:] != variants[:-1]])
        sizes = np.diff(np.r_[starts, len(variants)])
        shared = np.repeat(sizes > 1, sizes)  # most variants are sent by one fingerprint
        variants, picks, sizes = variants[shared], picks[shared], sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        prints = variants ^ np.array(masks, np.uint64)[picks]
        pairs = np.zeros((0, 2), np.uint64)
        if len(starts):
            close = picks < near
            hub = np.repeat(np.minimum.reduceat(np.where(close, prints, np.uint64(2**64 - 1)), starts), sizes)
            some = np.repeat(np.logical_or.reduceat(close, starts), sizes)
            linked = some & (hub != prints) & (np.bitwise_count(hub ^ prints) <= radius)
            pairs = np.unique(np.column_stack([hub[linked], prints[linked]]), axis=0)
        return pa.table({"hub": pairs[:, 0].copy().view(np.int64), "fp": pairs[:, 1].copy().view(np.int64)})

    return meet


def links(prints: DataFrame, radius: int = 3, fp: str = "fp") -> DataFrame:
    """Links hub and fp between distinct fingerprints within the radius; as many as keep every group connected.

    Fingerprints that meet in a variant and of which one (the hub) is within the smaller half of the radius are all
    within the radius of the hub, so linking them to the hub loses no group, and no pairs inside a meeting are listed.
    A variant's meeting holds at most one row per mask, whatever the data. The bit distance of each link is checked.
    Variants travel packed, some thousands to a row; the number of buckets grows with the fingerprints, so a bucket has
    about BUCKET variants at every size.
    """
    masks, near = _masks(radius)
    rows = prints.select(F.col(fp).alias("fp")).where(F.col(fp).isNotNull()).distinct()
    buckets = max(1, rows.count() * (len(masks) + near) // 2 // BUCKET)
    sent = rows.mapInArrow(_send(masks, near, buckets), "bucket long, variants binary, picks binary")
    return sent.groupBy("bucket").applyInArrow(_meet(masks, near, radius), "hub long, fp long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                   radius: int = 3) -> DataFrame:
    """One row per input row: id_col, fp, component_id (smallest id reachable over links).

    Texts: null is empty; no words gives fingerprint zero, linked like any other. Ids: repeated ids keep a row each;
    rows with a null id take part, and have a null component_id only where no row of their group has an id. An empty
    table gives no rows. Other columns of docs are not read.
    """
    prints = stage(fingerprints(docs, id_col, text_col, width), "simhash")
    firsts = stage(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-firsts")
    groups = connected_components(links(firsts, radius), "hub", "fp")
    placed = firsts.join(groups, firsts["fp"] == groups["node"], "left") \
        .select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(placed.join(least, "root").select("fp", "component_id"), "simhash-groups")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
               radius: int = 3) -> DataFrame:
    """One row of each group: that with the smallest id, and of several texts with this id the one with the smallest hash.

    Rows without an id come after all others, so one of them stays only where its group has no id. Different texts that
    share an id are told apart, so each group keeps a row. Rows repeated with id and text are one.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    groups = simhash_groups(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", width, radius)
    first = groups.where(F.col("key") == F.col("component_id")).select("key").distinct()
    rows = docs.select(F.struct("*").alias("row"), key.alias("key")).join(first, "key", "left_semi")
    return rows.dropDuplicates(["key"]).select("row.*")
