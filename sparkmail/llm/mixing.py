"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

Every document of a source gets the same expected number of copies, its source's target over its size. The whole part
is certain. The fractions are rounded in pairs: words are moved from one document of the pair to the other, at random in
a way that keeps both expectations, until one of them has a whole number of copies; the other goes on. Expected words of
a source never change, so only the last document of a source, rounded to the nearest, moves its sum off the target.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmail.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
SHARE = 1.5
CAP = 2.0
WEIGHTS = (5.0, 2.0, 1.0)
LEAF = 1024  # documents that a task rounds in one go
FAN_IN = 64  # blocks whose residuals meet in one group of the next level
MAX_SOURCES = 100_000
EDGE = 1e-9


def water_fill(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
               cap: float = CAP) -> dict[str | None, float]:
    """Targets by weight, stopped at cap times the size; what is over is shared again among the others."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, active, targets = share * sum(sizes.values()), list(order), {}
    while active:
        level = left / sum(weight[s] for s in active)
        full = [s for s in active if level * weight[s] > cap * sizes[s]]
        if not full:
            return targets | {s: level * weight[s] for s in active}
        for s in full:
            targets[s] = cap * sizes[s]
            left -= targets[s]
        active = [s for s in active if s not in targets]
    return targets


def pivotal(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int | None]:
    """Round fractions p in order; the rounded fractions and the place of the one still fractional, if any."""
    out, at = p.copy(), None
    draws = rng.random(len(p))
    for j in range(len(p)):
        if size[j] == 0 or not EDGE < out[j] < 1 - EDGE:
            out[j] = round(out[j])
            continue
        if at is None:
            at = j
            continue
        i = at
        up = min((1 - out[i]) * size[i], out[j] * size[j])
        down = min(out[i] * size[i], (1 - out[j]) * size[j])
        moved = up if draws[j] * (up + down) < down else -down
        out[i] += moved / size[i]
        out[j] -= moved / size[j]
        free = [k for k in (i, j) if EDGE < out[k] < 1 - EDGE]
        for k in (i, j):
            if k not in free:
                out[k] = round(out[k])
        at = free[0] if free else None
    return out, at


def _round(level: int, seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def rounded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "id", "tie"], ascending=[False, True, True], ignore_index=True, na_position="first")
        first = rows.iloc[0]
        name = "" if first["source"] is None else f"={first['source']}"
        rng = np.random.default_rng([seed, level, int(first["block"]), zlib.crc32(name.encode("utf-8", "surrogatepass"))])
        p, at = pivotal(rows["size"].to_numpy(), rows["p"].to_numpy(dtype=float), rng)
        done = np.ones(len(rows), bool)
        if at is not None and last:
            p[at] = math.floor(p[at] + 0.5)
        elif at is not None:
            done[at] = False
        return rows.assign(p=p, done=done)

    return rounded


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float,
            cap: float, seed: int) -> DataFrame:
    """A row per document: id (as text), source, size, source_size, target, tie (hash of id and text), copies."""
    spark = docs.sparkSession
    sized = stage(docs.select(
        F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _tie(id_col, text_col).alias("tie")), "mix-sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = water_fill({r["source"]: r["words"] for r in sums}, weights, share, cap)
    blocks = {r["source"]: max(1, math.ceil(r["n"] / LEAF)) for r in sums}
    rates = spark.createDataFrame(
        [(r["source"], r["words"], float(targets[r["source"]]), blocks[r["source"]]) for r in sums],
        "of string, source_size long, target double, blocks long")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    rows = sized.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col("of"))) \
        .withColumn("rate", rate).withColumn("whole", F.floor("rate")) \
        .withColumn("p", F.col("rate") - F.col("whole")) \
        .withColumn("block", F.pmod("tie", "blocks")).drop("of", "rate", "blocks")
    schema = T.StructType([*rows.schema, T.StructField("done", T.BooleanType())])
    level, most, finished = 0, max(blocks.values(), default=1), None
    while True:
        last = most == 1
        step = stage(rows.groupBy("source", "block").applyInPandas(_round(level, seed, last), schema), f"mix-{level}")
        finished = step.where("done") if finished is None else finished.union(step.where("done"))
        if last:
            break
        rows = step.where(~F.col("done")).drop("done").withColumn("block", F.floor(F.col("block") / FAN_IN))
        level, most = level + 1, math.ceil(most / FAN_IN)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("p").cast("long")).otherwise(0).cast("long")
    return finished.select("id", "source", "size", "source_size", "target", "tie", copies.alias("copies"))


def _tie(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7) -> DataFrame:
    """Columns id_col, source, size, source_size, target, copies: how often the mix takes each document.

    Null text has size 0 and 0 copies; a null source is a source of its own, ordered last. Repeated rows are rounded one
    by one. A null id is a value like any other. An empty table gives no rows; columns not named are not read. Sources
    are summed up on the driver, so more than MAX_SOURCES of them raise ValueError. Reruns agree: the random numbers
    come from seed, source and block.
    """
    taken = _copies(docs, id_col, text_col, source_col, weights, share, cap, seed)
    return taken.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "source", "size", "source_size",
                        "target", "copies")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken; rows without words are not.

    Rows are told apart by id and text. Rows repeated in the input count together: one of them stands for all copies.
    """
    taken = _copies(docs, id_col, text_col, source_col, weights, share, cap, seed) \
        .groupBy(F.struct("id", "tie").alias("key")).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    key = F.struct(F.col(id_col).cast("string").alias("id"), _tie(id_col, text_col).alias("tie"))  # nulls in it are equal
    found = docs.select(F.struct("*").alias("row"), key.alias("key")).join(taken, "key").dropDuplicates(["key"])
    return found.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
