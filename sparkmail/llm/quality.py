"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each partition sums its own normal equations, by fold; Spark adds them up, and
only the sums reach the driver. Each fold is scored by the model of the other folds, and the isotonic curve from these
scores to the share of good documents makes the final score a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmail.llm.common import held_out, remainder

PLAIN = np.frombuffer(b".,;:?'\"()-", np.uint8)
SPACES = np.array([9, 10, 11, 12, 13, 32])
N_STATISTICS = 14
N_FEATURES = 256
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations of a statistic
RIDGE = 1e-4  # per training row
BINS = 1024  # of raw scores from -0.5 to 1.5, for the isotonic curve
FOLDS = (0, 1, 3)  # remainders that may be learned from


def statistics_of(text: str | None) -> list[float]:
    """Shares and lengths that tell prose from junk, over the whole text; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.lower().split()
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, n_words = max(1, len(raw)), max(1, len(words))
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    plain, spaces, digits = counts[PLAIN].sum(), counts[SPACES].sum(), counts[48:58].sum()
    beyond = counts[128:].sum()
    odd = len(raw) - upper - lower - plain - spaces - digits - beyond
    return [
        np.log1p(len(words)),
        (len(raw) - spaces) / n_words / 10,
        upper / max(1, upper + lower),
        odd / n,
        plain / n,
        digits / n,
        spaces / n,
        beyond / n,
        counts[33] / n_words,
        counts[124] / n_words,
        np.log1p(len(seen)) / np.log1p(n_words),
        max(seen.values(), default=0) / n_words,
        1 - len(set(lines)) / max(1, len(lines)),
        (counts[46] + counts[63]) / n_words,
    ]


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array([statistics_of(t.as_py()) for t in batch.column(column)]).reshape(-1, N_STATISTICS)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and x, the statistics of each whole text, a row per input row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(_rows(batch, 1)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=[id_col, "x"])

    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(counted, T.StructType([picked.schema[id_col], T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    """What scoring needs; a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: dict[int | None, np.ndarray]  # by the fold left out; None: learned from all
    curve: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos((x - self.mean) / self.scale @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, x: np.ndarray, left_out: int | None = None) -> np.ndarray:
        return self.features(x) @ self.weights[left_out]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.curve) if len(x) else np.zeros(0)


def isotonic(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Means of pooled neighbours that never fall, weighted by n (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for total, count in zip(y, n):
        blocks.append([total, count, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(k, total / count) for total, count, k in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", seed: int = 5) -> Model:
    """Learn from rows of statistics() whose id has a label and is not held out.

    Several labels of one id are averaged; null labels and null ids are not used. Without any label all scores are 0.5.
    """
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / WIDTH, (N_STATISTICS, N_FEATURES))
    phases = rng.uniform(0, 2 * np.pi, N_FEATURES)
    size = N_FEATURES + 1
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col) \
        .agg(F.avg(label_col).alias("y"))
    rows = stats.join(known, id_col).select("x", "y", remainder(id_col).cast("int").alias("fold"))
    moments = rows.agg(F.count("*").alias("n"), *[f(F.col("x")[i]) for i in range(N_STATISTICS)
                                                  for f in (F.avg, F.stddev_pop)]).first()
    if not moments["n"]:
        flat = (np.array([0.0]), np.array([0.5]))
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), directions, phases, {None: np.zeros(size)}, flat)
    mean, spread = np.array(moments[1::2], float), np.array(moments[2::2], float)
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), directions, phases, {}, (np.zeros(1), np.zeros(1)))

    def equations(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: np.zeros((size, size + 1)) for k in FOLDS}
        for part in parts:
            for fold, own in part.groupby("fold"):
                z = model.features(np.stack(own["x"].to_numpy()))
                sums[fold] += z.T @ np.column_stack([z, own["y"].to_numpy()])
        for fold, total in sums.items():
            if total.any():
                yield pd.DataFrame({"fold": fold, "line": range(size), "sums": list(total)})

    def added(part: pd.DataFrame) -> pd.DataFrame:
        return part.head(1).assign(sums=[np.sum(np.stack(part["sums"].to_numpy()), axis=0)])

    shape = "fold int, line int, sums array<double>"
    summed = rows.mapInPandas(equations, shape).groupBy("fold", "line").applyInPandas(added, shape).collect()
    totals = {k: np.zeros((size, size + 1)) for k in FOLDS}
    for r in summed:
        totals[r["fold"]][r["line"]] = r["sums"]
    for left_out in (None, *FOLDS):
        total = sum(t for k, t in totals.items() if k != left_out)
        n = total[-1, -2]  # the feature that is always one
        penalty = np.eye(size) * max(1e-6, RIDGE * n)
        penalty[-1, -1] = 1e-9
        model.weights[left_out] = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for fold, own in part.groupby("fold"):
                raw = model.raw(np.stack(own["x"].to_numpy()), fold)
                place = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                yield pd.DataFrame({"place": place, "y": own["y"].to_numpy()})

    bins = rows.mapInPandas(scored, "place int, y double").groupBy("place") \
        .agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("place").collect()  # BINS rows at most
    centres = (np.array([r["place"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    levels = isotonic(np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], float))
    model.curve = (centres, np.clip(levels, 0, 1))
    return model


def score(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Columns id_col, score: the calibrated probability that a document is good, for each row of statistics()."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=[id_col, "score"])

    picked = stats.select(id_col, "x")
    return picked.mapInArrow(scored, T.StructType([picked.schema[id_col], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """Rows of docs, all columns, whose text scores at least `least`; null texts are scored as empty ones."""
    place = docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(_rows(batch, place)) >= least))

    return docs.mapInArrow(good, docs.schema)
