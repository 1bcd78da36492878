"""Language identification by a convolutional network over bytes.

Texts are cut into windows of a fixed number of bytes. A window's bytes are embedded, filters of several widths slide over
it, each filter keeps its largest response, and a softmax layer tells the languages apart. The network is trained in
numpy on a bounded sample of labelled texts; a text's prediction averages the evidence of all its windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmail.llm.common import remainder

WINDOW = 256
DIM = 8  # numbers per byte
WIDTHS = (2, 3, 4, 5)
PER_WIDTH = 8  # filters
SAMPLE_TEXTS = 8000  # texts to learn from, all languages together; at most SAMPLE_PER_LANGUAGE of one
SAMPLE_PER_LANGUAGE = 400
SAMPLE_WINDOWS = 4  # of each text
MAX_LANGUAGES = 1000
EPOCHS, BATCH, RATE = 8, 64, 0.01
UNKNOWN = "und"
AT_ONCE = 64  # windows that go through the filters together
_LETTER = regex.compile(r"\p{L}")


def windows_of(text: str) -> np.ndarray:
    """All windows of the text's bytes, A-Z in lower case; the last one is filled up with zeros."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x DIM; the row of the filling byte stays zero
    filters: np.ndarray  # widest x DIM, filters; zero beyond a filter's width
    shift: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    @property
    def widest(self) -> int:
        return len(self.filters) // DIM

    def spread(self, windows: np.ndarray) -> np.ndarray:
        """The embedded bytes under each position of the widest filter: windows, positions, widest x DIM."""
        padded = np.pad(windows, ((0, 0), (0, self.widest - 1)))
        embedded = self.embedding[padded].reshape(len(windows), -1)
        return sliding_window_view(embedded, len(self.filters), axis=1)[:, ::DIM]

    def logits(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for start in range(0, len(windows), AT_ONCE):
            x = self.spread(windows[start:start + AT_ONCE])
            response = (x.reshape(-1, x.shape[2]) @ self.filters).reshape(x.shape[0], x.shape[1], -1)
            parts.append(np.maximum(response.max(axis=1) + self.shift, 0) @ self.layer + self.bias)
        return np.concatenate(parts)


def train(samples: dict[str, list[np.ndarray]], seed: int = 3) -> Network:
    """Fit a network to windows by language, by Adam on the cross entropy; some windows are cut short to learn from little."""
    rng = np.random.default_rng(seed)
    languages = sorted(samples)
    widest, n = max(WIDTHS), len(WIDTHS) * PER_WIDTH
    keep = np.zeros((widest * DIM, n), np.float32)
    for k, width in enumerate(WIDTHS):
        keep[:width * DIM, k * PER_WIDTH:(k + 1) * PER_WIDTH] = 1
    net = Network(languages, rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
                  (rng.normal(0, 0.3, (widest * DIM, n)) * keep).astype(np.float32), np.zeros(n, np.float32),
                  rng.normal(0, 0.3, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    net.embedding[0] = 0
    x = np.concatenate([w for k in languages for w in samples[k]])
    y = np.concatenate([np.full(sum(map(len, samples[k])), i) for i, k in enumerate(languages)])
    weight = 1 / np.bincount(y, minlength=len(languages))[y]
    names = ("embedding", "filters", "shift", "layer", "bias")
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for start in range(0, len(order), BATCH):
            picked = order[start:start + BATCH]
            windows = x[picked].copy()
            for row in np.flatnonzero(rng.random(len(picked)) < 0.4):
                windows[row, rng.integers(8, WINDOW):] = 0
            step += 1
            grads = _gradients(net, windows, y[picked], weight[picked] / weight[picked].sum())
            grads["filters"] *= keep
            grads["embedding"][0] = 0
            rate = RATE * (1 - (step - 1) / (EPOCHS * -(-len(order) // BATCH)))
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                value = getattr(net, k)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: Network, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    x = net.spread(windows)
    rows, filters = np.arange(len(windows))[:, None], np.arange(net.filters.shape[1])[None, :]
    response = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(x.shape[0], x.shape[1], -1)
    best = response.argmax(axis=1)
    pooled = response[rows, best, filters] + net.shift
    hidden = np.maximum(pooled, 0)
    error = softmax(hidden @ net.layer + net.bias)
    error[np.arange(len(y)), y] -= 1
    error *= weight[:, None]
    back = (error @ net.layer.T) * (pooled > 0)
    seen = x[rows, best]  # windows, filters, widest x DIM: what each filter's largest response has seen
    spread = back[:, :, None] * net.filters.T[None]
    padded = np.pad(windows, ((0, 0), (0, net.widest - 1)))
    under = padded[rows[:, :, None], best[:, :, None] + np.arange(net.widest)]
    embedding = np.zeros_like(net.embedding)
    np.add.at(embedding, under.ravel(), spread.reshape(-1, DIM))
    return {"embedding": embedding, "filters": np.einsum("bf,bfx->xf", back, seen), "shift": back.sum(axis=0),
            "layer": hidden.T @ error, "bias": error.sum(axis=0)}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[np.ndarray]]:
    """Windows by language from the labelled texts that may be learned from; the ids with the smallest hashes are taken.

    Held-out rows and rows without id, label or text are not used. More than MAX_LANGUAGES labels raise ValueError.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .where((remainder("id") != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    most = min(SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS // len(counts))
    rank = F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("rank")
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], float(1.5 * most / r["count"]) * (1 << 40))])
    picked = known.withColumn("rank", rank).where(F.col("rank") < F.element_at(share, F.col("lang"))) \
        .orderBy("rank", "id").limit(2 * most * len(counts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                every = windows_of(text.as_py())
                out.append(every[np.unique(np.linspace(0, len(every) - 1, SAMPLE_WINDOWS).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "windows"])

    rows = picked.select("lang", "text").mapInArrow(cut, "lang string, windows binary").collect()
    out: dict[str, list[np.ndarray]] = {}
    for r in rows:
        own = out.setdefault(r["lang"], [])
        if len(own) < most:
            own.append(np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW))
    return out


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id_col, lang_pred, score (the probability of that language).

    `und` with score 0 where the text is null or has no letter, or where there is no network because no text had a label.
    Ties go to the first language by code point. Only id and text are read.
    """

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                if net is None or not text or not _LETTER.search(text):
                    continue
                windows = windows_of(text)
                filled = np.count_nonzero(windows, axis=1)
                evidence = (net.logits(windows) * filled[:, None]).sum(axis=0, keepdims=True) / filled.sum()
                likely = softmax(evidence.astype(np.float64))[0]
                names[row], scores[row] = net.languages[int(likely.argmax())], float(likely.max())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[id_col, "lang_pred", "score"])

    picked = docs.select(id_col, text_col)
    return picked.mapInArrow(predicted, T.StructType([
        picked.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
