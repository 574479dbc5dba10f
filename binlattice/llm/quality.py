"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Shallow trees on one feature at a time
are boosted in cycles with a small step and summed into one table a feature;
then trees on pairs, for the pairs that explain most of what is left. A score
is a sum of table look-ups, done for all documents of a batch at once.

Learned from at most ``SAMPLE`` labelled rows a class. Without both classes
every document scores one half.

Defined cases: null and empty texts have zero features and are scored like any
other; every row of documents gives one row, scored by its text alone, also where
a doc_id is null (then it isn't held out and trains nothing) or on several rows
(each of which trains, as any row); of several labels of one doc_id the largest
counts, null labels and labels without a document none; of equal splits the
first is taken, and of features with equal gain the first; texts of any length
are read whole; no documents give no rows; other columns may have any names
(``accepted`` passes them through, ``score`` returns only its own).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .text import buffers

SAMPLE, BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 2500, 32, 120, 60, 6, 0.1
FEATURES = (
    "log_bytes", "word_bytes", "upper", "digits", "symbols", "spaces", "unique", "top_word", "echo", "line_words",
    "repeated_lines", "stops", "exclaim", "bars", "longest", "marked_words", "bigrams", "high_bytes", "short_words", "entropy",
)
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True


def features(text: bytes) -> list[float]:
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    c = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    counts = Counter(words)
    lines = text.split(b"\n")
    filled = c[c > 0] / size
    return [
        np.log1p(size), size / n, upper / max(1, upper + lower), c[48:58].sum() / size, c[SYMBOLS].sum() / size, (c[32] + c[9:14].sum()) / size,
        len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words[1:], words)) / n, n / len(lines),
        1 - len(set(lines)) / len(lines), (c[46] + c[63]) / n, c[33] / n, c[124] / n, max(map(len, words)),
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), c[128:].sum() / size,
        sum(len(w) <= 3 for w in words) / n, float(-(filled * np.log2(filled)).sum()),
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    data, at = buffers(texts)
    whole = data.tobytes()
    return np.array([features(whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=float).reshape(-1, len(FEATURES))


def tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of a tree on ordered bins with gradient g and weight h; splits that gain most."""
    out = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(np.argmax(gain)) + 1
    if gain[at - 1] <= 1e-9:
        return out
    return np.concatenate([tree(g[:at], h[:at], depth - 1), tree(g[at:], h[at:], depth - 1)])


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if self.edges else np.empty((len(x), 0), dtype=int)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        m = np.full(len(bins), self.intercept)
        for j, t in enumerate(self.tables):
            m += t[bins[:, j]]
        for i, j, t in self.pairs:
            m += t[bins[:, i], bins[:, j]]
        return m

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    m = Model()
    if len(np.unique(y)) < 2:
        return m
    m.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    m.intercept = float(np.log(y.mean() / (1 - y.mean())))
    b = m.bins(x)
    f = m.margin(b)

    def slope():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, t in enumerate(m.tables):
            g, h = slope()
            step = RATE * tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), 2)
            t += step
            f += step[b[:, j]]
    g, h = slope()
    found = []
    for i in range(x.shape[1]):
        for j in range(i):
            cell = b[:, i] // 4 * 16 + b[:, j] // 4
            found.append((float((np.bincount(cell, g, 256) ** 2 / (np.bincount(cell, h, 256) + 1)).sum()), i, j))
    m.pairs = [(i, j, np.zeros((len(m.tables[i]), len(m.tables[j])))) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in m.pairs:
            g, h = slope()
            flat = b[:, i] * t.shape[1] + b[:, j]
            gs, hs = (np.bincount(flat, v, t.size).reshape(t.shape) for v in (g, h))
            rows = tree(gs.sum(axis=1), hs.sum(axis=1), 1)
            cut = int(np.argmax(rows != rows[0])) or len(rows)
            step = np.empty_like(t)
            for part in (slice(0, cut), slice(cut, len(rows))):
                step[part] = RATE * tree(gs[part].sum(axis=0), hs[part].sum(axis=0), 1)
            t += step
            f += step[b[:, i], b[:, j]]
    return m


def train(docs: DataFrame, labels: DataFrame, *, each: int = SAMPLE) -> Model:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(matrix(batch.column(0))), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    rows = sample(docs, labels, "quality", folds=5, held=0, each=each).select("text", "label").mapInArrow(run, "x array<double>, label int").collect()
    return fit(np.array([r.x for r in rows]), np.array([r.label for r in rows], dtype=float)) if rows else Model()


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(matrix(batch.column(1))))], ["doc_id", "score"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = body.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, that score at least the threshold; one scan scores and filters."""
    model, names = train(docs, labels), docs.columns

    def run(batches):
        for batch in batches:
            keep = model.score(matrix(batch.column("text"))) >= threshold
            yield batch.filter(pa.array(keep)).select(names)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
