"""Quality classifier: a generalised additive model with pairwise interactions.

Every whole text becomes a short vector of counts and rates (no id, language, source or label). Each feature is cut into bins; a model is one
lookup table for each feature and one for each chosen pair of features. Tables are learned by boosting: in turn, each feature gets a shallow
tree (a few cuts of its bins) fitted to what the sum so far leaves, and adds a small part of it to its table; then the pairs that explain most of what
is left get tables of their own in the same way. A score is the sum of the looked-up numbers, through the logistic function.

Labels are learned on the driver from at most `most_rows` labelled rows, chosen by a hash of the id; the model is a few thousand numbers. Scoring is
one pass over the texts without a shuffle.

Defined results: a null or empty text has a vector of zeros and is scored as any other; rows that are repeated get equal scores; with no labelled row
the score is 0.5 for all; with labels of one kind only it is near that label; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import load

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "bars", "marks", "commas", "full_stops", "high_bytes", "letters",
    "line_words", "distinct_words", "distinct_lines", "same_next", "long_words", "short_words", "top_word", "blanks",
]

#: Classes of bytes that are counted.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "symbols": b"#*$%&<>{}[]\\^~_=+@", "bars": b"|", "marks": b"!?", "commas": b",;:", "full_stops": b".",
    "high_bytes": bytes(range(128, 256)), "letters": b"abcdefghijklmnopqrstuvwxyz", "blanks": b" \t\n\x0b\x0c\r",
}


def vector(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n, m = max(len(raw), 1), max(len(words), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    rate = {name: float(counts[list(chars)].sum()) / n for name, chars in CLASSES.items()}
    lines = [x for x in raw.split(b"\n") if x]
    sizes = list(map(len, words))
    times = Counter(words)
    same = sum(map(bytes.__eq__, words[1:], words)) if words else 0
    most = max(times.values(), default=0)
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(sizes) / m, rate["upper"], rate["digits"], rate["symbols"], rate["bars"], rate["marks"], rate["commas"], rate["full_stops"],
        rate["high_bytes"], rate["letters"], len(words) / max(len(lines), 1), len(times) / m, len(set(lines)) / max(len(lines), 1), same / m,
        sum(s > 12 for s in sizes) / m, sum(s < 4 for s in sizes) / m, most / m, rate["blanks"],
    ]


@dataclass
class Model:
    """Lookup tables over bins. cuts[f]: edges of a feature's bins; pairs: (feature, feature, table)."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[b[:, f]]
        for f, g, table in self.pairs:
            total += table[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Where to cut bins with gradient sums g and curvature sums h in two, and the gain."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Step for each bin, of the tree that cuts greedily up to `leaves` runs of bins."""
    runs = [(0, len(g))]
    while len(runs) < leaves:
        found = [(*best_cut(g[a:b], h[a:b], ridge), a, b) for a, b in runs if b - a > 1]
        gain, k, a, b = max(found, default=(0.0, 0, 0, 0))
        if gain <= 1e-9:
            break
        runs.remove((a, b))
        runs += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Step for each cell of a grid, of the best tree that cuts one feature and then the other on either side; both cuts are sought at once, as an interaction
    need not show in the first alone."""
    best, out = -1.0, np.zeros_like(g)
    worth = lambda a, b: float(a.sum() ** 2 / (b.sum() + ridge))
    for axis in (0, 1):
        gs, hs = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, len(gs)):
            gain, leaves = 0.0, []
            for side in (slice(0, k), slice(k, len(gs))):
                more, cut = best_cut(gs[side].sum(axis=0), hs[side].sum(axis=0), ridge)
                gain += more + worth(gs[side], hs[side])
                leaves += [(side, slice(0, cut)), (side, slice(cut, None))]
            if gain > best:
                best, step = gain, np.zeros_like(gs)
                for leaf in leaves:
                    step[leaf] = gs[leaf].sum() / (hs[leaf].sum() + ridge)
                out = step if axis == 0 else step.T
    return out


def fit(x: np.ndarray, y: np.ndarray, most_bins: int = 64, rounds: int = 150, rate: float = 0.15, leaves: int = 3, pairs: int = 6, pair_bins: int = 8, ridge: float = 2.0) -> Model:
    """Cyclic boosting of the features' tables by shallow trees, then of the tables of the strongest pairs, by trees over both features."""
    model = Model()
    if not len(y):
        return model
    p = min(max(float(y.mean()), 0.01), 0.99)
    model.base = math.log(p / (1 - p))
    model.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, most_bins + 1)[1:-1])) for f in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)

    def left() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = left()
            step = rate * tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)), leaves, ridge)
            table += step
            total += step[b[:, f]]
    # coarse grids of two features, by what their cells explain of the rest
    coarse = [np.minimum(b[:, f] * pair_bins // len(t), pair_bins - 1) for f, t in enumerate(model.tables)]
    g, h = left()
    cells = lambda f, k, v: np.bincount(coarse[f] * pair_bins + coarse[k], v, pair_bins**2)
    strength = sorted(((float((cells(f, k, g) ** 2 / (cells(f, k, h) + ridge)).sum()), f, k) for f, k in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    chosen = [(f, k, np.zeros(pair_bins**2)) for _, f, k in strength[:pairs]]
    grid = (pair_bins, pair_bins)
    for _ in range(rounds // 2):
        for f, k, table in chosen:
            g, h = left()
            step = rate * pair_tree(cells(f, k, g).reshape(grid), cells(f, k, h).reshape(grid), 4 * ridge).ravel()
            table += step
            total += step[coarse[f] * pair_bins + coarse[k]]
    for f, k, table in chosen:
        of = [np.minimum(np.arange(len(model.tables[i])) * pair_bins // len(model.tables[i]), pair_bins - 1) for i in (f, k)]
        model.pairs.append((f, k, table.reshape(grid)[np.ix_(*of)]))
    return model


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x)"""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([vector(t.as_py()) for t in part.column(1)], pa.list_(pa.float64()))], names=["id", "x"])

    return docs.select(id_col, text_col).mapInArrow(make, f"id {docs.schema[id_col].dataType.simpleString()}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", most_rows: int = 10_000) -> Model:
    """A model from at most most_rows rows of labels, the first by a hash of the id. Null labels and ids are left out."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col, "label").limit(most_rows)
    known = {row[0]: row[1] for row in chosen.collect()}  # at most most_rows
    if not known:
        return Model()
    held = docs.where(F.col(id_col).isin(list(known))) if len(known) <= 200 else docs.join(F.broadcast(chosen.select(id_col)), id_col, "left_semi")
    rows = vectors(held, id_col, text_col).orderBy("id").collect()
    x = np.array([r["x"] for r in rows if r["id"] in known]).reshape(-1, len(FEATURES))
    return fit(x, np.array([known[r["id"]] for r in rows if r["id"] in known], float))


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score)"""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            x = np.array([vector(t.as_py()) for t in part.column(1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(x))], names=["id", "score"])

    return docs.select(id_col, text_col).mapInArrow(make, f"id {docs.schema[id_col].dataType.simpleString()}, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs, load(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
