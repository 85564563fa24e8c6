"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature at a time; what they add up to is
a table per feature, a value for each of its bins. The pairs of features
that explain most of what is left get a table each in the same way. A score is a sum of
looked-up values. Features come from the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.llm.common import text_of, without

#: Most labelled rows a model is fitted on.
MAX_ROWS = 20_000
BINS = 64
PAIR_BINS = 12
PAIRS = 10
ROUNDS = 120
RATE = 0.15
THRESHOLD = 0.3

FEATURES = [
    "log_chars",
    "log_words",
    "word_length",
    "long_words",
    "short_words",
    "upper",
    "digits",
    "symbols",
    "marks",
    "stops",
    "other",
    "distinct_words",
    "top_word",
    "log_lines",
    "line_words",
    "repeated_lines",
    "ended_lines",
    "capital_words",
    "plain_words",
    "repeated_runs",
]
_KINDS = np.zeros(256, dtype=np.uint8)
for _byte in range(256):
    _char = chr(_byte)
    _KINDS[_byte] = (
        1 if _byte < 128 and _char.isupper()
        else 2 if _byte < 128 and _char.islower()
        else 3 if _byte < 128 and _char.isdigit()
        else 4 if _char in "#*$%&|<>!@^~=_+\\{}[]/"
        else 5 if _char in ",;:'\"()-"
        else 6 if _char in ".?"
        else 7 if _char in " \t\n\x0b\x0c\r"
        else 8 if _byte >= 128
        else 9
    )
_PLAIN = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+[.,]?")


def features(text: str | None) -> list[float]:
    """One number for each of ``FEATURES``; all defined for an empty text."""
    data = (text or "").encode("utf-8", "replace")
    kinds = np.bincount(_KINDS[np.frombuffer(data, dtype=np.uint8)], minlength=10).tolist()
    size = max(1, len(data))
    words = data.split()
    n = len(words)
    some = max(1, n)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    plain = sum(c for w, c in counts.items() if _PLAIN.fullmatch(w))
    capital = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    windows = set(zip(words, words[1:], words[2:], strict=False))
    return [
        float(np.log1p(len(data))),
        float(np.log1p(n)),
        float(lengths.mean()) if n else 0.0,
        float((lengths > 12).mean()) if n else 0.0,
        float((lengths < 4).mean()) if n else 0.0,
        kinds[1] / size,
        kinds[3] / size,
        kinds[4] / size,
        kinds[5] / size,
        kinds[6] / size,
        (kinds[8] + kinds[9]) / size,
        len(counts) / some,
        max(counts.values(), default=0) / some,
        float(np.log1p(len(lines))),
        n / n_lines,
        1 - len(set(lines)) / n_lines if lines else 0.0,
        sum(x.rstrip().endswith((b".", b"?", b"!")) for x in lines) / n_lines,
        capital / some,
        plain / some,
        1 - len(windows) / (n - 2) if n > 2 else 0.0,
    ]


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two."""
    least = min(least, 0.02 * float(h.sum()))  # where little is left to learn
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(hl < least) | (hr < least)] = -1
    if not len(gain):
        return -1.0, 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 1.0) -> np.ndarray:
    """Value of each bin by a tree of ``depth`` cuts."""
    value = np.full(len(g), g.sum() / (h.sum() + 1))
    gain, at = _best_cut(g, h, least) if depth and len(g) > 1 else (-1.0, 0)
    if gain <= 0:
        return value
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, least), _tree(g[at:], h[at:], depth - 1, least)])


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one axis and then both halves on the other."""
    best, values = -1.0, np.zeros_like(g)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for axis in (0, 1):
        gain, at = _best_cut(g.sum(axis=1 - axis), h.sum(axis=1 - axis), least)
        if gain <= 0:
            continue
        made = np.zeros_like(g)
        total = -whole
        for part in (slice(0, at), slice(at, None)):
            here = (part, slice(None)) if axis == 0 else (slice(None), part)
            gs, hs = g[here].sum(axis=axis), h[here].sum(axis=axis)
            leaves = _tree(gs, hs, 1, least)
            made[here] = leaves[None, :] if axis == 0 else leaves[:, None]
            total += float((2 * leaves * gs - leaves**2 * (hs)).sum())
        if total > best:
            best, values = total, made
    return best, values


@dataclass
class Model:
    """Bin edges, a table per feature and tables of pairs; scores are log odds."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]  # pair bin of each bin
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for k, values in enumerate(self.tables):
            total += values[bins[:, k]]
        for i, j, values in self.pairs:
            total += values[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Model:
    """Boost the tables in turn. Without rows the score is one half, with one class near it."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for k in range(width)]
    sizes = [len(e) + 1 for e in edges]
    coarse = [(np.arange(s) * min(PAIR_BINS, s)) // s for s in sizes]
    positive = float(y.sum())
    model = Model(edges, coarse, float(np.log((positive + 0.5) / (n - positive + 0.5))), [np.zeros(s) for s in sizes], [])
    if not n:
        return model
    bins = model.bins(x)
    total = np.full(n, model.base)
    for _ in range(rounds):
        for k in range(width):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(bins[:, k], weights=y - p, minlength=sizes[k])
            h = np.bincount(bins[:, k], weights=p * (1 - p), minlength=sizes[k])
            step = rate * _tree(g, h)
            model.tables[k] += step
            total += step[bins[:, k]]
    rough = [coarse[k][bins[:, k]] for k in range(width)]
    wide = [min(PAIR_BINS, s) for s in sizes]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        cell = rough[i] * wide[j] + rough[j]
        shape, length = (wide[i], wide[j]), wide[i] * wide[j]
        g = np.bincount(cell, weights=y - p, minlength=length).reshape(shape)
        return cell, g, np.bincount(cell, weights=p * (1 - p), minlength=length).reshape(shape)

    ranked = sorted(
        ((_pair_tree(*sums(i, j)[1:])[0], i, j) for i in range(width) for j in range(i)), key=lambda t: (-t[0], t[1:])
    )
    model.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for gain, i, j in ranked[:pairs] if gain > 0]
    for _ in range(rounds // 2):
        for i, j, values in model.pairs:
            cell, g, h = sums(i, j)
            step = rate * _pair_tree(g, h)[1]
            values += step
            total += step.ravel()[cell]
    return model


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _features(docs: DataFrame, *others: str) -> DataFrame:
    """``others`` and the list of features of each row."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select(*others, text_of(docs).alias("text"))
    names = [*others, "x"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=names)

    return rows.mapInArrow(read, "".join(f"`{o}` {kinds[o]}, " for o in others) + "x array<double>")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows of ``docs`` that are not held out, chosen by hash.

    Labels other than 0 and 1 are ignored; of several for one id the highest counts.
    """
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # bounded by max_rows, so it is safe to broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = joined.withColumn("order", F.xxhash64("doc_id", "text")).orderBy("order", "doc_id").limit(max_rows)
    found = _features(rows, "y").toPandas() if not chosen.isEmpty() else None
    if found is None or not len(found):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(found["x"].tolist()), found["y"].to_numpy(dtype=float))


def classify(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted; columns of these names are replaced, others stay."""
    base = without(docs, "held_out", "score", "predicted")
    sent = base.sparkSession.sparkContext.broadcast(model)
    text_at = [c.lower() for c in base.columns].index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    names = [*base.columns, "score", "predicted"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(text_at).to_pylist()]).reshape(-1, len(FEATURES))
            score = sent.value.score(x)
            chosen = (score >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(chosen)], names=names)

    found = base.mapInArrow(rate, f"{schema}, score double, predicted int")
    return found.withColumn("held_out", held_out(F.col("doc_id")))
