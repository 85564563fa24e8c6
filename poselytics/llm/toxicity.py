"""Toxicity classifier: non-negative positive-unlabelled learning.

It is trained from confirmed toxic documents (positives) and from documents without
regard to their label (unlabelled). With the class prior p, the risk of a scorer is
estimated as

    p * loss of positives as toxic + max(0, loss of unlabelled as clean - p * loss of positives as clean)

The bracket estimates the loss of the unseen clean documents. It cannot be negative in truth, so
where it is, the step goes the other way, which undoes what was overfitted.

The scorer is linear over the words of a text, each counted once and hashed to one of
``BUCKETS``; of these only those enter whose share among positives differs from that among unlabelled ones
by several standard errors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.llm.common import keep, text_of, without

#: Documents of each kind, positive and unlabelled, beyond which a model is fitted on a sample of about so many.
MAX_POSITIVE = 20_000
MAX_UNLABELLED = 20_000
HASHES = 1 << 40
BUCKETS = 1 << 20
#: Most words a model knows, and by how many standard errors their shares must differ.
MAX_WORDS = 8_192
LEAST_ERRORS = 3.0
STEPS = 300
RATE = 0.05
PENALTY = 2e-4
THRESHOLD = 0.3
#: Words whose places one worker remembers; past that it forgets all.
MEMORY = 1_000_000

_words = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> set[str]:
    """Different words of a text in lower case."""
    return set(_words((text or "").lower()))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


@dataclass
class Model:
    """Hash buckets in ascending order, the weight of each, and the log odds of a text without any."""

    buckets: np.ndarray
    weights: np.ndarray
    base: float
    at: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.at = {int(b): k for k, b in enumerate(self.buckets)}

    def places(self, texts: list[str | None], memory: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of every known bucket in each text, each once a text."""
        rows, found = [], []
        for row, text in enumerate(texts):
            seen = set()
            for word in words_of(text):
                place = memory.get(word)
                if place is None:
                    place = memory[word] = self.at.get(bucket(word), -1)
                if place >= 0:
                    seen.add(place)
            rows += [row] * len(seen)
            found += sorted(seen)
        if len(memory) > MEMORY:
            memory.clear()
        return np.array(rows, dtype=np.int64), np.array(found, dtype=np.int64)

    def score(self, texts: list[str | None], memory: dict[str, int] | None = None) -> np.ndarray:
        rows, places = self.places(texts, {} if memory is None else memory)
        return _sigmoid(self.base + np.bincount(rows, self.weights[places], len(texts)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Sparse rows of ones: place by place, and the row that each is in."""

    n: int
    row: np.ndarray
    place: np.ndarray

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.place], self.n)

    def back(self, per_row: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.place, per_row[self.row], width)


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic risk of the positive part, and the estimate for the clean part, which may come out negative."""
    as_clean = lambda s: float(np.logaddexp(0, s).mean())
    return prior * float(np.logaddexp(0, -positive).mean()), as_clean(unlabelled) - prior * as_clean(positive)


def fit(
    positive: Rows,
    unlabelled: Rows,
    prior: float,
    width: int,
    *,
    steps: int = STEPS,
    rate: float = RATE,
    penalty: float = PENALTY,
) -> tuple[np.ndarray, float]:
    """Weights and base of the least non-negative risk, by full gradient steps of adaptive size.

    Without positives or unlabelled rows there is nothing to learn: no weights, and the prior as base.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    weights, base = np.zeros(width), float(np.log(prior / (1 - prior)))
    if not positive.n or not unlabelled.n:
        return weights, base
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p, u = base + positive.dot(weights), base + unlabelled.dot(weights)
        clean_u = _sigmoid(u) / unlabelled.n
        clean_p = -prior * _sigmoid(p) / positive.n
        if risk(p, u, prior)[1] >= 0:
            per_p, per_u = clean_p - prior * _sigmoid(-p) / positive.n, clean_u
        else:
            per_p, per_u = -clean_p, -clean_u
        slope = np.append(
            positive.back(per_p, width) + unlabelled.back(per_u, width) + penalty * weights, per_p.sum() + per_u.sum()
        )
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, base = weights - move[:-1], base - float(move[-1])
    return weights, base


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def _chosen(ids: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the ids, all if they are no more: those whose hash lies in that share of the hash range."""
    n = ids.count()
    share = int(min(1.0, most / max(n, 1)) * HASHES)
    return ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < share)


def sample(docs: DataFrame, labels: DataFrame, *, label: str, most_positive: int, most_unlabelled: int) -> DataFrame:
    """y and text of the documents to learn from: 1 confirmed toxic, 0 unlabelled; a document may be in both.

    Of several texts of one id the smallest is taken. Only ids are joined at full size; texts are read for
    the chosen ones alone, whose number is bounded, so they may be broadcast.
    """
    open_ids = docs.where(~held_out(F.col("doc_id"))).select("doc_id").groupBy("doc_id").count().select("doc_id")
    toxic = labels.where((F.col(label) == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    chosen = _chosen(open_ids.join(toxic, "doc_id", "left_semi"), most_positive).withColumn("y", F.lit(1))
    chosen = keep(chosen.union(_chosen(open_ids, most_unlabelled).withColumn("y", F.lit(0))), "pu-ids")
    found = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")
    return keep(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text"), "pu-texts")


def class_prior(labels: DataFrame, label: str) -> float:
    """Share of toxic ones among the labelled ids that may be learnt from; one half without any."""
    usable = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    row = usable.groupBy("doc_id").agg(F.max(label).alias("y")).agg(F.avg("y").alias("p")).first()
    return 0.5 if row["p"] is None else float(row["p"])


def _bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket, positives and unlabelled texts that have a word of it; the bucket -1 counts all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {BUCKETS}
                for word in words_of(text):
                    place = known.get(word)
                    if place is None:
                        place = known[word] = bucket(word)
                    found.add(place)
                counts[y, list(found)] += 1
            if len(known) > MEMORY:
                known.clear()
        used = np.flatnonzero(counts.sum(axis=0))
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            names = np.where(part == BUCKETS, -1, part)
            columns = [pa.array(names), pa.array(counts[1, part]), pa.array(counts[0, part])]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "p", "u"])

    parts = rows.mapInArrow(count, "bucket long, p long, u long")
    return parts.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "toxic",
    most_positive: int = MAX_POSITIVE,
    most_unlabelled: int = MAX_UNLABELLED,
    prior: float | None = None,
) -> Model:
    """Fit on bounded samples of the rows that are not held out; ``prior`` defaults to ``class_prior``.

    Without confirmed toxic documents, or without documents, every score is the prior.
    """
    prior = class_prior(labels, label) if prior is None else prior
    rows = sample(docs, labels, label=label, most_positive=most_positive, most_unlabelled=most_unlabelled)
    counts = keep(_bucket_counts(rows), "pu-buckets")
    sizes = counts.where("bucket = -1").first()
    if sizes is None or not sizes["p"] or not sizes["u"]:
        weights, base = fit(Rows(0, *_nothing()), Rows(0, *_nothing()), prior, 0)
        return Model(np.zeros(0, dtype=np.int64), weights, base)
    p, u = float(sizes["p"]), float(sizes["u"])
    share = F.col("u") / u
    errors = (F.col("p") / p - share) / F.sqrt(share * (1 - share) / p + 0.25 / (p * p))
    ranked = counts.where("bucket >= 0 and p >= 2").withColumn("errors", F.abs(errors)).where(F.col("errors") > LEAST_ERRORS)
    best = ranked.orderBy(F.desc("errors"), "bucket").limit(MAX_WORDS).select("bucket").toPandas()
    model = Model(np.sort(best["bucket"].to_numpy(dtype=np.int64)), np.zeros(len(best)), 0.0)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            row, found = sent.value.places(batch.column(1).to_pylist(), memory)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["y", "places"])

    found = rows.mapInArrow(place, "y int, places array<int>").toPandas()  # bounded by the sample and MAX_WORDS
    kinds = []
    for y in (1, 0):
        lists = found.loc[found["y"] == y, "places"].tolist()
        sizes_of = [len(x) for x in lists]
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]) if lists else np.zeros(0, dtype=np.int64)
        kinds.append(Rows(len(lists), np.repeat(np.arange(len(lists)), sizes_of), flat))
    model.weights, model.base = fit(kinds[0], kinds[1], prior, len(best))
    return model


def _nothing() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)


def classify(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with held_out, score and predicted; columns of these names are replaced, others stay.

    A null text is an empty one and scores like any text without a known word. Repeated rows score alike,
    a null id is held out, and an empty table gives an empty one.
    """
    base = without(docs, "held_out", "score", "predicted")
    sent = base.sparkSession.sparkContext.broadcast(model)
    text_at = [c.lower() for c in base.columns].index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    names = [*base.columns, "score", "predicted"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            score = sent.value.score(batch.column(text_at).to_pylist(), memory)
            chosen = (score >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(chosen)], names=names)

    found = base.mapInArrow(rate, f"{schema}, score double, predicted int")
    return found.withColumn("held_out", held_out(F.col("doc_id")))
