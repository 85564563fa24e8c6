"""Benchmark decontamination by word n-grams.

The benchmark's windows go to every worker as a hash set if they take no more than a
checked number of bytes; documents are then read once and not shuffled. A larger benchmark
stays a table: windows of documents that pass a bitmap of fixed size are joined
with it by their words, and only what was hit comes back to the texts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Literal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poselytics.llm.common import BROADCAST_BYTES, free_name, keep, lower_ascii, row_key, text_of, without

WINDOW = 10
#: Bits of the bitmap of a benchmark that is too large for a hash set: 32 MB, whatever its size.
SLOTS = 1 << 28

#: Bytes that are no part of a word: all of ASCII but digits and letters.
_NO_WORD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().translate(_NO_WORD).split()


@dataclass
class Windows:
    """Every window of a set of items, exactly: vocabulary, and the windows as id strings."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, dict[bytes, list[str]]] = field(default_factory=lambda: defaultdict(dict))

    def add(self, item: str, text: str | None, window: int) -> None:
        words = words_of(text)
        if not words:
            return
        known = self.vocabulary
        ids = np.array([known.setdefault(w, len(known) + 1) for w in words], dtype="<i4")
        size = min(window, len(words))
        for at in range(len(words) - size + 1):
            items = self.windows[size].setdefault(ids[at : at + size].tobytes(), [])
            if not items or items[-1] != item:
                items.append(item)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items of those windows."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], dtype="<i4")
        hit = np.zeros(len(words), dtype=bool)
        items: set[str] = set()
        # words outside the vocabulary up to each place
        foreign = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, windows in self.windows.items():
            if size > len(words):
                continue
            for at in np.flatnonzero(foreign[size:] == foreign[:-size]).tolist():
                found = windows.get(ids[at : at + size].tobytes())
                if found:
                    hit[at : at + size] = True
                    items.update(found)
        return hit, items


def _bytes(items: DataFrame) -> int:
    """About what the windows of ``items`` take in a worker: some 100 bytes each, 20 times a word."""
    return items.agg((F.sum(F.length("text")) * 20).alias("n")).first()["n"] or 0


def _load(items: DataFrame, window: int) -> Windows:
    found = Windows()
    for row in items.orderBy("item").toLocalIterator():
        found.add(row["item"] or "", row["text"], window)
    return found


def grams(words: list[bytes], size: int) -> list[bytes]:
    """Every run of ``size`` words, joined by spaces; words hold none."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)]


def _slot(gram: bytes) -> int:
    return xxhash.xxh3_64_intdigest(gram) % SLOTS


def _windows(items: DataFrame, window: int) -> DataFrame:
    """item, gram, size, slot of every window, once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found, sizes = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                unique = set(grams(words, size)) if words else set()
                names += [item or ""] * len(unique)
                sizes += [size] * len(unique)
                found += unique
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(found, pa.binary()),
                    pa.array(sizes, pa.int32()),
                    pa.array([_slot(g) for g in found], pa.int64()),
                ],
                names=["item", "gram", "size", "slot"],
            )

    return keep(items.mapInArrow(cut, "item string, gram binary, size int, slot long").distinct(), "windows")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """A bit for each slot that some window has."""
    # Spark numbers the bits of a bucket from 1 on
    place = F.col("slot") + 1
    buckets = windows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    found = np.zeros(SLOTS // 8, dtype=np.uint8)
    for row in buckets.toLocalIterator():
        bits = np.frombuffer(row["bits"], dtype=np.uint8)
        at = (row["bucket"] - 1) * 4096
        found[at : at + len(bits)] = bits
    return found


def _joined(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """row, places (at, size), items of every text of ``texts`` (row, text) in which a window stands.

    Equal texts share a row. A window that many texts hold is dealt by Spark's splitting of skewed joins; lists
    are as long as a text has windows, or items that it holds.
    """
    spark: SparkSession = texts.sparkSession
    # no more rows than a window has words
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(windows))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, lengths, found = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for size in sizes:
                    if size > len(words):
                        break
                    all_grams = grams(words, size)
                    slots = np.array([_slot(g) for g in all_grams], dtype=np.int64)
                    for at in np.flatnonzero((bitmap.value[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).tolist():
                        rows.append(row)
                        places.append(at)
                        lengths.append(size)
                        found.append(all_grams[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), pa.array(places, pa.int32()), pa.array(lengths, pa.int32()), pa.array(found, pa.binary())],
                names=["row", "at", "size", "gram"],
            )

    probes = keep(texts.mapInArrow(probe, "row binary, at int, size int, gram binary"), "probes")
    places = (
        probes.join(windows.select("gram").distinct(), "gram", "left_semi")
        .groupBy("row")
        .agg(F.collect_set(F.struct("at", "size")).alias("places"))
    )
    items = (
        probes.select("row", "gram").distinct().join(windows.select("gram", "item"), "gram").groupBy("row").agg(F.collect_set("item").alias("items"))
    )
    return keep(places.join(items, "row"), "hits")


_ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"]
_ADDED_DDL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<start:int,stop:int>>"


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    item: str = "item_id",
    window: int = WINDOW,
    limit: int = BROADCAST_BYTES,
    remove: Literal["spans"] | None = None,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and hits.

    A window is ``window`` consecutive words of an item, or all of a shorter one;
    a word of a document is hit if it lies in any occurrence of any window.
    ``hits`` lists the hit runs as [first word, end). With ``remove="spans"``, text
    loses the hit words. Columns of these names in ``docs`` are replaced, all others
    stay; a null or empty text has no words and no hits; an empty benchmark hits nothing, and
    an empty table of documents gives an empty one.

    Windows of more than ``limit`` bytes are joined, not sent; the rows are the same. Texts then move once, to their hits.
    """
    base = without(docs, *_ADDED)
    items = benchmark.select(F.col(item).cast("string").alias("item"), text_of(benchmark).alias("text"))
    text_at = [c.lower() for c in base.columns].index("text")
    names = [*base.columns, *_ADDED]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), _ADDED_DDL])
    n_base = len(base.columns)
    if _bytes(items) <= limit:
        known = docs.sparkSession.sparkContext.broadcast(_load(items, window))
        source = base
    else:
        known = None
        row, places, named = (free_name(base, f"__{c}") for c in ("row", "places", "items"))
        keyed = base.withColumn(row, row_key(text_of(base)))
        texts = base.select(row_key(text_of(base)).alias("row"), text_of(base).alias("text"))
        found = _joined(texts, _windows(items, window))
        found = found.select(F.col("row").alias(row), F.col("places").alias(places), F.col("items").alias(named))
        source = keyed.join(found, row, "left").select(*[F.col(f"`{c}`") for c in base.columns], places, named)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in _ADDED}
            texts = batch.column(text_at).to_pylist()
            for k, text in enumerate(texts):
                words = words_of(text)
                if known is not None:
                    hit, found = known.value.find(words)
                else:
                    hit, found = np.zeros(len(words), dtype=bool), batch.column(n_base + 1)[k].as_py() or []
                    for place in batch.column(n_base)[k].as_py() or []:
                        hit[place["at"] : place["at"] + place["size"]] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                runs = edges.reshape(-1, 2).tolist()
                out["n_words"].append(len(words))
                out["n_hit"].append(int(hit.sum()))
                out["n_items"].append(len(found))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
                out["contaminated"].append(bool(runs))
                out["hits"].append([{"start": a, "stop": b} for a, b in runs])
                if remove and runs:
                    texts[k] = drop_words(text, runs)
            columns = [batch.column(i) for i in range(n_base)]
            if remove:
                columns[text_at] = pa.array(texts, pa.string())
            columns += [
                pa.array(out["n_words"], pa.int64()),
                pa.array(out["n_hit"], pa.int64()),
                pa.array(out["n_items"], pa.int64()),
                pa.array(out["items_sha256"], pa.string()),
                pa.array(out["contaminated"], pa.bool_()),
                pa.array(out["hits"], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(mark, schema)


def drop_words(text: str, runs: list[list[int]]) -> str:
    """``text`` without its words in ``runs`` and what stands between them."""
    import re

    spots = [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower_ascii(text))]
    kept, at = [], 0
    for start, stop in runs:
        kept.append(text[at : spots[start][0]])
        at = spots[stop - 1][1]
    return "".join([*kept, text[at:]])
