"""Line de-duplication that can be taken back.

An exact table counts for every line key the documents that have it. Documents
are added to and deleted from it in batches. Keys at or over the limit stand in
cuckoo filters, one per shard of the key space, which take insertions and
deletions; since the table knows every key, the few other keys that a filter
mistakes for its own are known too and kept as exceptions. Filter and exceptions
together answer exactly, at two bytes a key, so they are small enough to go to all workers; where
a size check says otherwise, lines are joined with the table instead.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.llm.common import BROADCAST_BYTES, keep, row_key, text_of, without

#: Documents that must share a line for it to go.
MIN_DOCS = 10
#: Keys in one filter, on average.
SHARD_KEYS = 50_000
_SLOTS = 4
_MASK = (1 << 64) - 1


def keys_of(text: str | None, min_chars: int = 1) -> list[bytes]:
    """The key of each line: 16 bytes, or none for a line that is too short to count."""
    keys = []
    for line in (text or "").encode("utf-8", "replace").split(b"\n"):
        line = line.strip().lower()
        long = len(line) >= 4 * min_chars or len(line.decode()) >= min_chars
        keys.append(xxhash.xxh3_128_digest(line) if long else b"")
    return keys


class CuckooFilter:
    """Set of 16-byte keys in buckets of four 16-bit fingerprints; an overfull filter grows.

    Keys are those of one shard and arrive at most once, as the table counts them.
    """

    def __init__(self, capacity: int) -> None:
        self._log = max(2, int(np.ceil(np.log2(max(capacity, 1) / (_SLOTS * 0.85)))))
        self.table = np.zeros((1 << self._log, _SLOTS), dtype=np.uint16)

    @staticmethod
    def parts(keys: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys given as (n, 2) uint64."""
        prints = (keys[:, 0] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        mask = np.uint64((1 << log) - 1)
        first = (keys[:, 1] & mask).astype(np.int64)
        return prints, first, first ^ CuckooFilter.step(prints, log)

    @staticmethod
    def step(prints: np.ndarray, log: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - log)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self.parts(keys, self._log)
        wanted = prints[:, None]
        return (self.table[first] == wanted).any(axis=1) | (self.table[second] == wanted).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no room; the filter must then be built anew, larger."""
        prints, first, second = self.parts(keys, self._log)
        table = self.table
        for mark, a, b in zip(prints.tolist(), first.tolist(), second.tolist(), strict=True):
            for bucket in (a, b):
                free = np.flatnonzero(table[bucket] == 0)
                if len(free):
                    table[bucket, free[0]] = mark
                    break
            else:
                bucket = b
                for turn in range(500):
                    slot = (turn * 7 + mark) % _SLOTS
                    mark, table[bucket, slot] = int(table[bucket, slot]), mark
                    bucket ^= int(self.step(np.array([mark]), self._log)[0])
                    free = np.flatnonzero(table[bucket] == 0)
                    if len(free):
                        table[bucket, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are in the filter."""
        prints, first, second = self.parts(keys, self._log)
        for mark, a, b in zip(prints.tolist(), first.tolist(), second.tolist(), strict=True):
            for bucket in (a, b):
                found = np.flatnonzero(self.table[bucket] == mark)
                if len(found):
                    self.table[bucket, found[0]] = 0
                    break
            else:
                raise KeyError("a key to delete is not in the filter")

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, _SLOTS).copy()
        made._log = len(made.table).bit_length() - 1
        return made

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = len(keys)
        while not (made := cls(capacity)).insert(keys):
            capacity = max(8, 2 * capacity)
        return made


def _array(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    # bits that neither fingerprint nor bucket use
    return ((keys[:, 1] >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def count_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """key, n: in how many documents (rows) of ``docs`` each line stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(set(keys_of(text, min_chars)))
            seen.pop(b"", None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"]
            )

    found = docs.select(text_of(docs).alias("text")).mapInArrow(count, "key binary, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class LineIndex:
    """References of every line, and the filters over those that many documents share."""

    refs: DataFrame  # key, n
    filters: DataFrame  # shard, data
    shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = 1

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = 1) -> LineIndex:
        refs = keep(count_lines(docs, min_chars), "line-refs")
        common = refs.where(F.col("n") >= min_docs)
        shards = max(1, -(-common.count() // SHARD_KEYS))
        return cls(refs, keep(_filters(common, shards), "line-filters"), shards, min_docs, min_chars)

    def add(self, docs: DataFrame) -> LineIndex:
        """The index with more documents."""
        return self._change(count_lines(docs, self.min_chars))

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without documents that were added before."""
        return self._change(count_lines(docs, self.min_chars).withColumn("n", -F.col("n")))

    def _change(self, batch: DataFrame) -> LineIndex:
        both = self.refs.withColumn("d", F.lit(0).cast("long")).union(
            batch.select("key", F.lit(0).cast("long").alias("n"), F.col("n").alias("d"))
        )
        changed = keep(both.groupBy("key").agg(F.sum("n").alias("before"), F.sum("d").alias("d")), "line-changes")
        after = changed.withColumn("n", F.col("before") + F.col("d"))
        refs = keep(after.where("n > 0").select("key", "n"), "line-refs")
        was, now = F.col("before") >= self.min_docs, F.col("n") >= self.min_docs
        crossed = after.where(was != now).select("key", now.alias("enters"))
        shards = self.shards
        sharded = crossed.mapInArrow(_sharded(shards), "key binary, shard long, enters boolean")

        def change(old: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.from_bytes(old["data"].iloc[0]) if len(old) else None
            shard = (old if len(old) else moves)["shard"].iloc[0]
            if len(moves):
                leaving, entering = moves[~moves["enters"]]["key"].tolist(), moves[moves["enters"]]["key"].tolist()
                made = made or CuckooFilter(len(entering))
                if leaving:
                    made.delete(_array(leaving))
                if entering and not made.insert(_array(entering)):
                    return pd.DataFrame({"shard": [shard], "data": [None]})
            return pd.DataFrame({"shard": [shard], "data": [made.to_bytes()]})

        changed_filters = keep(
            self.filters.groupBy("shard")
            .cogroup(sharded.groupBy("shard"))
            .applyInPandas(change, "shard long, data binary"),
            "line-filters",
        )
        index = LineIndex(refs, changed_filters, shards, self.min_docs, self.min_chars)
        full = changed_filters.where(F.col("data").isNull()).select("shard")
        if full.isEmpty():
            return index
        # an overfull filter is built anew from the table
        again = _filters(refs.where(F.col("n") >= self.min_docs), shards).join(full, "shard", "left_semi")
        index.filters = keep(changed_filters.where(F.col("data").isNotNull()).union(again), "line-filters")
        return index

    def _loaded(self) -> tuple[dict[int, bytes], frozenset[bytes]] | None:
        """Filters and exceptions, or none if they are too large for every worker."""
        spark = self.refs.sparkSession
        size = self.filters.agg(F.sum(F.length("data")).alias("n")).first()["n"] or 0
        if size > BROADCAST_BYTES:
            return None
        filters = {row["shard"]: bytes(row["data"]) for row in self.filters.collect()}
        sent, shards = spark.sparkContext.broadcast(filters), self.shards

        def mistaken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = _Probe(sent.value, frozenset(), shards)
            for batch in batches:
                keys = batch.column(0).to_pylist()
                wrong = [k for k, hit in zip(keys, probe(keys), strict=True) if hit]
                yield pa.RecordBatch.from_arrays([pa.array(wrong, pa.binary())], names=["key"])

        rare = self.refs.where(F.col("n") < self.min_docs).select("key")
        wrong = keep(rare.mapInArrow(mistaken, "key binary"), "line-exceptions")
        if wrong.count() * 100 > BROADCAST_BYTES:
            return None
        return filters, frozenset(bytes(row["key"]) for row in wrong.collect())

    def apply(self, docs: DataFrame) -> DataFrame:
        """``docs`` without the shared lines; adds n_lines and n_dropped.

        ``docs`` must be documents of this index. A null text is one empty line, which stays;
        columns named n_lines or n_dropped are replaced, others stay.
        """
        loaded = self._loaded()
        base = without(docs, "n_lines", "n_dropped")
        return self._by_join(base) if loaded is None else self._by_filter(base, *loaded)

    def _by_filter(self, base: DataFrame, filters: dict[int, bytes], exceptions: frozenset[bytes]) -> DataFrame:
        sent = base.sparkSession.sparkContext.broadcast((filters, exceptions))
        shards, min_chars = self.shards, self.min_chars
        text_at = [c.lower() for c in base.columns].index("text")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
        names = [*base.columns, "n_lines", "n_dropped"]

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = _Probe(*sent.value, shards)
            for batch in batches:
                texts = batch.column(text_at).to_pylist()
                keys = [keys_of(t, min_chars) for t in texts]
                hits = iter(probe([k for doc in keys for k in doc]).tolist())
                total, dropped = [], []
                for at, doc in enumerate(keys):
                    hit = [next(hits) for _ in doc]
                    total.append(len(doc))
                    dropped.append(sum(hit))
                    if any(hit):
                        lines = texts[at].split("\n")
                        texts[at] = "\n".join([line for line, bad in zip(lines, hit, strict=True) if not bad])
                columns = [batch.column(i) for i in range(batch.num_columns)]
                columns[text_at] = pa.array(texts, pa.string())
                columns += [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return base.mapInArrow(strip, f"{schema}, n_lines long, n_dropped long")

    def _by_join(self, base: DataFrame) -> DataFrame:
        """The same through joins: no bound on the number of shared lines."""
        min_chars = self.min_chars

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[bytes] = []
                keys: list[bytes] = []
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = set(keys_of(text, min_chars)) - {b""}
                    keys += found
                    rows += [row] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(keys, pa.binary())], names=["row", "key"])

        text = text_of(base)
        row = row_key(text)  # the text alone decides
        lines = base.select(row.alias("row"), text.alias("text")).mapInArrow(explode, "row binary, key binary")
        common = self.refs.where(F.col("n") >= self.min_docs).select("key")
        bad = lines.join(common, "key").groupBy("row").agg(F.collect_set("key").alias("bad"))
        marked = base.withColumn("__row", row).join(bad.withColumnRenamed("row", "__row"), "__row", "left").drop("__row")
        text_at = [c.lower() for c in base.columns].index("text")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
        names = [*base.columns, "n_lines", "n_dropped"]

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(text_at).to_pylist()
                total, dropped = [], []
                for at, bad in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    keys, gone = keys_of(texts[at], min_chars), set(bad or ())
                    hit = [k in gone for k in keys]
                    total.append(len(keys))
                    dropped.append(sum(hit))
                    if any(hit):
                        lines = texts[at].split("\n")
                        texts[at] = "\n".join([line for line, bad in zip(lines, hit, strict=True) if not bad])
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                columns[text_at] = pa.array(texts, pa.string())
                columns += [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return marked.mapInArrow(strip, f"{schema}, n_lines long, n_dropped long")


class _Probe:
    """Exact answers from filters and exceptions, for keys that the table has."""

    def __init__(self, filters: dict[int, bytes], exceptions: frozenset[bytes], shards: int) -> None:
        self._filters = {shard: CuckooFilter.from_bytes(data) for shard, data in filters.items()}
        self._exceptions, self._shards = exceptions, shards

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        real = np.array([bool(k) for k in keys], dtype=bool)
        hit = np.zeros(len(keys), dtype=bool)
        if not real.any():
            return hit
        packed = _array([k for k in keys if k])
        shard, found = _shard(packed, self._shards), np.zeros(len(packed), dtype=bool)
        for number in np.unique(shard).tolist():
            if number in self._filters:
                here = shard == number
                found[here] = self._filters[number].contains(packed[here])
        hit[real] = found
        for at in np.flatnonzero(hit).tolist():
            if keys[at] in self._exceptions:
                hit[at] = False
        return hit


def _sharded(shards: int):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            place = pa.array(_shard(_array(keys), shards) if keys else [], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), place, *batch.columns[1:]], names=["key", "shard", *batch.schema.names[1:]]
            )

    return shard


def _filters(common: DataFrame, shards: int) -> DataFrame:
    """The filter of each shard, from the keys at or over the limit."""
    sharded = common.select("key").mapInArrow(_sharded(shards), "key binary, shard long")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(_array(sorted(pdf["key"])))
        return pd.DataFrame({"shard": [key[0]], "data": [made.to_bytes()]})

    return sharded.groupBy("shard").applyInPandas(build, "shard long, data binary")


def digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode("utf-8", "replace")).hexdigest()
