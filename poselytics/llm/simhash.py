"""SimHash near-duplicates, searched with BK-trees.

Equal fingerprints are one class, so copies never meet each other. Distinct
fingerprints are dealt to shards such that any two within the radius share one: the
64 bits are cut into radius + 1 blocks, one of which must be equal, and a shard
is a block with its value. A shard that many fingerprints share is cut again
on its remaining bits. Each shard's BK-tree is built
where its members are and walked with all of them at once, following only edges
within the radius. A broadcast tree over all fingerprints would grow with the
data and, at a radius of 4 of 64 bits, prune next to nothing.

A shard gives a spanning forest of its links, not all of them, and connected
components put the forests together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.llm.common import free_name, keep, row_key, text_of
from poselytics.llm.graph import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints that one tree may hold before its shard is cut again.
SHARD = 512
#: Fingerprints of a block, where a shard is still larger after that; a tree holds two blocks at most.
BLOCK = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is in over half the shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # a long text takes no more memory than a short one
        octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


class BKTree:
    """Distinct 64-bit values; children are keyed by their distance to the parent."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.ascontiguousarray(values, dtype=np.uint64)
        self.children: list[dict[int, int]] = [{} for _ in range(len(self.values))]
        waiting = [(0, np.arange(1, len(self.values)))] if len(self.values) else []
        while waiting:
            node, rest = waiting.pop()
            if not len(rest):
                continue
            distance = np.bitwise_count(self.values[rest] ^ self.values[node])
            for edge in np.unique(distance).tolist():
                below = rest[distance == edge]
                self.children[node][edge] = int(below[0])
                waiting.append((int(below[0]), below[1:]))

    def links(self, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For every node the other members within ``radius``, all members asked at once."""
        waiting = [(0, np.arange(len(self.values)))] if len(self.values) > 1 else []
        while waiting:
            node, asked = waiting.pop()
            distance = np.bitwise_count(self.values[asked] ^ self.values[node]).astype(np.int64)
            near = asked[(distance <= radius) & (asked > node)]
            if len(near):
                yield node, near
            for edge, child in self.children[node].items():
                follow = asked[np.abs(distance - edge) <= radius]
                if len(follow):
                    waiting.append((child, follow))


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of ``values`` that connect all of them that are linked within ``radius``."""
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = []
    for node, near in BKTree(values).links(radius):
        for other in near.tolist():
            a, b = root(node), root(other)
            if a != b:
                parent[b] = a
                pairs.append((node, other))
    return pairs


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` but text, and the fingerprint as a long named fp."""
    others = [f for f in docs.schema if f.name.lower() not in ("text", "fp")]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in others], text_of(docs).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()]
            prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], prints], names=[*[f.name for f in others], "fp"]
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return rows.mapInArrow(mark, schema + "fp long")


def _masks(bits: list[int], radius: int) -> list[tuple[int, list[int]]]:
    """``bits`` in radius + 1 blocks: the mask of each (a signed long) and the bits outside it."""
    found = []
    for k in range(radius + 1):
        block = bits[k * len(bits) // (radius + 1) : (k + 1) * len(bits) // (radius + 1)]
        mask = sum(1 << b for b in block)
        found.append((mask - (1 << 64) if mask >> 63 else mask, [b for b in bits if b not in block]))
    return found


def _shards(prints: DataFrame, radius: int, limit: int, block: int) -> DataFrame:
    """fp, mask, value, part: the shards of every fingerprint.

    Shards over ``limit`` are cut once more. What is still over ``block`` then agrees in a third of
    all bits or more and is one family of near copies, which further cuts would only repeat: it is dealt to
    blocks, and any two of them are a part of their own, so that all its members meet and no tree holds them all.
    """
    masks = _masks(list(range(64)), radius)
    first = prints.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m, _ in masks])).alias("mask"))
    first = first.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    full = first.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    full = keep(full.select("mask", "value"), "full-shards")
    if full.isEmpty():
        return first.withColumn("part", F.lit(0).cast("long"))
    within = [
        F.when(F.col("mask") == m, F.array(*[F.lit(m | part).cast("long") for part, _ in _masks(rest, radius)]))
        for m, rest in masks
    ]
    second = first.join(full, ["mask", "value"], "left_semi").select("fp", F.explode(F.coalesce(*within)).alias("mask"))
    second = second.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    whole = first.join(full, ["mask", "value"], "left_anti").select("fp", "mask", "value", F.lit(0).cast("long").alias("part"))
    sizes = second.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > block)
    sizes = keep(sizes.select("mask", "value", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "family-shards")
    if sizes.isEmpty():
        return whole.union(second.select("fp", "mask", "value", F.lit(0).cast("long").alias("part")))
    dealt = second.join(sizes, ["mask", "value"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1))
    pairs = dealt.select("fp", "mask", "value", own.alias("own"), other.alias("other"))
    part = F.least("own", "other") * (1 << 31) + F.greatest("own", "other")
    return whole.union(pairs.select("fp", "mask", "value", part.alias("part")))


def link(prints: DataFrame, radius: int = RADIUS, limit: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Edges a, b that connect all distinct values of ``prints.fp`` linked within ``radius``."""
    shards = _shards(prints, radius, limit, block)
    near = shards.repartition("mask", "value", "part").sortWithinPartitions("mask", "value", "part", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple[int, int, int] | None = None
        held: list[np.ndarray] = []
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            values = np.unique(np.concatenate(held))
            if len(values) > 1:
                for x, y in forest(values.view(np.uint64), radius):
                    a.append(int(values[x]))
                    b.append(int(values[y]))

        for batch in batches:
            fp, mask, value, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            edges = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]) | (part[1:] != part[:-1])) + 1
            starts = [0, *edges.tolist()] if len(fp) else []
            for start, stop in zip(starts, [*starts[1:], len(fp)], strict=True):
                key = (int(mask[start]), int(value[start]), int(part[start]))
                if key != open_key and held:
                    close()
                    held = []
                open_key = key
                held.append(fp[start:stop].copy())
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return near.mapInArrow(search, "a long, b long")


def _linked(base: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """``base`` without text but with fp; and fp, root and least, the smallest doc_id, of each fingerprint."""
    marked = keep(fingerprints(base, shingle), "fingerprints")
    least = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(link(least.select("fp"), radius))
    linked = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return marked, linked.select("fp", F.coalesce("root", "fp").alias("root"), "least")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` without text, with fp (long) and component_id, the smallest doc_id it is linked with.

    Rows without words, null texts too, have fingerprint 0 and link like any others. A row whose
    whole component has no doc_id gets none. Repeated rows are members like any others. An empty table gives an empty one.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("fp", "component_id")])
    marked, linked = _linked(base, shingle, radius)
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(lowest, "root").select("fp", "component_id")
    return marked.join(classes, "fp")


def deduplicate(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, of equal ones the smallest text.

    Rows without an id take part like others and stay only where their whole component has none. Of rows equal in
    id and text one stays, and an empty table gives an empty one.
    """
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, row_key(text_of(docs), docs["doc_id"]))
    marked, linked = _linked(keyed.select(F.col(key).alias("key"), "doc_id", "text"), shingle, radius)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = marked.groupBy("fp").agg(F.min(order).alias("first"))
    winners = first.join(linked, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    again = keep(marked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "equal-rows")
    if not again.isEmpty():
        keyed = keyed.dropDuplicates([key])
    # texts take one exchange at any size of the winners' table
    return keyed.join(winners.hint("shuffle_hash"), key, "left_semi").drop(key)
