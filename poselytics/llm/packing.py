"""Best-fit decreasing packing of token sequences.

Documents longer than a sequence are cut; whole pieces fill sequences of their
own, so at most one shorter piece of each document, its first, is packed. Those
are dealt at random to groups of a fixed size, and each group is packed by
itself: largest first, each into the open sequence with the least room that is
enough, which a segment tree over the remaining capacities finds in logarithmic
time. A group wastes a few sequences at most, whatever the number of groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.llm.common import keep, text_of
from poselytics.llm.tokens import encoder

CAPACITY = 1024
#: Documents packed together.
GROUP = 25_000

_TOKENS = "row long, doc_id long, n_tokens long, crcs array<long>"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Open bins by remaining capacity: a segment tree over the capacities 0 to ``size``.

    A node is set if any capacity below it has an open bin.
    """

    def __init__(self, size: int) -> None:
        self._leaves = 1 << size.bit_length()
        self._some = bytearray(2 * self._leaves)
        self._bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, number: int) -> None:
        self._bins[room].append(number)
        node = room + self._leaves
        while node and not self._some[node]:
            self._some[node] = 1
            node >>= 1

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, number) of the fullest bin that holds ``length``."""
        if length >= len(self._bins):
            return None
        some, node = self._some, length + self._leaves
        # up until a set node at or to the right, then down to its leftmost set leaf
        while not some[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self._leaves:
            node = 2 * node if some[2 * node] else 2 * node + 1
        room = node - self._leaves
        bins = self._bins[room]
        number = bins.pop()
        if not bins:
            while node and (node >= self._leaves or not (some[2 * node] or some[2 * node + 1])):
                some[node] = 0
                node >>= 1
        return room, number


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each length, taken largest first (ties in order), and the number of bins."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    open_bins, used = OpenBins(capacity), 0
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[at]
        if length > capacity:
            raise ValueError(f"{length} is longer than {capacity}")
        found = open_bins.take_tightest(length)
        if found is None:
            found = capacity, used
            used += 1
        room, number = found
        bins[at], offsets[at] = number, capacity - room
        if room > length:
            open_bins.add(room - length, number)
    return bins, offsets, used


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``n`` tokens; only the first may be shorter than ``capacity``."""
    first = n % capacity
    starts = [0, *range(first, n, capacity)] if first else list(range(0, n, capacity))
    return list(zip(starts, [b - a for a, b in zip(starts, [*starts[1:], n], strict=True)], strict=True))


def tokenised(docs: DataFrame, vocabulary: str, end: int, *, spaces: bool = True, capacity: int = CAPACITY) -> DataFrame:
    """Number, id, length and the checksum of each piece of every document; written once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary, spaces)
        for batch in batches:
            lengths, crcs = [], []
            for found in words.ids(batch.column(2).to_pylist()):
                ids = np.append(found, np.uint32(end)).astype("<u4")
                lengths.append(len(ids))
                crcs.append([zlib.crc32(ids[a : a + n].tobytes()) for a, n in cut(len(ids), capacity)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_tokens", "crcs"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of(docs).alias("text"),
    )
    # once written, a row's number no longer depends on how it is read
    return keep(rows.mapInArrow(encode, _TOKENS), "tokens")


def pack(
    docs: DataFrame,
    vocabulary: str,
    end: int,
    *,
    spaces: bool = True,
    capacity: int = CAPACITY,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece with its sequence and its offset there.

    Reads doc_id and text of ``docs``; a null text is empty (``end`` alone), rows
    with the same id, null or not, are documents of their own. An empty table
    gives no rows.
    """
    tokens = tokenised(docs, vocabulary, end, spaces=spaces, capacity=capacity)
    groups = max(1, -(-tokens.count() // group))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        lengths = pdf["n_tokens"].to_numpy()
        firsts = lengths % capacity
        short = np.flatnonzero(firsts)
        bins, offsets, used = best_fit(firsts[short].tolist(), capacity)
        place = dict(zip(short.tolist(), zip(bins, offsets, strict=True), strict=True))
        out: list[tuple] = []
        base = int(key[0]) << 40
        for at, (doc_id, n, crcs) in enumerate(zip(pdf["doc_id"].array, lengths.tolist(), pdf["crcs"], strict=True)):
            for piece, ((start, length), crc) in enumerate(zip(cut(n, capacity), crcs, strict=True)):
                if length < capacity:
                    number, offset = place[at]
                else:
                    number, offset = used, 0
                    used += 1
                out.append((doc_id, piece, start, length, crc, base + number, offset))
        names = [c.split()[0] for c in _PIECES.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    # pandas turns longs with nulls to floats, which lose digits
    rows = tokens.withColumn("doc_id", F.col("doc_id").cast("string"))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def fill_text(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pd.array([None if x is None else int(x) for x in pdf["doc_id"]], dtype="Int64")
        return fill(key, pdf.assign(doc_id=ids))

    return dealt.groupBy("group").applyInPandas(fill_text, _PIECES)
