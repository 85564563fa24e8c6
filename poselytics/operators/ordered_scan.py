"""Ordered, stateful scans over a key, safe for keys of any size.

A session's frames must be folded in order, yet one session may hold a third of
all rows, so a session is never gathered into one task. The rows are range
partitioned on ``(key, order)``: a large session is spread over many partitions
and every partition (a *chunk*) is an equal, sorted slice. A scan then takes
three steps:

1. only keys that lie in several chunks matter here, so at most the first and the
   last key of a chunk. The first is described as a *transfer*: what leaves the
   chunk as a function of what enters it. The last, begun inside the chunk, has
   a known exit.
2. the (at most two) descriptions per chunk are chained per key, which gives the
   state entering each chunk. That is one small record per chunk, not per key.
3. each chunk replays its rows from the right entry state.

A transfer may be lossy for unusual data; a chunk the chain cannot pass is then
replayed with its actual entry state, round by round, so results stay exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import StructField, StructType

from poselytics.session import materialise

CHUNK = "chunk"

CHUNK_BYTES = 128 << 20
# the planner's placeholder sizes are far above any real table
UNKNOWN_BYTES = 1 << 57


class Machine(Protocol):
    """A fold over ordered rows. States and transfers are plain picklable values."""

    inputs: list[str]
    outputs: list[tuple[str, pa.DataType]]

    def run(self, state: Any, rows: dict[str, list], lo: int, hi: int, out: dict[str, list] | None) -> Any:
        """Fold rows ``lo..hi`` of one key (``state`` None at its start)."""

    def transfer(self, rows: dict[str, list]) -> Any:
        """Describe the fold over ``rows`` for an entry state not known yet."""

    def apply(self, transfer: Any, state: Any) -> Any:
        """Exit state for an entry state, or None if the transfer cannot tell."""


Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Chunked:
    """Rows sorted within range partitions (``chunk`` names the partition), and narrow steps on them."""

    source: DataFrame
    key: str
    n_chunks: int
    # (chunk, key) where a key is spread over several chunks: at most two per chunk
    spread: list[tuple[int, str]]
    steps: tuple[Step, ...] = ()

    def then(self, step: Step) -> Chunked:
        """Add a step that keeps rows in their chunk and order."""
        return replace(self, steps=(*self.steps, step))

    @property
    def df(self) -> DataFrame:
        return self._after_steps(self.source)

    def spread_rows(self) -> DataFrame:
        """Rows of the keys that lie in several chunks, filtered before any step runs."""
        table = pa.table(
            {
                "_chunk": pa.array([c for c, _ in self.spread], pa.int32()),
                "_key": pa.array([k for _, k in self.spread], pa.string()),
            }
        )
        places = F.broadcast(self.source.sparkSession.createDataFrame(table))
        same = (F.col(CHUNK) == F.col("_chunk")) & (F.col(self.key) == F.col("_key"))
        return self._after_steps(self.source.join(places, same, "left_semi"))

    def _after_steps(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df


def _enough_chunks(df: DataFrame) -> int | None:
    """Chunks the estimated input size needs, if more than the configured shuffle partitions."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate > UNKNOWN_BYTES:
        return None
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = estimate // CHUNK_BYTES
    return wanted if wanted > configured else None


def chunk_rows(df: DataFrame, key: str, order: list, n_chunks: int | None = None) -> Chunked:
    """Range partition and sort by ``key`` and ``order``, written once to the shared folder.

    The range bounds come from a sample, so the chunks must not be computed
    twice: writing them fixes the bounds for all later passes and retries.
    Without ``n_chunks`` the number follows ``spark.sql.shuffle.partitions``,
    more if the estimated input asks for it, and adaptive execution merges small
    ones.
    """
    columns = [key, *order]
    n_chunks = n_chunks or _enough_chunks(df)
    ranged = df.repartitionByRange(n_chunks, *columns) if n_chunks else df.repartitionByRange(*columns)
    chunks = materialise(
        ranged.sortWithinPartitions(*columns).withColumn(CHUNK, F.spark_partition_id())
    )
    count = chunks.rdd.getNumPartitions()
    places: dict[str, list[int]] = {}
    if count > 1:
        # one row per chunk, like the range bounds Spark itself keeps on the driver
        ends = chunks.groupBy(CHUNK).agg(F.min(key).alias("low"), F.max(key).alias("high"))
        for row in ends.collect():
            for value in {row.low, row.high}:
                places.setdefault(value, []).append(row.chunk)
    spread = [(c, value) for value, found in places.items() if len(found) > 1 for c in found]
    return Chunked(chunks, key, count, spread)


def _key_starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """Offsets (after 0) at which the key differs from the row before."""
    n = batch.num_rows
    if n < 2:
        return []
    changed = np.zeros(n - 1, dtype=bool)
    for key in keys:
        column = batch.column(key)
        changed |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return (np.flatnonzero(changed) + 1).tolist()


def _key_at(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def _lists(parts: list[pa.RecordBatch], names: list[str]) -> dict[str, list]:
    table = pa.Table.from_batches(parts)
    return {name: table.column(name).to_pylist() for name in names}


def _chunk_ends(
    batches: Iterable[pa.RecordBatch], keys: list[str], inputs: list[str]
) -> tuple[int, list[tuple[tuple, dict[str, list]]]]:
    """The first and the last key of a chunk with their rows (one entry if they are the same)."""
    found: list[tuple[tuple, list[pa.RecordBatch]]] = []
    chunk = -1
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if not found:
            chunk = batch.column(CHUNK)[0].as_py()
        edges = [0, *_key_starts(batch, keys), batch.num_rows]
        first = _key_at(batch, keys, 0)
        if found and found[-1][0] == first:
            found[-1][1].append(batch.slice(0, edges[1]))
            edges = edges[1:]
        # of the keys beginning in this batch only the chunk's first and the newest matter
        begun = list(zip(edges, edges[1:]))
        for lo, hi in begun[:1] if not found else []:
            found.append((_key_at(batch, keys, lo), [batch.slice(lo, hi - lo)]))
            begun = begun[1:]
        if begun:
            lo, hi = begun[-1]
            found[1:] = [(_key_at(batch, keys, lo), [batch.slice(lo, hi - lo)])]
    return chunk, [(key, _lists(parts, inputs)) for key, parts in found]


_END = "chunk int, is_first boolean, kind string, blob binary"


def _describe(df: DataFrame, keys: list[str], machine: Machine, known: dict[int, Any]) -> DataFrame:
    """Per chunk: the transfer of its first key and the exit state of its last.

    For chunks in ``known`` the exact exit for that entry state is given instead.
    """
    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = StructType([*key_fields, *StructType.fromDDL(_END).fields])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, ends = _chunk_ends(batches, keys, machine.inputs)
        rows = []
        for position, (key, columns) in enumerate(ends):
            n = len(columns[machine.inputs[0]])
            if position == 0 and known:
                if chunk not in known:
                    continue
                kind, value = "exit", machine.run(known[chunk], columns, 0, n, None)
            elif known:
                continue
            elif position == 0:
                kind, value = "transfer", machine.transfer(columns)
            else:
                kind, value = "exit", machine.run(None, columns, 0, n, None)
            rows.append(
                {**dict(zip(keys, key)), "chunk": chunk, "is_first": position == 0, "kind": kind, "blob": pickle.dumps(value)}
            )
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)

    arrow_schema = pa.schema(
        [
            *[pa.field(f.name, to_arrow_type(f.dataType)) for f in key_fields],
            pa.field("chunk", pa.int32()),
            pa.field("is_first", pa.bool_()),
            pa.field("kind", pa.string()),
            pa.field("blob", pa.binary()),
        ]
    )
    wanted = list(dict.fromkeys([*keys, *machine.inputs, CHUNK]))
    return df.select(*wanted).mapInArrow(describe, schema)


def _chain(ends: DataFrame, keys: list[str], machine: Machine, exact: dict[int, Any]) -> list:
    """Entry state of every chunk whose first key began earlier; ``open`` where the chain stopped.

    The descriptions of a key are read one after the other from a sorted stream,
    never as a group.
    """

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, stopped, position = None, None, False, 0
        for batch in batches:
            result = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state, stopped, position = key, None, False, 0
                if stopped:
                    continue
                value = pickle.loads(row.blob)
                if row.kind == "exit":
                    state = value
                else:
                    if position:
                        result.append((row.chunk, "entry", pickle.dumps(state)))
                    following = exact[row.chunk] if row.chunk in exact else machine.apply(value, state)
                    if following is None:
                        result.append((row.chunk, "open", pickle.dumps(state)))
                        stopped = True
                    state = following
                position += 1
            yield pd.DataFrame(result, columns=["chunk", "kind", "blob"])

    ordered = ends.repartition(*keys).sortWithinPartitions(*keys, "chunk")
    # at most one row per chunk: as small as the range bounds Spark itself keeps on the driver
    return ordered.mapInPandas(chain, "chunk int, kind string, blob binary").collect()


def _entry_states(chunked: Chunked, keys: list[str], machine: Machine) -> dict[int, Any]:
    if not chunked.spread:
        return {}
    rows_of_spread = chunked.spread_rows()
    ends = _describe(rows_of_spread, keys, machine, {})
    exact: dict[int, Any] = {}
    while True:
        rows = _chain(ends, keys, machine, exact)
        opened = {r.chunk: pickle.loads(r.blob) for r in rows if r.kind == "open"}
        if not opened:
            return {r.chunk: pickle.loads(r.blob) for r in rows if r.kind == "entry"}
        if not exact:
            ends = materialise(ends)
        stopped = rows_of_spread.filter(F.col(CHUNK).isin(list(opened)))
        for r in _describe(stopped, keys, machine, opened).collect():
            exact[r.chunk] = pickle.loads(r.blob)


def ordered_scan(chunked: Chunked, keys: list[str], machine: Machine) -> Chunked:
    """Add the machine's output columns to every row. Rows keep their chunk and order."""
    entries = _entry_states(chunked, keys, machine)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            rows = {name: batch.column(name).to_pylist() for name in machine.inputs}
            out: dict[str, list] = {name: [] for name, _ in machine.outputs}
            edges = [0, *_key_starts(batch, keys), n]
            for lo, hi in zip(edges, edges[1:]):
                key = _key_at(batch, keys, lo)
                if key != current:
                    # only the first key of a chunk can have begun before it
                    state = entries.get(batch.column(CHUNK)[lo].as_py()) if current is None else None
                    current = key
                state = machine.run(state, rows, lo, hi, out)
            added = [pa.array(out[name], kind) for name, kind in machine.outputs]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, *out]
            )

    def scan(df: DataFrame) -> DataFrame:
        added = [StructField(name, from_arrow_type(kind)) for name, kind in machine.outputs]
        return df.mapInArrow(replay, StructType([*df.schema.fields, *added]))

    return chunked.then(scan)
