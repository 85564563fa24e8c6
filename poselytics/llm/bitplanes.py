"""Token ids as bit planes: fixed-size blocks, transposed, each plane compressed on its own.

The file format is a Parquet dataset of two tables. ``blocks`` has one row per
block of ids: its planes (zstandard), the crc32 of its ids and the documents in
it. ``index`` has one row per block: its place in the whole sequence of ids and
its sizes, so that any range of ids can be found without reading a plane.
Parquet is only the container: it brings commits that survive lost executors on
any file system Spark can write to.

Ids run in ascending document order. Documents are range partitioned on (id,
hash of the text), so an id that many rows share is spread too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poselytics.llm.common import folder, prepare, text_of
from poselytics.llm.tokens import encoder

BLOCK_IDS = 1 << 16
LEVEL = 3

_PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("row", T.LongType()),  # number of the document in its part
        T.StructField("at", T.IntegerType()),  # place in the block
        T.StructField("length", T.IntegerType()),
        T.StructField("doc_at", T.LongType()),  # place in the document
        T.StructField("n_tokens", T.LongType()),
    ]
)
BLOCKS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("n_ids", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("unit", T.IntegerType()),
        T.StructField("crc", T.LongType()),
        T.StructField("planes", T.ArrayType(T.BinaryType())),
        T.StructField("pieces", T.ArrayType(_PIECE)),
    ]
)
_READ = "doc_id long, part int, row long, doc_at long, start long, n_tokens long, crc long, ids binary"


def to_planes(ids: np.ndarray, bits: int, unit: int = 1) -> list[bytes]:
    """Planes of a block: of every ``unit`` bits (1 or 8) of all its ids one, lowest first."""
    if bits not in (8, 16, 24, 32) or unit not in (1, 8):
        raise ValueError("bits: 8, 16, 24 or 32; unit: 1 or 8")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, : bits // 8]
    if unit == 8:
        return [octets[:, k].tobytes() for k in range(bits // 8)]
    each = np.unpackbits(np.ascontiguousarray(octets), axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(each.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, unit: int = 1) -> np.ndarray:
    """The ids that ``to_planes`` was given."""
    octets = np.zeros((n, 4), dtype=np.uint8)
    if unit == 8:
        for k, plane in enumerate(planes):
            octets[:, k] = np.frombuffer(plane, dtype=np.uint8)
    elif n:
        rows = np.frombuffer(b"".join(planes), dtype=np.uint8).reshape(len(planes), -1)
        each = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        octets[:, : len(planes) // 8] = np.packbits(np.ascontiguousarray(each.T), axis=1, bitorder="little")
    return octets.view("<u4").ravel()


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end: int,
    *,
    spaces: bool = False,
    block_ids: int = BLOCK_IDS,
    bits: int = 16,
    unit: int = 1,
) -> None:
    """Encode the texts of ``docs`` (doc_id, text; others are ignored) into a dataset at ``path``.

    ``end`` is appended to each document. A null text is empty, a null id comes
    first, rows with the same id follow each other and stay apart; an empty table
    gives an empty dataset.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, press = encoder(vocabulary, spaces), zstandard.ZstdCompressor(level=LEVEL)
        held: list[np.ndarray] = []
        pieces: list[dict] = []
        filled = number = row = 0
        schema = pa.schema(
            [
                ("part", pa.int32()),
                ("block", pa.int64()),
                ("n_ids", pa.int32()),
                ("bits", pa.int32()),
                ("unit", pa.int32()),
                ("crc", pa.int64()),
                ("planes", pa.list_(pa.binary())),
                (
                    "pieces",
                    pa.list_(
                        pa.struct(
                            [
                                ("doc_id", pa.int64()),
                                ("row", pa.int64()),
                                ("at", pa.int32()),
                                ("length", pa.int32()),
                                ("doc_at", pa.int64()),
                                ("n_tokens", pa.int64()),
                            ]
                        )
                    ),
                ),
            ]
        )

        def block() -> pa.RecordBatch:
            nonlocal held, pieces, filled, number
            ids = np.concatenate(held)
            made = {
                "part": part,
                "block": number,
                "n_ids": len(ids),
                "bits": bits,
                "unit": unit,
                "crc": zlib.crc32(ids.tobytes()),
                "planes": [press.compress(x) for x in to_planes(ids, bits, unit)],
                "pieces": pieces,
            }
            held, pieces, filled, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pylist([made], schema=schema)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, found in zip(names, encode.ids(batch.column(1).to_pylist()), strict=True):
                ids = np.append(found, np.uint32(end)).astype("<u4")
                at = 0
                while at < len(ids):
                    take = ids[at : at + block_ids - filled]
                    pieces.append(
                        {
                            "doc_id": name,
                            "row": row,
                            "at": filled,
                            "length": len(take),
                            "doc_at": at,
                            "n_tokens": len(ids),
                        }
                    )
                    held.append(take)
                    filled += len(take)
                    at += len(take)
                    if filled == block_ids:
                        yield block()
                row += 1
        if filled:
            yield block()

    mixed = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", mixed).sortWithinPartitions("doc_id", mixed, "text")
    made = ordered.mapInArrow(blocks, BLOCKS)
    # planes are compressed already
    made.write.option("compression", "none").parquet(f"{path}/blocks")
    written = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = written.select(
        "part",
        "block",
        "n_ids",
        F.aggregate("planes", F.lit(0).cast("long"), lambda n, p: n + F.length(p)).alias("n_bytes"),
    )
    # one row per part is all that meets in one place
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select(
        "part",
        (F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("base"),
    )
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    index = sizes.withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids")).join(before, "part")
    index.select("part", "block", (F.col("base") + F.col("inside")).alias("first"), "n_ids", "n_bytes").write.parquet(
        f"{path}/index"
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, block long, first long, n_ids long, n_bytes long").parquet(f"{path}/index")


def read_pieces(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents' pieces, decoded and checked: place, ids (little-endian uint32).

    With ``digest``, whole documents carry the crc32 of their ids instead of the ids.
    A damaged block ends the job.
    """
    prepare(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    placed = blocks.join(read_index(spark, path).select("part", "block", "first"), ["part", "block"])
    placed = placed.select("part", "block", "n_ids", "unit", "crc", "planes", "pieces", "first")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for one in range(batch.num_rows):
                x = batch.slice(one, 1).to_pylist()[0]
                ids = from_planes([unpress.decompress(p) for p in x["planes"]], x["n_ids"], x["unit"])
                if zlib.crc32(ids.tobytes()) != x["crc"]:
                    raise ValueError(f"block {x['block']} of part {x['part']} is damaged")
                out: dict[str, list] = {k: [] for k in ("doc_id", "part", "row", "doc_at", "start", "n_tokens", "crc", "ids")}
                for p in x["pieces"]:
                    data = ids[p["at"] : p["at"] + p["length"]].tobytes()
                    whole = digest and p["length"] == p["n_tokens"]
                    out["doc_id"].append(p["doc_id"])
                    out["part"].append(x["part"])
                    out["row"].append(p["row"])
                    out["doc_at"].append(p["doc_at"])
                    out["start"].append(x["first"] + p["at"] - p["doc_at"])
                    out["n_tokens"].append(p["n_tokens"])
                    out["crc"].append(zlib.crc32(data) if whole else None)
                    out["ids"].append(None if whole else data)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["doc_id"], pa.int64()),
                        pa.array(out["part"], pa.int32()),
                        pa.array(out["row"], pa.int64()),
                        pa.array(out["doc_at"], pa.int64()),
                        pa.array(out["start"], pa.int64()),
                        pa.array(out["n_tokens"], pa.int64()),
                        pa.array(out["crc"], pa.int64()),
                        pa.array(out["ids"], pa.binary()),
                    ],
                    names=list(out),
                )

    return placed.mapInArrow(decode, _READ)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a dataset.

    Only documents that lie across blocks bring their ids to the shuffle.
    """
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("doc_at", "ids")))),
        F.lit(b"").cast("binary"),
        lambda done, x: F.concat(done, x["ids"]),
    )
    documents = (
        read_pieces(spark, path, digest=True)
        .groupBy("part", "row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("start").alias("start"),
            F.first("n_tokens").alias("n_tokens"),
            F.max("crc").alias("crc"),
            joined.alias("ids"),
        )
    )
    return documents.select("doc_id", "start", "n_tokens", F.coalesce("crc", F.crc32("ids")).alias("ids_crc32"))


def new_dataset(spark: SparkSession) -> str:
    return folder(spark, "ids")
