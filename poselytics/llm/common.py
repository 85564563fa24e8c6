"""What the operators share: session options, tables kept between jobs, row keys."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poselytics.session import configure, shared_folder

#: Rows and bytes in one Arrow batch; whole texts are wide rows.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
#: Most bytes of anything that is broadcast; beyond it operators join instead.
BROADCAST_BYTES = 64 << 20

#: ``[\x20\x09-\x0D]``, what ``bytes.split`` and ``bytes.strip`` take as white space.
SPACE = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package to the workers and bound the Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage, so that a lost executor costs one task and no recomputing.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name_2`` and so on where ``df`` has such a column already."""
    taken, n, found = {c.lower() for c in df.columns}, 1, name
    while found.lower() in taken:
        n += 1
        found = f"{name}_{n}"
    return found


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is going to add."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def row_key(text: Column, *ids: Column) -> Column:
    """16 bytes that stand for a row's id and whole text; rows equal in both share it."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in ids]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts, text)))


def row_count(df: DataFrame) -> int:
    return df.count()


_UPPER = re.compile(r"[A-Z]+")


def lower_ascii(text: str) -> str:
    """A-Z only; other letters stay."""
    return _UPPER.sub(lambda m: m[0].lower(), text)
