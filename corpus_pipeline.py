"""From raw documents to packed training sequences, one operator a stage.

Each stage reads what the one before has written as Parquet. All but the last return the
columns of ``documents``; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poselytics.llm import decontaminate, gam, line_dedup, packing, simhash
from poselytics.llm.common import folder, prepare, table
from poselytics.llm.queries import BYTES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _begin(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "documents") if docs is None else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among them, and scores rows without an id like others."""
    docs = _begin(spark, docs, sf_dir)
    model = gam.train(docs, table(spark, sf_dir, "labels"))
    return _columns(gam.classify(docs, model).where("predicted = 1"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many of them share; one that has nothing left stays, empty."""
    docs = _begin(spark, docs, sf_dir)
    return _columns(line_dedup.LineIndex.build(docs).apply(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: fingerprints of four-word shingles within four bits."""
    return _columns(simhash.deduplicate(_begin(spark, docs, sf_dir)))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that stand in a benchmark's window."""
    docs = _begin(spark, docs, sf_dir)
    return _columns(decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), remove="spans"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return packing.pack(_begin(spark, docs, sf_dir), public_tokenizers.path(BYTES), 2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("pack", pack),
]

#: SQL has no boosted trees, no xxHash64 and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
