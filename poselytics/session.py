"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options that results depend on; safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # duplicate angle names inside one frame: the last one wins
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # the JVM never compiles methods over 8000 bytes of bytecode; long rule
    # expressions run several times faster split up than in one such method
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # keep all cores busy on small inputs too; large ones are sized by the advisory size
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256KB")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    _ship_package(spark)
    return spark


def _ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="poselytics-pkg-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    # stateful streaming also starts a worker beside the driver, which gets no added files
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH")
    environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root.parent), known]))
    _shipped.add(application)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only where that is unset, as in tests, another one is taken; a machine-local
    one only in local mode, where driver and executors are one process.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if current is None or folder.rstrip("/") not in current:
            context.setCheckpointDir(folder)
        return folder
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="poselytics-ckpt-")
    context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
