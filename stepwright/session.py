"""Session defaults, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to a Python worker where a row may hold a whole document.
DOCUMENT_BATCH_ROWS = 400
#: Bytes of one; a longer row is a batch of its own.
DOCUMENT_BATCH_BYTES = 16 << 20


def build_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "stepwright", **conf: str) -> SparkSession:
    """A local session with the settings that every query here assumes."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STEPWRIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_batches(spark: SparkSession, rows: int = DOCUMENT_BATCH_ROWS) -> None:
    """Bound the Arrow batches: a row with a whole trajectory or text is kilobytes, not bytes, and may be megabytes.

    The settings are read when a plan with a Python stage is executed, so they are set for the session
    and never raised above a smaller value that the caller chose.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key, "64m")) > DOCUMENT_BATCH_BYTES:
        spark.conf.set(key, str(DOCUMENT_BATCH_BYTES))


def _bytes(size: str) -> int:
    size = size.lower().removesuffix("b")
    return int(size[:-1]) << {"k": 10, "m": 20, "g": 30}[size[-1]] if size[-1:] in "kmg" else int(size)


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written between stages: the cluster's ``spark.checkpoint.dir``.

    Only where none is set (tests, a laptop) a folder of this machine is taken, and then only for a local
    master; it goes when Python ends.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stepwright-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there.

    What the planner knows of the columns stays with them, so a loop that puts its own result in again and again takes ``written``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a parquet table in the shared folder: for what is read several times, by few of its columns each time."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
