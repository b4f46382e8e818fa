"""Rollouts as a stream: rates per node, repeated deliveries, and a ledger that consumes each slot once.

The streams here can run forever; ``drain`` runs one over what is there and returns the table it wrote.
State is kept by slot or node, never by instance: a few instances hold most rollouts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.operators import search as G
from stepwright.session import shared_folder

SLOT = ["instance_id", "node_key", "rollout_idx"]


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A parquet table, file by file; the schema is the table's own."""
    schema = spark.read.parquet(path).schema
    # a table may be a single file; as a pattern the path may be either, as a plain path only a folder
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def first_deliveries(rollouts: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each slot once: what arrives again within ``delay`` of event time is dropped, and its state with it."""
    timed = rollouts.withColumn("at", F.col("arrived_at").cast("timestamp")).withWatermark("at", delay)
    return timed.dropDuplicatesWithinWatermark(SLOT)


def node_rates(rollouts: DataFrame) -> DataFrame:
    """Running success rate and number of rollouts a node; for update or complete mode."""
    return rollouts.groupBy("instance_id", "node_key").agg(F.round(F.avg(F.col("correct").cast("double")), 6).alias("mc"), F.count(F.lit(1)).alias("n"))


def arrivals(rollouts: DataFrame, width: str = "1 day", delay: str = "10 days") -> DataFrame:
    """Rollouts a window of arrival; late ones count within ``delay``."""
    timed = rollouts.withColumn("at", F.col("arrived_at").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct") == 1).alias("n_correct")).select(F.col("w.start").alias("start"), "n", "n_correct")


def ledger(rollouts: DataFrame) -> DataFrame:
    """Each slot with its deliveries and whether it was consumed, for update mode; a slot once consumed stays so, whatever arrives later.

    The state of a slot is two numbers, so an instance with most of the rows is spread like any others.
    """
    return rollouts.groupBy(*SLOT).agg(F.count(F.lit(1)).alias("n_deliveries"), F.max(F.coalesce("is_consumed", F.lit(0))).alias("consumed"))


def ledger_totals(slots: DataFrame) -> DataFrame:
    """Per instance, slots, repeated deliveries and slots consumed, of the slots' last states."""
    return slots.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n_slots"), F.sum(F.col("n_deliveries") - 1).alias("n_repeats"), F.count_if(F.col("consumed") > 0).alias("n_consumed"))


def drain(stream: DataFrame, mode: str, latest_by: list[str] | None = None) -> DataFrame:
    """The table of a stream run over all that is there now.

    Each micro-batch is written as a version in the shared folder, so a batch that is run again replaces
    itself; of an updating stream, the last version of each key counts.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, number: int) -> None:
        df.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(-1)).write.mode("overwrite").parquet(f"{base}/out/batch=-1")
    run_to_end(stream, mode, f"{base}/state", write)
    out = spark.read.parquet(f"{base}/out").drop("batch")
    if mode == "complete":
        last = out.agg(F.max("_batch")).first()[0]
        return out.filter(F.col("_batch") == last).drop("_batch")
    if latest_by:
        rest = [c for c in stream.columns if c not in latest_by]
        return out.groupBy(*latest_by).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*latest_by, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*stream.columns)
    return out.drop("_batch")


def run_to_end(stream: DataFrame, mode: str, state: str, write: Callable[[DataFrame, int], None]) -> None:
    """All that is there now, batch by batch; ``state`` is the folder of the stream's checkpoints."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def commit_sessions(picked: DataFrame, nodes: DataFrame, slots: DataFrame, trees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three state tables after a stream of finished sessions (instance_id, node_key, rollout_idx).

    Each micro-batch is one commit: its three tables are written as a new version, and the version counts from the
    moment its mark is there, so a batch that fails leaves the last version as it was and is run again from it.
    A slot that is consumed already, or delivered twice in a batch, changes nothing; whatever node was
    revised is in the pool, but for the root.
    """
    spark = picked.sparkSession
    base = f"{shared_folder(spark)}/commits-{uuid.uuid4().hex}"
    names = ("nodes", "slots", "trees")
    for name, df in zip(names, (nodes, slots, trees), strict=True):
        df.write.parquet(f"{base}/v-1/{name}")
    _mark(spark, f"{base}/done", -1)

    def commit(batch: DataFrame, number: int) -> None:
        last = max(v for v in _marked(spark, f"{base}/done") if v < number)
        n, s, t = (spark.read.parquet(f"{base}/v{last}/{name}") for name in names)
        fresh = batch.dropDuplicates(SLOT).join(s.filter("is_consumed = 1").select(*SLOT), SLOT, "left_anti")
        for name, df in zip(names, G.consume(n, s, t, fresh, fresh.filter("node_key <> 'root'")), strict=True):
            df.write.mode("overwrite").parquet(f"{base}/v{number}/{name}")
        _mark(spark, f"{base}/done", number)

    run_to_end(picked, "append", f"{base}/state", commit)
    last = max(_marked(spark, f"{base}/done"))
    return tuple(spark.read.parquet(f"{base}/v{last}/{name}") for name in names)


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _mark(spark: SparkSession, folder: str, version: int) -> None:
    system, path = _files(spark, f"{folder}/v{version}")
    system.create(path, True).close()


def _marked(spark: SparkSession, folder: str) -> list[int]:
    system, path = _files(spark, folder)
    return [int(s.getPath().getName()[1:]) for s in system.listStatus(path)]
