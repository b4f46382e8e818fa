"""Per-key results where a handful of keys hold most rows.

The rows are range partitioned by (key, secondary order, salt): Spark samples the quantiles of that
composite key, so every partition gets about as many rows, and a heavy key is cut into several
consecutive partitions by its secondary order.  Each partition reduces its rows to one partial state
for each key in it; only keys that meet a partition boundary have more than one.  The partial states,
at most (keys + partitions) rows, are then stitched by key.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALTS = 4096


def spread(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` range partitioned so that no partition is larger than the others, whatever the keys are.

    The salt tells rows apart that agree in key and order, so that even equal rows can be cut.
    """
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS)))
    return salted.repartitionByRange(F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], "_salt").drop("_salt")


def per_key(df: DataFrame, key: str, order: list[str], aggregates: list[Column]) -> DataFrame:
    """``aggregates`` (decomposable ones) of every key, the null key included.

    The aggregation after the range exchange runs in two halves: one state a key and partition, then
    the stitching of the states of a key; no task ever holds all rows of a heavy key.
    """
    return spread(df, key, order).groupBy(key).agg(*aggregates)


def latest(order: list[str]) -> Column:
    """The row that is last in ``order`` (nulls first), as a struct; ties end at the greatest row."""
    return F.max(F.struct(*order))


def repo_stats(instances: DataFrame) -> DataFrame:
    """Per repo as written: rows, share with use_patch, and the latest row by loaded_at."""
    order = ["loaded_at", "instance_id", "source"]
    slim = instances.select("repo", "use_patch", *order)
    stats = per_key(slim, "repo", order, [
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("use_patch")).alias("n_success"),
        F.count("use_patch").alias("n_judged"), latest(order).alias("last")])
    return stats.select(
        F.lit("instances").alias("table_name"), F.col("repo").alias("key_value"), "n_rows", "n_judged", "n_success",
        F.try_divide(F.col("n_success").cast("double"), "n_judged").alias("success_rate"),
        F.col("last.instance_id").alias("latest_row"), F.col("last.loaded_at").cast("string").alias("latest_at"))


def rollout_stats(rollouts: DataFrame) -> DataFrame:
    """Per instance_id: rows, share of correct ones, and the latest row by arrived_at."""
    order = ["arrived_at", "created_at", "node_key", "rollout_idx"]
    slim = rollouts.select("instance_id", "correct", *order)
    stats = per_key(slim, "instance_id", order, [
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("correct") == 1).alias("n_success"),
        F.count("correct").alias("n_judged"), latest(order).alias("last")])
    return stats.select(
        F.lit("rollouts").alias("table_name"), F.col("instance_id").alias("key_value"), "n_rows", "n_judged", "n_success",
        F.try_divide(F.col("n_success").cast("double"), "n_judged").alias("success_rate"),
        F.concat_ws("|", "last.node_key", F.col("last.rollout_idx").cast("string")).alias("latest_row"),
        F.col("last.arrived_at").cast("string").alias("latest_at"))


def heavy_keys(stats: DataFrame, total: int, share: float = 0.04) -> DataFrame:
    """Keys (never the null key) that hold at least ``share`` of ``total`` rows, compared in whole numbers."""
    exact = Fraction(str(share))
    return stats.filter(F.col("key_value").isNotNull() & (F.col("n_rows") * F.lit(exact.denominator) >= F.lit(exact.numerator * total)))
