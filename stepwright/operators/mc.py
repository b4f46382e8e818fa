"""Monte-Carlo tables and state reports over trees, nodes and rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["instance_id", "node_key"]


def count() -> Column:
    return F.count(F.lit(1))


def mc_table(rollouts: DataFrame) -> DataFrame:
    """Success rate and number of rollouts a node; a null ``correct`` counts as a rollout but not in the rate."""
    return rollouts.groupBy(*KEYS).agg(F.avg(F.col("correct").cast("double")).alias("mc"), count().alias("n"))


def mc_valid(rollouts: DataFrame) -> DataFrame:
    """Success rate among rollouts that have an outcome, 0 where none has."""
    return rollouts.groupBy(*KEYS).agg(
        F.coalesce(F.try_divide(F.count_if(F.col("correct") == 1), F.count("correct")), F.lit(0.0)).alias("mc"), F.count("correct").alias("n_valid"))


def gated(mc: str | Column = "mc") -> Column:
    """Neither solved nor hopeless."""
    mc = F.col(mc) if isinstance(mc, str) else mc
    return (mc > 0) & (mc < 1)


def is_leaf(mc: str = "mc") -> Column:
    return (F.col("node_key") != "root") & (F.col(mc) == 0)


def latest_rollouts(rollouts: DataFrame) -> DataFrame:
    """Each slot once: of repeated deliveries the one that arrived last."""
    rest = [c for c in rollouts.columns if c not in (*KEYS, "rollout_idx")]
    order = F.struct("arrived_at", "is_consumed", "consumed_iteration", "created_at", "correct", "reward")
    best = rollouts.groupBy(*KEYS, "rollout_idx").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*KEYS, "rollout_idx", *[F.col(f"r.{c}").alias(c) for c in rest])


def tree_summary(trees: DataFrame, nodes: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Trees with counts of their nodes and rollouts; both sides are aggregated before they are joined."""
    n = nodes.groupBy("instance_id").agg(count().alias("n_nodes"))
    r = rollouts.groupBy("instance_id").agg(
        count().alias("n_rollouts"), F.sum(F.col("correct").cast("bigint")).alias("n_correct"), F.sum(F.col("is_consumed").cast("bigint")).alias("n_consumed"),
        F.sum(F.col("submitted").cast("bigint")).alias("n_submitted"), F.avg("reward").alias("avg_reward"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        trees.select("instance_id", "status", "n_rounds", "root_mc").join(n, "instance_id", "left").join(r, "instance_id", "left")
        .select("instance_id", "status", "n_rounds", "root_mc", *[zero(c) for c in ("n_nodes", "n_rollouts", "n_correct", "n_consumed", "n_submitted")], F.round("avg_reward", 6).alias("avg_reward"))
    )


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """Leaves a tree by the cached score."""
    return nodes.filter(is_leaf("mc_score")).groupBy("instance_id").agg(count().alias("n_leaves"))


def with_leaves(trees: DataFrame, nodes: DataFrame) -> DataFrame:
    return trees.select("instance_id", "status").join(leaf_counts(nodes), "instance_id", "left").select("instance_id", "status", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"))


def table_counts(**tables: DataFrame) -> DataFrame:
    """Rows of each table."""
    parts = [df.agg(count().alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report(trees: DataFrame, nodes: DataFrame, rollouts: DataFrame) -> DataFrame:
    """One row of totals and rates over all trees; the mean reward is weighted by rollouts."""
    per_tree = tree_summary(trees, nodes, rollouts).withColumn("w", F.coalesce("avg_reward", F.lit(0.0)) * F.col("n_rollouts"))
    leaves = with_leaves(trees, nodes).agg(F.sum("n_leaves").alias("n_leaves"), F.count_if(F.col("n_leaves") > 0).alias("trees_with_leaf"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = per_tree.agg(count().alias("n_trees"), F.count_if(F.col("status") == "done").alias("n_done"), *[total(c) for c in ("n_nodes", "n_rollouts", "n_correct", "n_consumed", "n_submitted")], F.sum("w").alias("w"))
    rate = lambda part, name: F.round(F.coalesce(F.try_divide(part, F.col("n_rollouts")), F.lit(0.0)), 4).alias(name)
    return sums.crossJoin(leaves).select(  # one row each
        "n_trees", "n_done", "n_nodes", "n_rollouts", "n_correct", "n_consumed", "n_submitted", "n_leaves", "trees_with_leaf",
        rate(F.col("n_correct"), "correct_rate"), rate(F.col("n_submitted"), "submit_rate"), rate(F.col("w"), "mean_reward"))


def run_stats(rollouts: DataFrame) -> DataFrame:
    """Submitted, done and failed rollouts and averages over the successful ones; a rollout without exit status failed."""
    ok = F.col("exit_status").isNotNull()
    return rollouts.agg(
        count().alias("n_total"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"),
        F.round(F.coalesce(F.try_divide(F.count_if(~ok), count()), F.lit(0.0)), 6).alias("fail_rate"),
        F.round(F.avg(F.when(ok, F.col("n_steps"))), 6).alias("avg_steps"), F.round(F.avg(F.when(ok, F.col("reward"))), 6).alias("avg_reward"))


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(count().alias("n"))


#: Reasons in the order in which they are checked; the first that holds is the node's.
def eligibility(nodes: DataFrame, mc: DataFrame, n_steps: Column, key_ok: Column, min_rollouts: int = 3, tolerance: float = 1e-6) -> DataFrame:
    """Each node with the reason why it gives no samples, null if it does."""
    joined = nodes.withColumn("n_steps", n_steps).withColumn("key_ok", key_ok).join(mc, KEYS, "left")
    reason = (
        F.when(F.col("n").isNull() | (F.col("n") == 0), "no_rollouts").when(F.col("n") < min_rollouts, "min_rollouts")
        .when(F.coalesce("n_steps", F.lit(0)) == 0, "empty_prefix").when(~F.col("key_ok"), "key_mismatch").when(F.col("mc_score").isNotNull() & (F.abs(F.col("mc_score") - F.col("mc")) > tolerance), "mc_mismatch")
    )
    return joined.withColumn("skip_reason", reason)
