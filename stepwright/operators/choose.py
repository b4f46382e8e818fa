"""Scores of prefixes gathered into scores of rollouts, and the choice of the best of N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwright.operators import metrics as M

GAMMA = 0.95
LOW = float("-inf")


def rollout_aggregates(scores: DataFrame, keys: list[str], step: str = "t", p: str = "p", gamma: float = GAMMA) -> DataFrame:
    """mean, min, last and discounted mean of the scores of a rollout's prefixes; step 0 is the first."""
    w = F.pow(F.lit(gamma), F.col(step))
    return scores.filter(F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_scores"), F.round(F.avg(p), 6).alias("agg_mean"), F.round(F.min(p), 6).alias("agg_min"), F.round(F.max_by(p, step), 6).alias("agg_last"),
        F.round(F.sum(w * F.col(p)) / F.sum(w), 6).alias("agg_discounted"))


def cap(rollouts: DataFrame, key: str, k: int, order: str = "rollout_idx") -> DataFrame:
    """The first k candidates of each key, all of them where k isn't positive."""
    if k <= 0:
        return rollouts
    return rollouts.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_at") <= k).drop("_at")


def _high(value: Column) -> Column:
    """A value that counts as the least if it is null or not a number."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(LOW)), F.lit(LOW))


def selectors(seed: int = 42) -> dict[str, Column]:
    """The order in which each selector takes candidates; the least comes first, ties by rollout_idx."""
    best = lambda c: F.struct((-_high(F.col(c))).alias("a"), "rollout_idx")
    dice = F.sha1(F.concat_ws(":", F.lit(str(seed)), "instance_id", F.col("rollout_idx").cast("string")))
    return {
        "shortest": F.struct(F.coalesce(F.col("n_steps").cast("double"), F.lit(float("inf"))).alias("a"), "rollout_idx"), "oracle": best("reward"), "prm_mean": best("agg_mean"),
        "prm_min": best("agg_min"), "prm_last": best("agg_last"), "random": F.struct(dice.alias("a"), "rollout_idx"),
    }


def selected(rollouts: DataFrame, names: tuple[str, ...] | None = None, seed: int = 42) -> DataFrame:
    """(instance_id, selector, rollout_idx, reward, correct): what each selector takes; unknown names raise."""
    known = selectors(seed)
    unknown = set(names or ()) - set(known)
    if unknown:
        raise ValueError(f"unknown selectors: {sorted(unknown)}")
    what = F.struct("rollout_idx", "reward", "correct")
    wide = rollouts.groupBy("instance_id").agg(*[F.min_by(what, known[n]).alias(n) for n in names or known])
    names = list(names or known)
    long = wide.select("instance_id", F.explode(F.array(*[F.struct(F.lit(n).alias("selector"), F.col(n).alias("r")) for n in names])).alias("s"))
    return long.select("instance_id", "s.selector", "s.r.rollout_idx", "s.r.reward", "s.r.correct")


def best_of(picked: DataFrame, base: str = "random") -> DataFrame:
    """Per selector: mean reward, share correct, regret against the oracle, and how often it beats or ties ``base``."""
    side = lambda name, alias: picked.filter(F.col("selector") == name).select("instance_id", F.col("reward").alias(alias))
    joined = picked.join(side("oracle", "best"), "instance_id").join(side(base, "base"), "instance_id")
    return joined.groupBy("selector").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("correct_rate"),
        F.round(F.avg(F.col("best") - F.col("reward")), 6).alias("regret"), F.round(F.avg(F.when(F.col("reward") > F.col("base"), 1.0).when(F.col("reward") == F.col("base"), 0.5).otherwise(0.0)), 6).alias("win_rate"),
        F.round(F.avg(F.col("reward") - F.col("base")), 6).alias("mean_difference"))


def paired_intervals(picked: DataFrame, base: str = "random", n_boot: int = 200) -> DataFrame:
    """(selector, measure, low, high, n_boot): interval of the mean difference from ``base``, in reward and in correct.

    Pairs are instances: all selectors are weighed alike in a replicate.  A pair without one of the values is left out, as in best_of.
    """
    other = picked.filter(F.col("selector") == base).select("instance_id", F.col("reward").alias("_reward"), F.col("correct").alias("_correct"))
    gap = lambda c: F.struct(F.lit(c).alias("measure"), (F.col(c).cast("double") - F.col(f"_{c}").cast("double")).alias("gap"))
    pairs = picked.filter(F.col("selector") != base).join(other, "instance_id").select("instance_id", "selector", F.explode(F.array(gap("reward"), gap("correct"))).alias("x"))
    return M.bootstrap_ci(pairs.select("instance_id", "selector", "x.measure", "x.gap"), "instance_id", "gap", n_boot, by=["selector", "measure"])


def candidate_histogram(rollouts: DataFrame, key: str) -> DataFrame:
    """How many keys have how many candidates."""
    return rollouts.groupBy(key).agg(F.count(F.lit(1)).alias("n_candidates")).groupBy("n_candidates").agg(F.count(F.lit(1)).alias("n_keys"))


def usable_pair(scores: DataFrame, pair: str, auc: str, least: float = 0.55) -> DataFrame:
    """The pair with the highest AUC (undefined counts as -1), and whether it is usable."""
    value = F.coalesce(F.nanvl(F.col(auc), F.lit(-1.0)), F.lit(-1.0))
    return scores.agg(F.min_by(F.struct(pair, value.alias("auc")), F.struct((-value).alias("v"), pair)).alias("b")).select(f"b.{pair}", "b.auc", (F.col("b.auc") > least).alias("usable"))
