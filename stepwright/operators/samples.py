"""Labelled step samples from nodes: eligibility, labels, priority dedupe, statistics."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.operators import mc as M

#: Weight of the success rate in a mixed label; the rest goes to its rounding.
SOFT_WEIGHT = 0.2
#: Which label wins among samples of the same prefix.
PRIORITY = {"node_mc": 2, "leaf_chain": 1}


def binary(mc: Column) -> Column:
    return (mc > 0.5).cast("int")


def mixed(mc: Column, weight: float = SOFT_WEIGHT) -> Column:
    return binary(mc) * F.lit(1 - weight) + mc * F.lit(weight)


def n_steps(prefix_json: str = "prefix_json") -> Column:
    """Steps of a prefix; null where the JSON is cut off or no list."""
    return F.json_array_length(prefix_json)


def content_key(prefix: str) -> str:
    """The key under which a tree has a prefix: root, or n_ and 16 hex digits over its steps' JSON."""
    steps = json.loads(prefix)
    if not steps:
        return "root"
    said = "".join(json.dumps(s, sort_keys=True, ensure_ascii=False) for s in steps)
    return "n_" + hashlib.sha1(said.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def key_matches(node_key: str = "node_key", prefix_json: str = "prefix_json") -> Column:
    """Whether a node's key is that of its prefix; null where the prefix gives no steps."""
    @F.pandas_udf("boolean")
    def same(key: pd.Series, prefix: pd.Series) -> pd.Series:
        def one(k: str | None, p: str | None) -> bool | None:
            try:
                return None if p is None else content_key(p) == k
            except (ValueError, TypeError):
                return None

        return pd.Series([one(k, p) for k, p in zip(key, prefix, strict=True)], dtype="object")

    return same(F.col(node_key), F.when(n_steps(prefix_json) > 0, F.col(prefix_json)))


def node_samples(nodes: DataFrame, rollouts: DataFrame, splits: DataFrame, trees: DataFrame, min_rollouts: int = 3) -> DataFrame:
    """Samples of the eligible nodes of finished trees with a split and a head.

    A leaf gives a chain of samples, one a step, right but for the last; any other node one sample at its
    last step.  Keys are joined and filtered before the prefixes are counted, so no message moves.
    """
    live = trees.filter("status = 'done' AND messages_head_json IS NOT NULL").select("instance_id")
    placed = splits.filter("prm_split IS NOT NULL").select("instance_id", "repo", "prm_split").dropDuplicates(["instance_id"])
    slim = nodes.withColumn("n_steps", n_steps()).withColumn("key_ok", key_matches()).select("instance_id", "node_key", "mc_score", "visits", "in_pool", "n_steps", "key_ok", "created_at", F.xxhash64("prefix_json").alias("prefix_hash"))
    latest = slim.groupBy("instance_id", "node_key").agg(F.max_by(F.struct("mc_score", "visits", "in_pool", "n_steps", "key_ok", "prefix_hash"), F.struct("created_at", "visits", "in_pool", "mc_score", "n_steps", "prefix_hash")).alias("r")).select("instance_id", "node_key", "r.*")
    judged = M.eligibility(latest, M.mc_table(rollouts), F.col("n_steps"), F.col("key_ok"), min_rollouts).withColumnRenamed("n_steps", "steps")
    good = judged.filter("skip_reason IS NULL").join(live, "instance_id", "left_semi").join(placed, "instance_id")
    leaf = M.is_leaf("mc")
    steps = F.when(leaf, F.sequence(F.lit(1), F.col("steps"))).otherwise(F.array("steps"))
    chain = F.when(F.col("step_index") == F.col("steps"), 0.0).otherwise(1.0)
    out = good.withColumn("step_index", F.explode(steps)).withColumn("label", F.when(leaf, chain).otherwise(mixed(F.col("mc"))))
    out = out.withColumn("label_source", F.when(leaf, "leaf_chain").otherwise("node_mc"))
    return out.select("instance_id", "repo", "prm_split", "node_key", "step_index", "steps", "label", "label_source", "mc", "n", "visits", "in_pool", "prefix_hash")


def dedupe(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One sample for each key: the source of the highest priority, then the first in ``order``.

    The choice is made by an aggregate that combines on the map side, so many copies cost little.
    """
    rank = F.lit(0)
    for name, value in PRIORITY.items():
        rank = F.when(F.col("label_source") == name, -value).otherwise(rank)
    rest = [c for c in samples.columns if c not in keys]
    best = samples.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, *order)).alias("_s"))
    return best.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def dedupe_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Samples by source before and after, and how many fell away."""
    a = before.groupBy("label_source").agg(F.count(F.lit(1)).alias("before"))
    b = after.groupBy("label_source").agg(F.count(F.lit(1)).alias("after"))
    return a.join(b, "label_source", "left").select("label_source", "before", F.coalesce("after", F.lit(0)).alias("after"), (F.col("before") - F.coalesce("after", F.lit(0))).alias("collisions"))


def label_distribution(samples: DataFrame, split: str, label: str, hit: Column) -> DataFrame:
    """Per split, also those without samples: count, in all and by source, share of positives, mean label."""
    spark = samples.sparkSession
    every = spark.createDataFrame([(s,) for s in ("train", "dev", "test")], f"{split} string")
    sources = [F.count_if(F.col("label_source") == s).alias(f"n_{s}") for s in PRIORITY]
    found = samples.groupBy(split).agg(F.count(F.lit(1)).alias("n"), *sources, F.avg(hit.cast("double")).alias("pos_rate"), F.avg(label).alias("mean_label"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(found, split, "left").select(split, *[count(c) for c in ("n", *[f"n_{s}" for s in PRIORITY])], zero("pos_rate"), zero("mean_label"))


def class_weights(samples: DataFrame, label: str, cap: float = 4.0) -> DataFrame:
    """(w_pos, w_neg): the negative weight is positives over negatives, at most ``cap``; 1 and 1 without samples or negatives."""
    counts = samples.agg(F.count(label).alias("n"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    weight = F.when((F.col("n") == 0) | (F.col("neg") == 0), 1.0).otherwise(F.least(F.lit(float(cap)), F.try_divide(F.col("pos").cast("double"), F.greatest("neg", F.lit(1)))))
    return counts.select(F.lit(1.0).alias("w_pos"), F.round(weight, 6).alias("w_neg"))


def length_stats(samples: DataFrame, tokens: str, by: str, limits: tuple[int, ...] = (4096, 8192, 16384)) -> DataFrame:
    """Length statistics per ``by``: extremes, mean, interpolated percentiles cut to integers, and the share within each limit."""
    p = lambda q: F.floor(F.percentile(tokens, F.lit(q))).cast("bigint").alias(f"p{round(q * 100)}")
    return samples.filter(F.col(tokens).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min(tokens).cast("bigint").alias("min"), F.max(tokens).cast("bigint").alias("max"), F.round(F.avg(tokens), 6).alias("mean"),
        *[p(q) for q in (0.5, 0.75, 0.9, 0.95, 0.99)], *[F.round(F.avg((F.col(tokens) <= m).cast("double")), 6).alias(f"within_{m}") for m in limits])


def ordered(samples: DataFrame, split: str) -> DataFrame:
    """Samples in their fixed order: train, dev, test, then instance, step, node, source."""
    rank = F.when(F.col(split) == "train", 0).when(F.col(split) == "dev", 1).when(F.col(split) == "test", 2).otherwise(3)
    return samples.orderBy(rank, "instance_id", "step_index", "node_key", "label_source")


def sample_id() -> Column:
    return F.concat_ws("::", "instance_id", "node_key", F.col("step_index").cast("string"))


def manifest(samples: DataFrame, split: str) -> DataFrame:
    """Counts as (section, key, value)."""
    parts = [
        samples.groupBy(F.col(split).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("section", F.lit("split")),
        samples.groupBy(F.col("label_source").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("section", F.lit("source")),
        samples.agg(F.countDistinct("instance_id").cast("double").alias("value")).select(F.lit("instances").alias("key"), "value", F.lit("distinct").alias("section")),
    ]
    out = parts[0].select("section", "key", "value")
    for part in parts[1:]:
        out = out.unionByName(part.select("section", "key", "value"))
    return out
