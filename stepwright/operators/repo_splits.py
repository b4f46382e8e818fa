"""Seeded splits by repository, and checks that no split leaks into another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwright.operators.ordered import hex_bucket, sums_before


def make_splits(instances: DataFrame, seed: int = 42, pool: float = 0.6, dev: float = 0.1, test: float = 0.1) -> DataFrame:
    """(instance_id, repo, gen_pool, prm_split) of every row; all rows of a repository agree.

    Repositories are put in the order of sha1(seed, repo); the first share is the pool, which is cut into
    train, dev and test by numbers rounded half to even, with one repository at least for dev and test
    where there are three or more.  The order is over the distinct repositories only.
    """
    for share in (pool, dev, test):
        if not 0 <= share <= 1:
            raise ValueError("shares must be within 0 and 1")
    repos = instances.select("repo").filter("repo IS NOT NULL").distinct()
    keyed = repos.withColumn("_k", F.sha1(F.concat(F.lit(f"{seed}:"), "repo")))
    placed = sums_before(keyed, hex_bucket(F.col("_k")), ["_k", "repo"], {"at": F.lit(1)}).withColumnRenamed("at_total", "n_repos")
    n = F.bround(F.col("n_repos") * F.lit(pool), 0)
    sized = placed.withColumn("n", n).withColumn("d", F.bround(F.col("n") * F.lit(dev), 0)).withColumn("t", F.bround(F.col("n") * F.lit(test), 0))
    sized = sized.withColumn("d", F.when(F.col("n") >= 3, F.greatest("d", F.lit(1.0))).otherwise(F.col("d"))).withColumn("t", F.when(F.col("n") >= 3, F.greatest("t", F.lit(1.0))).otherwise(F.col("t")))
    tight = (F.col("n") >= 3) & (F.col("d") + F.col("t") > F.col("n") - 1)
    sized = sized.withColumn("d2", F.when(tight, 1.0).otherwise(F.col("d"))).withColumn("t2", F.when(tight, 1.0).otherwise(F.col("t")))
    train = F.col("n") - F.col("d2") - F.col("t2")
    split = F.when(F.col("at") >= F.col("n"), F.lit(None)).when(train < 0, "train").when(F.col("at") < train, "train").when(F.col("at") < train + F.col("d2"), "dev").otherwise("test")
    named = sized.select("repo", (F.col("at") < F.col("n")).alias("gen_pool"), split.alias("prm_split"))
    return instances.select("instance_id", "repo").join(named, "repo", "left").select("instance_id", "repo", F.coalesce("gen_pool", F.lit(False)).alias("gen_pool"), "prm_split")


def split_report(splits: DataFrame) -> DataFrame:
    return splits.groupBy("gen_pool", "prm_split").agg(F.countDistinct("repo").alias("n_repos"), F.count(F.lit(1)).alias("n_instances"))


def leaking(splits: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split."""
    return splits.filter(F.col(split).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def assert_no_leak(splits: DataFrame, key: str, split: str) -> DataFrame:
    """``splits``, if no key is in two splits; else a ValueError with some of them."""
    some = [r[0] for r in leaking(splits, key, split).limit(5).collect()]
    if some:
        raise ValueError(f"{key} in several splits: {some}")
    return splits


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of sha1(seed, key): a sampling operator that every engine can repeat."""
    return df.orderBy(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """(n + 2) // 3 rows of each stratum in hash order, then the first n by stratum and place."""
    order = F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    picked = df.withColumn("_at", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).filter(F.col("_at") <= (n + 2) // 3)
    return picked.orderBy(F.col(stratum).asc_nulls_last(), "_at").limit(n).drop("_at")


def select_instances(instances: DataFrame, splits: DataFrame, ids: list[str] | None = None, count: int | None = None, sample: bool = False, seed: int = 42) -> DataFrame:
    """The instances to search: explicit ids (in their order, outside the pool too; unknown ids raise), else the pool's
    first ``count`` by id, or a seeded sample of them."""
    if ids:
        wanted = instances.sparkSession.createDataFrame(list(enumerate(ids)), "_at int, instance_id string")
        found = wanted.join(instances, "instance_id", "left")
        unknown = [r.instance_id for r in found.filter("repo IS NULL").select("instance_id").collect()]
        if unknown:
            raise ValueError(f"unknown instances: {unknown}")
        return found.orderBy("_at").drop("_at").select(*instances.columns)
    pool = instances.join(splits.filter("gen_pool").select("instance_id").distinct(), "instance_id", "left_semi").select(*instances.columns)
    if count is None:
        return pool
    return hash_sample(pool, "instance_id", count, seed) if sample else pool.orderBy("instance_id").limit(count)
