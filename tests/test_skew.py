import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from stepwright.operators import skew

DAY = dt.datetime(2025, 1, 1)


def instances(spark, rows):
    return spark.createDataFrame(rows, "repo string, use_patch boolean, loaded_at timestamp_ntz, instance_id string, source string, n_rows int")


def test_counts_rates_and_latest_rows_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(3000):
        repo = rnd.choice(["hot"] * 6 + ["warm"] * 2 + [None, ""] + [f"r{j}" for j in range(20)])
        rows.append((repo, rnd.choice([True, False, None]), rnd.choice([None, DAY, DAY + dt.timedelta(rnd.randrange(9))]), f"i{i % 700:04}", "s", 1))
    got = {r.key_value: r for r in skew.repo_stats(instances(spark, rows)).collect()}
    assert {k: r.n_rows for k, r in got.items()} == dict(Counter(r[0] for r in rows))
    for repo, r in got.items():
        own = [x for x in rows if x[0] == repo]
        judged = [x for x in own if x[1] is not None]
        assert (r.n_judged, r.n_success) == (len(judged), sum(x[1] for x in judged))
        last = max(own, key=lambda x: (x[2] is not None, x[2] or DAY, x[3]))
        assert r.latest_row == last[3]


def test_a_key_of_equal_rows_is_cut_into_several_partitions(spark):
    df = spark.range(0, 20000, 1, 8).select(F.lit("k").alias("key"), F.lit(1).alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in skew.spread(df, "key", ["o"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 20000 * 0.75
    assert skew.per_key(df, "key", ["o"], [F.count(F.lit(1)).alias("n")]).collect()[0].n == 20000


def test_heavy_keys_leave_out_null_and_empty_tables_work(spark):
    rows = [(None, True, DAY, "a", "s", 1)] * 50 + [("x", True, DAY, "a", "s", 1)] * 4 + [("y", True, DAY, "a", "s", 1)] * 3 + [("z", True, DAY, f"b{i}", "s", 1) for i in range(43)]
    df = instances(spark, rows)
    assert sorted(r.key_value for r in skew.heavy_keys(skew.repo_stats(df), 100).collect()) == ["x", "z"]
    assert skew.heavy_keys(skew.repo_stats(df.limit(0)), 0).count() == 0
    rollouts = spark.createDataFrame([], "instance_id string, correct int, arrived_at timestamp_ntz, created_at double, node_key string, rollout_idx int")
    assert skew.rollout_stats(rollouts).count() == 0


def test_a_share_that_is_met_exactly(spark):
    rows = [("x", True, DAY, f"i{i}", "s", 1) for i in range(7)] + [(f"r{i}", True, DAY, f"j{i}", "s", 1) for i in range(168)]
    stats = skew.repo_stats(instances(spark, rows))
    assert [r.key_value for r in skew.heavy_keys(stats, 175).collect()] == ["x"]
