import random

from pyspark.sql import functions as F

from stepwright.operators.ordered import hex_bucket, sums_before, value_bucket


def test_sums_before_against_a_loop(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([rnd.random(), float("inf"), -3.0]), rnd.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, g string, v double, n int").repartition(5)
    got = {r.i: (r.s, r.s_total) for r in sums_before(df, value_bucket(df, "v"), ["v", "i"], {"s": "n"}, ["g"]).collect()}
    for i, g, v, _ in rows:
        own = [r for r in rows if r[1] == g]
        assert got[i] == (sum(r[3] for r in own if (r[2], r[0]) < (v, i)), sum(r[3] for r in own))
    empty = df.limit(0)
    assert sums_before(empty, value_bucket(empty, "v"), ["v"], {"s": "n"}).count() == 0


def test_hex_buckets_keep_the_order(spark):
    df = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("k"))
    rows = df.withColumn("b", hex_bucket(F.col("k"))).orderBy("k").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and max(r.b for r in rows) < 4096
