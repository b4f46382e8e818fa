import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepwright.operators import metrics as M


def frame(spark, pairs):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(pairs)], "i int, y int, s double")


def test_auc_facts(spark):
    auc = lambda pairs: M.roc_auc(frame(spark, pairs), "y", "s").first()
    assert auc([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]).auc == 0.75
    assert auc([(0, 0.5), (1, 0.5)]).auc == 0.5 and auc([(1, 0.5), (1, 0.7)]).auc is None and auc([]).auc is None


def test_against_numpy(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(2), round(rnd.random(), 2)) for _ in range(400)]
    df, y, s = frame(spark, pairs), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    wins = sum((a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]) / ((y == 1).sum() * (y == 0).sum())
    assert M.roc_auc(df.repartition(7), "y", "s").first().auc == pytest.approx(wins, abs=1e-6)
    order = sorted(range(len(pairs)), key=lambda i: (-s[i], i))
    hits = np.cumsum(y[order])
    want = np.mean([hits[k] / (k + 1) for k in range(len(order)) if y[order[k]] == 1])
    assert M.pr_auc(df.repartition(5), "y", "s", "i").first().pr_auc == pytest.approx(want, abs=1e-6)
    bins = np.digitize(s, np.linspace(0, 1, 11)[1:-1], right=True)
    got = [(r.bin, r.n) for r in M.calibration(df, "y", "s").orderBy("bin").collect()]
    assert got == [(b, int((bins == b).sum())) for b in range(10)]
    ece = sum((bins == b).mean() * abs(s[bins == b].mean() - y[bins == b].mean()) for b in range(10) if (bins == b).any())
    assert M.ece(df, "y", "s").first().ece == pytest.approx(ece, abs=1e-6)
    assert df.agg(M.pearson(F.col("y"), F.col("s"))).first()[0] == pytest.approx(np.corrcoef(y, s)[0, 1])
    ranks = {r.i: r.avg_rank for r in M.average_ranks(df, "i", "s").collect()}
    assert all(ranks[i] == (s < s[i]).sum() + ((s == s[i]).sum() + 1) / 2 for i in range(len(s)))


def test_small_facts(spark):
    b = frame(spark, [(1, 0.8), (0, 0.2), (1, 0.4)]).agg(M.brier("y", "s")).first()[0]
    assert b == pytest.approx((0.04 + 0.04 + 0.36) / 3)
    assert M.ece(frame(spark, [(1, 1.0), (0, 1.0)]), "y", "s").first().ece == 0.5
    c = M.class_metrics(frame(spark, [(1, 0.9), (0, 0.8), (1, 0.3), (0, 0.1)]), "y", "s").first()
    assert (c.tp, c.fp, c.tn, c.fn, c.accuracy, c.f1) == (1, 1, 1, 1, 0.5, 0.5)
    empty = M.class_metrics(frame(spark, []), "y", "s").first()
    assert (empty.tp, empty.accuracy, empty.precision) == (0, None, 0.0)
    flat = frame(spark, [(1, 0.5), (0, 0.5)]).agg(M.pearson(F.col("y"), F.col("s"))).first()[0]
    assert flat is None
    one = spark.createDataFrame([(7, 12, 25, 9000)], "a int, b int, c int, t int")
    got = one.select(M.position_bucket("a"), M.position_bucket("b"), M.position_bucket("c"), M.length_bucket("t"), M.relative_bucket("a", "b")).first()
    assert tuple(got) == ("6-10", "11-15", "21+", "8-12K", "[50%,60%]")
    half = spark.createDataFrame([(5, 10), (1, 0), (None, 3)], "i int, n int").select(M.relative_bucket("i", "n")).collect()
    assert [r[0] for r in half] == ["[40%,50%]", "nan", "nan"]


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(300)], "i int, v double")
    a, b = (M.bootstrap_ci(df.repartition(p), "i", "v", n_boot=60).first() for p in (1, 4))
    assert a == b and a.low < 0.5 < a.high and a.high - a.low < 0.2


def test_loss_is_stable(spark):
    df = spark.createDataFrame([(1.0, 800.0), (0.0, -800.0), (0.0, 0.0)], "y double, z double")
    assert df.agg(M.soft_bce("y", "z")).first()[0] == pytest.approx(np.log(2) / 3)


def test_paired_intervals_truncated_buckets_and_keys(spark):
    import hashlib
    import json

    from stepwright.operators import choose as C
    from stepwright.operators import mc as MC
    from stepwright.operators import samples as D
    from stepwright.plans import evaluation

    picked = [(f"i{i}", s, r, int(r > 0.5)) for i in range(40) for s, r in (("random", 0.25 + i % 3 / 8), ("oracle", 0.75 + i % 3 / 8), ("shortest", 0.25 + i % 5 / 8))]
    rows = {(r.selector, r.measure): (r.low, r.high) for r in C.paired_intervals(spark.createDataFrame(picked, "instance_id string, selector string, reward double, correct int")).collect()}
    assert set(rows) == {(s, m) for s in ("oracle", "shortest") for m in ("reward", "correct")}
    assert rows["oracle", "reward"] == (0.5, 0.5) and rows["shortest", "reward"][0] < 0.125 < rows["shortest", "reward"][1]
    step = {"tail": [], "assistant": {"role": "assistant", "content": "é"}}
    key = "n_" + hashlib.sha1(json.dumps(step, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    text = json.dumps([step])
    nodes = spark.createDataFrame([("a", key, 0.5, text), ("a", "n_0", 0.5, text), ("a", "root", None, "[]"), ("a", "n_1", 0.5, text[:9])], "instance_id string, node_key string, mc_score double, prefix_json string")
    mc = spark.createDataFrame([("a", k, 0.5, 3) for k in (key, "n_0", "root", "n_1")], "instance_id string, node_key string, mc double, n long")
    got = {r.node_key: r.skip_reason for r in MC.eligibility(nodes, mc, D.n_steps(), D.key_matches()).collect()}
    assert got == {key: None, "n_0": "key_mismatch", "root": "empty_prefix", "n_1": "empty_prefix"}
    assert {"truncated_buckets", "dev_brier"} <= set(evaluation.QUERIES)


def test_spearman_with_most_rows_on_one_value(spark):
    import numpy as np
    import pandas as pd

    rnd = np.random.default_rng(5)
    x = np.where(rnd.random(3000) < 0.6, 1.0, rnd.integers(0, 9, 3000))
    y = np.where(rnd.random(3000) < 0.5, 2.0, rnd.integers(0, 5, 3000) + x)
    df = spark.createDataFrame(pd.DataFrame({"k": range(3000), "x": x, "y": y}))
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    got = M.spearman(df, "k", "x", "y").first()
    assert abs(got.spearman - want) < 1e-6 and got.n == 3000
    assert M.spearman(df.withColumn("y", F.lit(1.0)), "k", "x", "y").first().spearman is None and M.spearman(df.limit(0), "k", "x", "y").first().n == 0


def test_an_interval_of_the_auc(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), ((F.hash("id") % 50) / 50.0 + F.col("id") % 2 * 0.3).alias("s"))
    auc = M.roc_auc(df, "y", "s").first().auc
    got = M.bootstrap_metric(df, "id", ["y", "s"], lambda rows, w, by: M.roc_auc(rows, "y", "s", by, w), "auc", n_boot=60).first()
    assert got.n_boot == 60 and got.low < auc < got.high and got.high - got.low < 0.2
