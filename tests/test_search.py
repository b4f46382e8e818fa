import hashlib

import pytest
from pyspark.sql import functions as F

from stepwright.operators import choose as C
from stepwright.operators import search as G
from stepwright.operators import store as K

ROLL = "instance_id string, node_key string, rollout_idx int, is_consumed int, consumed_iteration int, n_steps int, correct int, reward double, exit_status string"
NODE = "instance_id string, node_key string, mc_score double, visits int, in_pool int"


def test_q_and_selection(spark):
    q = spark.range(1).select(G.q_value(F.lit(0.4), F.lit(4))).first()[0]
    assert q == pytest.approx(0.6150, abs=1e-4)
    nodes = spark.createDataFrame([("t", "root", 1.0, 1, 0), ("t", "n1", 0.8, 0, 1), ("t", "n2", 0.2, 0, 1), ("t", "n3", 0.5, 0, 0)], NODE)
    roll = spark.createDataFrame([("t", n, k, int(n == "n1" and k < 2), None, 4, 1, 1.0, "Submitted") for n in ("root", "n1", "n2", "n3") for k in range(3)], ROLL)
    got = G.qu_select(G.qu_scores(nodes, roll)).first()
    assert (got.node_key, got.rollout_idx) == ("n1", 2)
    assert G.qu_select(G.qu_scores(nodes.limit(0), roll)).count() == 0


@pytest.mark.parametrize("length,base,rates,want", [
    (4, 0, {2: 0.8, 3: 0.2}, [(2, "expanded"), (3, "expanded")]), (4, 0, {2: 0.0, 1: 0.0}, [(1, "leaf"), (2, "leaf")]),
    (4, 0, {2: 1.0}, []), (3, 2, {3: 0.6, 4: 0.0}, [(3, "expanded"), (4, "leaf")]), (1, 0, {}, [])])
def test_bisection(spark, length, base, rates, want):
    sessions = spark.createDataFrame([("s", base, length)], "session string, base int, length int")
    table = spark.createDataFrame([("s", k, v) for k, v in rates.items()], "session string, probe int, mc double")
    assert sorted((r.probe, r.kind) for r in G.bisect(sessions, table).collect()) == want


def test_slots_budget_and_tasks(spark):
    nodes = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "instance_id string, node_key string")
    roll = spark.createDataFrame([("t", "a", 0, 1), ("t", "a", 2, 0), ("t", "a", 2, 1), ("u", "a", 9, 1)], "instance_id string, node_key string, rollout_idx int, correct int")
    missing = G.missing_slots(nodes, roll, 3)
    assert sorted(map(tuple, missing.collect())) == [("t", "a", 1), ("t", "b", 0), ("t", "b", 1), ("t", "b", 2), ("u", "a", 0), ("u", "a", 1), ("u", "a", 2)]
    arrays = {(r.instance_id, r.node_key): r.slots for r in G.slot_array(nodes, roll, 3, "correct").collect()}
    assert arrays[("t", "a")] == [1, None, 1] and not any(arrays[("t", "b")] or [])
    asked = missing.groupBy("instance_id", "node_key").agg(F.count(F.lit(1)).alias("n"))
    allowed = {(r.instance_id, r.node_key): r.allowed for r in G.allocate(asked, ["node_key"], budget=5, per_instance=3).collect()}
    left, want = 5, {}
    for i in sorted("tu", key=lambda x: hashlib.md5(x.encode()).hexdigest()):
        own = 3
        for node, n in ((k[1], n) for k, n in {("t", "a"): 1, ("t", "b"): 3, ("u", "a"): 3}.items() if k[0] == i):
            want[i, node] = min(n, own, left)
            own, left = own - min(n, own), left - want[i, node]
    assert allowed == want and sum(want.values()) == 5
    tasks = spark.createDataFrame([("x", 1, 5), ("y", 0, 9), ("x", 1, 2)], "task_id string, priority int, seq int")
    assert [tuple(r) for r in G.task_order(tasks).collect()] == [("y", 0, 9), ("x", 1, 2)]


def test_the_loop_consumes_each_rollout_once(spark):
    trees = spark.createDataFrame([("t", "running", 0), ("d", "done", 0)], "instance_id string, status string, n_rounds int")
    nodes = spark.createDataFrame([(i, n, 0.5, 0, p) for i in ("t", "d") for n, p in (("root", 0), ("n1", 0))], NODE)
    roll = spark.createDataFrame([(i, n, k, 0, None, 2, k, 1.0, "Submitted") for i in ("t", "d") for n in ("root", "n1") for k in range(2)], ROLL)
    t, n, r = G.annotate(trees, nodes, roll, lambda picked: picked.select("instance_id", F.lit("n1").alias("node_key")), max_rounds=5)
    assert {x.instance_id: x.n_rounds for x in t.collect()} == {"t": 2, "d": 0}
    assert r.filter("instance_id = 't' AND is_consumed = 1").count() == 4 and r.filter("instance_id = 'd' AND is_consumed = 1").count() == 0
    assert {(x.node_key, x.visits, x.in_pool) for x in n.filter("instance_id = 't'").collect()} == {("root", 2, 0), ("n1", 2, 1)}


def test_upsert_keeps_the_ledger_and_is_idempotent(spark):
    old = spark.createDataFrame([("t", "a", 0, 1, 7, 2, 0, 0.1, None), ("t", "a", 1, 0, None, 2, 0, 0.1, None)], ROLL)
    new = spark.createDataFrame([("t", "a", 0, 0, None, 5, 1, 0.9, "Submitted"), ("t", "b", 0, 0, None, 1, 1, 1.0, "Submitted")], ROLL)
    once = K.upsert(old, new)
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, K.upsert(once, new).collect()), key=repr)
    got = {(r.node_key, r.rollout_idx): (r.is_consumed, r.consumed_iteration, r.reward) for r in once.collect()}
    assert got == {("a", 0): (1, 7, 0.9), ("a", 1): (0, None, 0.1), ("b", 0): (0, None, 1.0)}
    ins = K.insert_ignore(old, new, K.SLOT)
    assert ins.count() == 3 and ins.filter("inserted").first().node_key == "b"
    assert K.is_legacy({"annotations": set()}) and not K.is_legacy({"rollouts": {"is_consumed"}})
    updated = K.update(old, spark.createDataFrame([("t", "a", 1, 0.5)], "instance_id string, node_key string, rollout_idx int, reward double"), K.SLOT, ["reward"])
    assert sorted(r.reward for r in updated.collect()) == [0.1, 0.5]


def test_versions_appear_once(spark, tmp_path):
    df = spark.range(3)
    path = K.replace_version(df, str(tmp_path), 1)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        K.replace_version(df, str(tmp_path), 1)


def test_choice_of_candidates(spark):
    agg = C.rollout_aggregates(spark.createDataFrame([("r", 0, 0.2), ("r", 1, 0.4), ("r", 2, 0.9), ("r", 3, None)], "k string, t int, p double"), ["k"]).first()
    assert (agg.agg_mean, agg.agg_min, agg.agg_last) == (0.5, 0.2, 0.9) and agg.agg_discounted == pytest.approx(0.48808, abs=1e-5)
    rows = [("i", 3, 0.1, 0, 2, 0.9), ("i", 0, 0.5, 1, 5, float("nan")), ("i", 1, 0.5, 1, 2, None), ("j", 2, None, 0, None, None)]
    df = spark.createDataFrame([(*r, r[5], r[5]) for r in rows], "instance_id string, rollout_idx int, reward double, correct int, n_steps int, agg_mean double, agg_min double, agg_last double")
    got = {(r.instance_id, r.selector): r.rollout_idx for r in C.selected(df).collect()}
    assert (got["i", "shortest"], got["i", "oracle"], got["i", "prm_mean"], got["j", "oracle"]) == (1, 0, 3, 2)
    with pytest.raises(ValueError, match="unknown"):
        C.selected(df, ("best",))
    capped = C.cap(spark.createDataFrame([("i", k) for k in (3, 0, 4, 1, 2, 6, 5)], "instance_id string, rollout_idx int"), "instance_id", 5)
    assert sorted(r.rollout_idx for r in capped.collect()) == [0, 1, 2, 3, 4]
    pair = C.usable_pair(spark.createDataFrame([("a", 0.5), ("b", float("nan")), ("c", 0.6)], "pair string, auc double"), "pair", "auc").first()
    assert (pair.pair, pair.usable) == ("c", True)


def test_long_rollouts_count_by_their_first_steps(spark):
    from stepwright.plans import contracts

    columns = "instance_id string, node_key string, rollout_idx int, is_consumed int, n_steps int, correct int, reward double, exit_status string, submitted int"
    rows = [("a", "root", i, 0, n, i % 2, i / 4, "Submitted", 1) for i, n in enumerate((3, 32, 33, 90, 0))]
    r = spark.createDataFrame(rows, columns)
    assert contracts._trajectory(r).first().n == 4
    short = spark.createDataFrame([(*x[:4], min(x[4], 32), *x[5:]) for x in rows], columns)
    same = lambda d: sorted((x.rollout_idx, x.scored_steps, x.agg_mean, x.agg_last, x.scores) for x in contracts._frame_rows(d).collect())
    assert same(r) == same(short)


def scripted(tasks):
    """Rollouts of the missing slots; those of tree x never have an outcome."""
    right = (F.abs(F.hash("instance_id", "rollout_idx")) % 2).cast("int")
    return tasks.filter("instance_id <> 'x'").select("instance_id", "node_key", "rollout_idx", F.lit(0).alias("is_consumed"), F.lit(None).cast("int").alias("consumed_iteration"), F.lit(2).alias("n_steps"), right.alias("correct"), right.cast("double").alias("reward"), F.lit("Submitted").alias("exit_status"))


def pipeline_state(spark):
    trees = spark.createDataFrame([(t, "not_started" if t != "d" else "done", 0) for t in ("a", "b", "c", "x", "d")], "instance_id string, status string, n_rounds int")
    nodes = spark.createDataFrame([(t, "root", None, 0, 0) for t in ("a", "b", "c", "x", "d")], NODE)
    return trees, nodes, spark.createDataFrame([], ROLL)


def test_a_pipeline_that_is_stopped_goes_on_to_the_same_end(spark):
    run = lambda state, **limits: G.pipeline(*state, execute=scripted, expand=lambda picked: picked.select("instance_id", "node_key"), n_slots=4, **limits)
    end = run(pipeline_state(spark))
    names = {r.instance_id: r.status for r in end[0].collect()}
    assert names == {"a": "done", "b": "done", "c": "done", "x": "failed", "d": "done"}
    consumed = {(r.instance_id, r.rollout_idx) for r in end[2].filter("is_consumed = 1").collect()}
    assert consumed and end[2].filter("instance_id = 'd'").count() == 0
    trees, nodes, rollouts = run(pipeline_state(spark), most_sessions=1)
    assert {r.instance_id: r.status for r in trees.collect()} == names | {"a": "budget_exhausted", "c": "budget_exhausted"}
    again = run((trees.select("instance_id", "status", "n_rounds"), nodes, rollouts))
    assert {r.instance_id: r.status for r in again[0].collect()} == names
    assert {(r.instance_id, r.rollout_idx) for r in again[2].filter("is_consumed = 1").collect()} == consumed
    pool = {(r.instance_id, r.n_consumed + r.n_open) for r in G.resumed(pipeline_state(spark)[0], end[1], end[2]).collect()}
    assert pool == {("a", 4), ("b", 4), ("c", 4), ("x", 0)}
