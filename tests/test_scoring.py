import pytest
from pyspark.sql import functions as F

from stepwright.operators import scoring as Q
from stepwright.operators import steps as S
from stepwright.operators import store as K


def test_scores_and_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "boom"), (3, "boom")], "k int, t string")
    assert {r.k for r in Q.score(df, ["k"], "t").filter("score BETWEEN 0 AND 1").collect()} == {1, 2, 3}

    def picky():
        def scorer(pdf):
            if (pdf["text"] == "boom").any():
                raise ValueError("boom")
            return pdf["text"].fillna("").str.len() / 10
        return scorer

    good, skipped = Q.score_or_skip(df.coalesce(1), ["k"], "t", picky)
    assert sorted((r.k, r.score) for r in good.collect()) == [(1, 0.1), (2, 0.0)] and skipped.first().n_skipped == 2
    assert Q.score(df.limit(0), ["k"], "t").count() == 0
    with pytest.raises(ValueError):
        Q.register("closed_form", picky)


def test_scripted_results_are_the_same_every_time(spark):
    tasks = spark.range(400).selectExpr("'i' AS instance_id", "concat('n', id % 7) AS node_key", "cast(id AS int) AS rollout_idx")
    a, b = (sorted(map(tuple, Q.scripted_rollouts(tasks.repartition(p), 0.3, 0.2).collect())) for p in (1, 6))
    assert a == b and 280 < len(a) < 360 and 0.2 < sum(r[3] for r in a) / len(a) < 0.4


def test_small_parts(tmp_path):
    assert Q.template_hash("a", "b") != Q.template_hash("ab") and len(Q.template_hash()) == 40
    (tmp_path / "s.db").write_text("x")
    assert K.keep_aside(str(tmp_path / "s.db")).endswith("s.db.bak1") and K.keep_aside(str(tmp_path / "s.db")) is None


def test_light_trajectories_hold_every_message(spark):
    import json

    extra = {"actions": [{"command": "ls"}], "raw_output": "a", "returncode": 1, "exit_status": "s", "submission": "d", "exception_info": "e", "response": {"big": 1}, "interrupt_type": "x"}
    said = {"role": "assistant", "content": "c", "tool_calls": []}
    steps = [{"assistant": said | {"extra": extra}, "tail": [{"role": "tool", "content": None, "tool_call_id": "i", "extra": {}}, {"role": "user", "content": "u"}]}, {"assistant": said, "tail": None}]
    text = json.dumps(steps)
    df = spark.createDataFrame([(1, text), (2, json.dumps(text)), (3, text[:-9]), (4, None), (5, "[]"), (6, '"x"')], "k int, j string")
    rows = Q.light_trajectory(df, ["k"], "j").collect()
    want = [(1, 0, "assistant", "c", None, '[{"command":"ls"}]', "a", "1", "s", "d", "e"), (1, 1, "tool", None, "i"), (1, 2, "user", "u", None), (2, 0, "assistant", "c", None)]
    for k in (1, 2):
        assert sorted(tuple(r)[1:] for r in rows if r.k == k) == [w + (None,) * (11 - len(w)) for w in want]
    assert {r.k for r in rows} == {1, 2} and rows[0].__fields__[3:] == [*Q.LIGHT_TOP, *Q.LIGHT_EXTRA]
    assert set(Q.light_message()) == {*Q.LIGHT_TOP, *Q.LIGHT_EXTRA, "interrupt_type"}


def test_long_rollouts_count_by_their_first_prefixes(spark):
    rows = [("a", "root", k, n) for k, n in enumerate([40, 3, 0, 33, 1, 2, 9])] + [("b", "root", 0, 32), ("b", "n_x", 1, 5)]
    df = spark.createDataFrame(rows, "instance_id string, node_key string, rollout_idx int, n_steps int")
    key = ["instance_id", "node_key", "rollout_idx"]
    frame = Q.trajectory_frame(df, key, lambda p: p.withColumn("p", F.when(F.col("t") % 7 != 5, F.col("t") / 100.0)))
    got = {(r.instance_id, r.rollout_idx): r for r in frame.collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 3), ("a", 4), ("b", 0)}  # five candidates, one without steps
    want = [t / 100 for t in range(32) if t % 7 != 5]
    assert got["a", 0].scores == got["a", 3].scores == got["b", 0].scores == want and got["a", 0].n_scores == len(want) and got["a", 0].agg_last == 0.31
    assert got["a", 1].scores == [0, 0.01, 0.02]


def test_the_last_exit_message(spark):
    kind = "array<struct<role:string,content:string,extra:struct<exit_status:string,submission:string>>>"
    rows = [[("exit", "", ("a", "b")), ("user", "x", None), ("exit", "", ("Submitted", None))], [("user", "x", None)], [("exit", "", None)], []]
    df = spark.createDataFrame([(r,) for r in rows], f"m {kind}")
    assert [tuple(r.e) for r in df.select(S.exit_pair("m").alias("e")).collect()] == [("Submitted", ""), ("", ""), ("", ""), ("", "")]
