import json
import random

import pytest
from pyspark.sql import functions as F

from stepwright.operators import builder as B
from stepwright.operators import steps as S
from stepwright.operators import truncate as T

MESSAGES = "array<struct<role:string,content:string,reasoning_content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>>"


def message(role, content):
    return (role, content, None, None, "i" if role == "tool" else None)


def fit(messages, limit, mark, keep):
    """The same by trying every number of steps to drop."""
    size = lambda ms: sum(len(f"{r}: {c}") + 1 for r, c in ms)
    clip = lambda ms: [(r, c[:keep] + T.MARK if r == "tool" and len(c) > keep else c) for r, c in ms]
    starts = [i for i, (r, _) in enumerate(messages) if r == "assistant"]
    if size(messages) <= limit:
        return "fits", 0, messages
    head = messages[: starts[0]] if starts else messages
    options = [(s - starts[0], (head + [("user", mark)] if s > starts[0] else head) + messages[s:]) for s in starts] or [(0, messages)]
    for dropped, kept in options:
        if size(head) + size([("user", mark)]) <= limit and size(head) + size([("user", mark)]) + size(messages[starts[0] + dropped :] if starts else []) <= limit and starts:
            return "steps_dropped", dropped, kept
    dropped, kept = options[-1]
    good = size(head) + size([("user", mark)]) <= limit and size(clip(kept)) <= limit
    return "tools_clipped" if good else "unfittable", dropped, clip(kept)


def test_fitting_against_trying_all(spark):
    rnd, rows, want = random.Random(3), [], {}
    for k in range(300):
        ms = [("user", "u" * rnd.choice([1, 10, 60]))] * rnd.randrange(2)
        for _ in range(rnd.randrange(5)):
            ms += [("assistant", "a" * rnd.choice([1, 20, 50]))] + [(rnd.choice(["tool", "tool", "user"]), "t" * rnd.choice([0, 5, 40, 90])) for _ in range(rnd.randrange(3))]
        if ms:
            rows.append((k, [message(*m) for m in ms]))
            want[k] = fit(ms, 120, "cut", 7)
    df = spark.createDataFrame(rows, f"k int, messages {MESSAGES}").repartition(3)
    got = {r.k: (r.f.outcome, r.f.n_dropped, [(m.role, m.content) for m in r.f.messages]) for r in df.select("k", B.fitted("messages", 120, "cut", 7).alias("f")).collect()}
    assert got == want and {w[0] for w in want.values()} == set(T.OUTCOMES)


def test_prefixes_read_and_written_again(spark):
    steps = [{"assistant": {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "type": "function", "function": {"name": "bash", "arguments": '{"b": 1, "a": "é"}'}}], "extra": {"x": 1}}, "tail": [{"role": "tool", "tool_call_id": "c", "content": "o"}]}, {"assistant": {"role": "assistant", "content": "x"}}]
    texts = [json.dumps(steps), json.dumps(json.dumps(steps)), "[]", '{"a": 1}', json.dumps(steps)[:-5], None, "", '"plain"']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, j string").withColumn("s", B.parsed_steps("j"))
    rows = {r.k: r for r in df.withColumn("t", B.parsed_steps(B.stored_steps(F.col("s")))).collect()}
    assert [k for k, r in rows.items() if r.s is not None] == [0, 1, 2] and all(r.s == r.t for r in rows.values())
    assert rows[0].s == rows[1].s and rows[0].s[0].tail[0].content == "o" and rows[0].s[1].tail is None and rows[2].s == []
    args = df.filter("k = 0").select(B.sorted_arguments(F.transform("s", lambda s: s["assistant"])).alias("m")).first().m
    assert json.loads(args[0].tool_calls[0].function.arguments) == {"a": "é", "b": 1} and args[0].tool_calls[0].function.arguments.startswith('{"a"')


def test_samples_hold_the_head_and_the_steps_so_far(spark):
    from stepwright.operators.samples import content_key

    steps = [{"assistant": {"role": "assistant", "content": f"a{k}"}, "tail": [{"role": "tool", "content": f"t{k}", "tool_call_id": "i"}, {"role": "system", "content": "no"}]} for k in range(3)]
    leaf, mid = json.dumps(steps), json.dumps(steps[:2])
    head = json.dumps([{"role": "system", "content": "s"}, {"role": "user", "content": "first"}, {"role": "user", "content": "issue"}])
    nodes = spark.createDataFrame([("t", content_key(p), "ready", p, None, 1, 1, 1.0) for p in (leaf, leaf, mid)] + [("t", "root", "ready", "[]", 0.5, 1, 1, 1.0), ("u", content_key(mid), "ready", mid, None, 1, 1, 1.0)],
                                  "instance_id string, node_key string, status string, prefix_json string, mc_score double, visits int, in_pool int, created_at double")
    roll = spark.createDataFrame([("t", content_key(leaf), k, 0) for k in range(3)] + [(i, content_key(mid), k, int(k < 2)) for i in ("t", "u") for k in range(4)] + [("t", "root", k, k % 2) for k in range(4)], "instance_id string, node_key string, rollout_idx int, correct int")
    splits = spark.createDataFrame([("t", "r", "train"), ("u", "r", "dev")], "instance_id string, repo string, prm_split string")
    trees = spark.createDataFrame([("t", "done", head), ("u", "done", json.dumps([{"role": "system", "content": "s"}]))], "instance_id string, status string, messages_head_json string")
    got = B.build_samples(nodes, roll, splits, trees)
    rows = {(r.label_source, r.step_index): r for r in got.collect()}
    assert set(rows) == {("leaf_chain", 1), ("leaf_chain", 2), ("leaf_chain", 3), ("node_mc", 2)}
    assert [(m.role, m.content) for m in rows["leaf_chain", 2].messages] == [("user", "issue"), ("assistant", "a0"), ("tool", "t0"), ("assistant", "a1"), ("tool", "t1")]
    assert rows["leaf_chain", 3].label == 0 and rows["leaf_chain", 1].label == 1 and rows["node_mc", 2].sample_id == f"t::{content_key(mid)}::2"
    best = B.built(got).collect()
    assert {(r.label_source, r.step_index) for r in best} == {("leaf_chain", 1), ("node_mc", 2), ("leaf_chain", 3)}
    assert got.select(S.approx_tokens(S.rendered_text("messages")).alias("n"), "rendered_tokens").filter("n <> rendered_tokens").count() == 0


def test_a_build_without_samples_or_over_changing_tables_is_an_error(spark):
    df = spark.range(3).withColumn("at", F.col("id"))
    print_ = lambda d: B.fingerprint(t=(d, "at")).collect()
    assert B.checked(df, print_(df), print_(df)).count() == 3
    with pytest.raises(ValueError, match="no samples"):
        B.checked(df.limit(0), [], [])
    with pytest.raises(RuntimeError, match="changed"):
        B.checked(df, print_(df), print_(df.filter("id < 2")))
