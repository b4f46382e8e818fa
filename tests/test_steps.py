import pytest
from pyspark.sql import functions as F

from stepwright.operators import samples as D
from stepwright.operators import steps as S

KIND = "array<struct<role:string,content:string,reasoning_content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>,tool_call_id:string>>"


def m(role, content="x", calls=None, answer=None):
    return (role, content, None, calls, answer)


TALK = [m("system"), m("user", "go"), m("assistant", "a1"), m("tool", "t1"), m("assistant", "a2"), m("tool", "t2"), m("exit", "done")]


def frame(spark, *talks):
    return spark.createDataFrame([(i, t) for i, t in enumerate(talks)], f"k int, messages {KIND}")


def test_steps_prefixes_and_exit(spark):
    bad = TALK[:4] + [m("user", "format error")] + TALK[4:]
    df = frame(spark, TALK, bad, [m("user")], [], None, TALK[:3] + [m("exit", "one")] + TALK[4:], [m("assistant")])
    steps = {r.k: r.s for r in df.select("k", S.split_steps("messages").alias("s")).collect()}
    assert [[x.assistant.content, *[t.content for t in x.tail]] for x in steps[0]] == [["a1", "t1"], ["a2", "t2"]]
    assert len(steps[1][0].tail) == 2 and steps[2] == [] and steps[3] == [] and not steps[4]
    assert len(steps[5]) == 1 and len(steps[6]) == 1
    sizes = df.select("k", *[F.size(S.prefix_messages("messages", k)).alias(f"k{k}") for k in (0, 1, 99)], S.extract_exit("messages").alias("e")).collect()
    assert tuple(sizes[0]) == (0, 2, 4, 6, "done") and tuple(sizes[2])[1:] == (0, 0, 0, "")
    rows = sorted((r.k, r.pos, r.step_index) for r in S.step_rows(df.filter("k = 1"), "k").collect())
    assert [r[2] for r in rows] == [1, 1, 1, 2, 2]
    flat = df.filter("k = 0").select(S.flattened(S.split_steps("messages")).alias("f")).first().f
    assert [x.content for x in flat] == ["a1", "t1", "a2", "t2"]


def test_keys_depend_on_content_only(spark):
    df = frame(spark, TALK, [m("user", "other head"), *TALK[2:]], TALK[:4])
    keys = [r.p for r in df.select(S.prefix_keys(S.split_steps("messages")).alias("p")).collect()]
    assert keys[0] == keys[1] and keys[2] == keys[0][:2] and keys[0][0] == "root"
    assert all(len(k) == 18 and k.startswith("n_") for k in keys[0][1:]) and len(set(keys[0])) == 3


def test_canonical_messages_and_tokens(spark):
    talk = [m("system"), m("assistant", None, [("a", (None, "{}"))]), m("assistant", "t", [("b", ("f", "{}")), ("c", ("", "x"))]), m("exit")]
    got = frame(spark, talk).select(S.canonical("messages").alias("c")).first().c
    assert [(x.role, x.content, x.tool_calls and len(x.tool_calls)) for x in got] == [("assistant", "", None), ("assistant", "t", 1)]
    text = spark.createDataFrame([("",), ("x" * 7,), ("x" * 9,)], "t string").select(S.approx_tokens(F.col("t")).alias("n"))
    assert [r.n for r in text.collect()] == [1, 2, 3]


def test_head_without_user_is_an_error(spark):
    with pytest.raises(Exception, match="user message"):
        frame(spark, [m("system")]).select(S.head_user("messages")).collect()


def test_labels_chains_weights(spark):
    df = spark.createDataFrame([(0.8,), (0.4,), (1.0,)], "mc double")
    assert [round(r[0], 6) for r in df.select(D.mixed(F.col("mc"))).collect()] == [0.96, 0.08, 1.0]
    chain = S.leaf_chain(spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "k string, n int"), "k", "n").orderBy("k", "step_index").collect()
    assert [(r.k, r.label) for r in chain] == [("a", 1.0), ("a", 1.0), ("a", 0.0), ("b", 0.0)]
    for pos, neg, want in ((9, 1, 4.0), (3, 3, 1.0), (0, 2, 0.0), (0, 0, 1.0)):
        labels = spark.createDataFrame([(1,)] * pos + [(0,)] * neg, "y int")
        assert tuple(D.class_weights(labels, "y").first()) == (1.0, want)


def test_priority_dedupe_of_a_node_and_a_leaf(spark):
    node = [("i", "p6", 6, "n_a", "node_mc")]
    leaf = [("i", f"p{k}", k, "n_b", "leaf_chain") for k in range(1, 10)]
    df = spark.createDataFrame(node + leaf, "instance_id string, prefix string, step_index int, node_key string, label_source string")
    kept = D.dedupe(df, ["instance_id", "prefix", "step_index"], ["node_key"])
    assert (df.count(), kept.count()) == (10, 9) and kept.filter("prefix = 'p6'").first().label_source == "node_mc"
    stats = {r.label_source: (r.before, r.after, r.collisions) for r in D.dedupe_stats(df, kept).collect()}
    assert stats == {"node_mc": (1, 1, 0), "leaf_chain": (9, 8, 1)}
