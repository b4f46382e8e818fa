import json

from stepwright.operators import nested


def call(i, name="bash"):
    return {"id": i, "type": "function", "function": {"name": name, "arguments": "{}"}}


def tool(i):
    return {"role": "tool", "tool_call_id": i, "content": "x"}


def run(spark, docs, **options):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(f"k{i}", d) for i, d in enumerate(docs)], "k string, doc string")
    return nested.interval_nodes(df, "nodes", F.col("k"), F.col("doc"), **options)


STEP = {"assistant": {"tool_calls": [call("a"), call("b")]}, "tail": [tool("a"), {"role": "user", "tool_call_id": "b", "content": "no"}]}


def found(spark, docs):
    df = run(spark, docs, kinds=("call",))
    return sorted((r.record_key, r.step_index, r.node_id) for r in df.filter("not answered").collect())


def test_unanswered_in_the_ways_it_is_written(spark):
    single = {"assistant": {"tool_calls": call("c")}, "tail": None}
    actions = {"assistant": {"tool_calls": [], "extra": {"actions": [{"command": "ls", "tool_call_id": "d"}]}}, "tail": [tool("d"), tool("e")]}
    late = [{"assistant": {"tool_calls": [call("f")]}, "tail": []}, {"assistant": {}, "tail": [tool("f")]}]
    docs = [
        json.dumps([STEP]), json.dumps(json.dumps([STEP])), json.dumps({"steps": json.dumps([single, actions])}),
        json.dumps({"result": {"steps": late}}), json.dumps([STEP])[:-9], None, "", "[]", "null", "{}", '{"steps": null}', "plain",
        json.dumps({"steps": [None, 3, {"assistant": None, "tail": "x"}]}),
    ]
    assert found(spark, docs) == [("k0", 1, "b"), ("k1", 1, "b"), ("k2", 1, "c"), ("k3", 1, "f")]


def test_ids_that_are_null_repeated_or_numbers(spark):
    steps = [{"assistant": {"tool_calls": [call(None), call(7), call("x"), call("x")]}, "tail": [tool(None), tool(7)]}]
    df = run(spark, [json.dumps(steps)], kinds=("call",)).filter("not answered")
    assert sorted(str(r.node_id) for r in df.collect()) == ["None", "x", "x"]


def test_intervals_enclose_exactly_the_children(spark):
    doc = {"steps": [STEP, STEP], "reward_details": {"matches": [{"pred": {"file": "a"}, "gold": {"file": "a"}, "depth": 1}]}}
    nodes = [r.asDict() for r in run(spark, [json.dumps(doc)]).collect()]
    assert [n["kind"] for n in nodes] == ["step", "call", "call", "answer", "answer"] * 2 + ["match"]
    assert sorted(x for n in nodes for x in (n["pre"], n["post"])) == list(range(1, 2 * len(nodes) + 1))
    for child in nodes:
        around = [n for n in nodes if n["pre"] < child["pre"] and child["post"] < n["post"]]
        assert child["parent_pre"] == max((n["pre"] for n in around), default=0)
    assert [n["ord"] for n in nodes if n["kind"] == "call"] == [1, 2, 1, 2]
    assert [n["step_index"] for n in nodes if n["kind"] == "answer"] == [1, 1, 2, 2]
    assert nodes[-1]["score"] == 1.0 and json.loads(nodes[-1]["body"])["gold"] == {"file": "a"}


def test_messages_become_steps_and_empty_tables_stay_empty(spark):
    kind = ("array<struct<role:string,content:string,reasoning_content:string,tool_calls:array<struct<id:string,type:string,"
            "function:struct<name:string,arguments:string>>>,tool_call_id:string>>")  # fmt: skip
    one = lambda role, calls=None, answer=None: (role, "t", None, calls, answer)
    talk = [one("tool", None, "a"), one("assistant", [("a", "function", ("bash", "{}"))]), one("user"), one("assistant"), one("tool", None, "a")]
    build = spark.createDataFrame([(1, talk, "x"), (2, None, "x"), (3, [], "x")], f"row_id bigint, messages {kind}, record_key string")
    empty = spark.createDataFrame([], "instance_id string, node_key string, prefix_json string")
    rollouts = spark.createDataFrame([], "instance_id string, node_key string, rollout_idx int, result_json string")
    assert [tuple(r) for r in nested.unanswered_calls(build, empty, rollouts).collect()] == [("build_dataset", "1", 1, "a")]
    labelled = nested.holders(build, empty, rollouts)
    assert {k: nested.table_of(labelled, k).count() for k in nested.KINDS} == {"step": 2, "call": 1, "answer": 2, "match": 0}
    assert nested.unanswered_calls(build.limit(0), empty, rollouts).count() == 0


def test_a_key_with_a_null_part_and_many_equal_rows(spark):
    doc = json.dumps([STEP])
    nodes = spark.createDataFrame([("i", None, doc)] * 50, "instance_id string, node_key string, prefix_json string")
    build = spark.createDataFrame([], "row_id bigint, messages array<struct<role:string,content:string,tool_call_id:string,"
                                  "tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>")  # fmt: skip
    rollouts = spark.createDataFrame([], "instance_id string, node_key string, rollout_idx int, result_json string")
    assert [tuple(r) for r in nested.unanswered_calls(build, nodes, rollouts).collect()] == [("nodes", "i", 1, "b")]


def test_values_encoded_any_number_of_times(spark):
    text = [json.dumps([STEP])]
    for _ in range(7):
        text.append(json.dumps(text[-1]))
    assert found(spark, text) == [(f"k{i}", 1, "b") for i in range(len(text))]
    assert found(spark, [json.dumps("plain"), json.dumps(json.dumps([STEP]))[:-1]]) == []
