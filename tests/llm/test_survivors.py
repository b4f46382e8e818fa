import datetime as dt
import random

import pytest

from stepwright.llm import survivors

MESSAGES = ("array<struct<role:string,content:string,reasoning_content:string,tool_calls:array<struct<id:string,type:string,"
            "function:struct<name:string,arguments:string>>>,tool_call_id:string>>")  # fmt: skip
SCHEMA = (f"row_id bigint, instance_id string, step_index int, messages {MESSAGES}, label_source string, n_rollouts smallint, built_at timestamp_ntz, "
          "node_key string, label float, mc_score float, prefix string, n string")  # fmt: skip
T = dt.datetime(2025, 1, 1)


def one(text, calls=None):
    return [("user", text, None, calls, None)]


def row(i, text="a b", source="leaf_chain", n=1, at=T, inst="i", step=1, key=None, label=None, calls=None):
    return (i, inst, step, one(text, calls), source, n, at, key, label, None, "clash", "clash")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_groups_and_the_row_to_keep(spark):
    rows = [row(5, n=9), row(3, "a   b\n", "Node_MC ", None, None), row(7, "ab", "node_mc", 1), row(8, "a c"), row(9, step=2), row(10, inst=None), row(11, inst=None, source=None),
            row(20, "t", n=None), row(21, "t", n=3, at=None), row(22, "t", n=3, at=T), row(23, "t", n=3, at=T), row(30, "e", calls=[]), row(31, "e", calls=None)]
    got = {(r.group_row_id, r.keep_row_id) for r in survivors.duplicate_groups(frame(spark, rows)).collect()}
    assert got == {(3, 7), (10, 10), (20, 22), (30, 30)}
    assert survivors.duplicate_groups(frame(spark, rows).limit(0)).count() == 0


def test_null_messages_and_repeated_rows(spark):
    rows = [(1, "i", 1, None, None, None, None, None, None, None, None, None), (2, "i", 1, [], None, None, None, None, None, None, None, None), row(4), row(4)]
    assert {(r.group_row_id, r.keep_row_id) for r in survivors.duplicate_groups(frame(spark, rows)).collect()} == {(1, 1), (4, 4)}


def test_fields_are_filled_and_voted_by_reliability(spark):
    rows = []
    for g in range(40):  # node_mc agrees with the majority, leaf_chain rows dissent one by one
        rows += [row(g * 10, f"g{g}", "node_mc", 8, key="n_good", label=1.0), row(g * 10 + 1, f"g{g}", "leaf_chain", 8, key=None, label=1.0), row(g * 10 + 2, f"g{g}", "leaf_chain", 8, key=f"n_bad{g}", label=0.0)]
    got = survivors.survivors(frame(spark, rows)).collect()
    assert len(got) == 40 and all((r.node_key, r.label, r.n_rows, r.keep_row_id % 10) == ("n_good", 1.0, 3, 0) for r in got)
    assert all((r.n_rollouts, r.label_source) == (8, "node_mc") for r in got)
    assert [f for f in got[0].__fields__ if f == "prefix"] == ["prefix"]


def test_a_group_with_many_copies(spark):
    rows = [row(i, "hot", "node_mc" if i == 77 else "leaf_chain", key=f"n{i % 3}") for i in range(2000)]
    got = survivors.survivors(frame(spark, rows)).collect()
    assert len(got) == 1 and got[0].keep_row_id == 77 and got[0].n_rows == 2000


def test_the_kept_row_follows_the_reliabilities(spark, monkeypatch):
    rows = [row(1, source="leaf_chain", n=9), row(2, source="node_mc", n=1), row(3, source=None, n=99)]
    assert [r.keep_row_id for r in survivors.survivors(frame(spark, rows)).collect()] == [2]
    for best, keep in (("leaf_chain", 1), ("", 3)):
        monkeypatch.setattr(survivors, "discover", lambda by_value, rounds, best=best: {s: float(s == best) for s in ("node_mc", "leaf_chain", "")})
        assert [r.keep_row_id for r in survivors.survivors(frame(spark, rows)).collect()] == [keep]


def test_a_source_is_never_below_one_that_is_trusted_less(spark):
    rows = []
    for g in range(60):  # node_mc is always outvoted
        rows += [row(g * 10, f"g{g}", "node_mc", 1, key=f"n_bad{g}")] + [row(g * 10 + i, f"g{g}", "leaf_chain", 9, key="n_good") for i in range(1, 4)]
    got = survivors.survivors(frame(spark, rows)).collect()
    assert len(got) == 60 and all((r.keep_row_id % 10, r.label_source, r.node_key) == (0, "node_mc", "n_good") for r in got)
    known = survivors.ranked({"node_mc": 0.1, "leaf_chain": 0.9, "": 0.4})
    assert known["node_mc"] > known["leaf_chain"] == 0.9 > known[""] == 0.4


def test_discovery_comes_to_rest_or_raises(spark):
    rnd = random.Random(4)
    rows = [row(i, f"g{i % 50}", rnd.choice(["node_mc", "leaf_chain", None]), rnd.randrange(9), key=f"n{rnd.randrange(3)}", label=float(rnd.randrange(2))) for i in range(600)]
    assert survivors.survivors(frame(spark, rows)).count() == 50
    with pytest.raises(RuntimeError, match="still move after 1 rounds"):
        survivors.survivors(frame(spark, rows), max_rounds=1)
