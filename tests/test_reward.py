import json

import pytest
from pyspark.sql import functions as F

from stepwright.operators import reward as R
from stepwright.operators.rules import gold_struct

LOC = "array<struct<file:string,class_name:string,function_name:string>>"


def layered(spark, preds, golds, **options):
    df = spark.createDataFrame([(preds, golds)], f"p {LOC}, g {LOC}")
    return R.layered(df, "p", "g", **options).first()


def test_depths(spark):
    g3, g1, g2, gfile = ("f", "C", "m"), ("f", None, "m"), ("f", "C", None), ("f", None, None)
    cases = [(("f", "C", "m"), g3, 3), (("f", "C", "x"), g3, 2), (("f", "C", None), g3, 2), (("f", "X", "m"), g3, 1), (("f", None, None), g3, 1), (("o", "C", "m"), g3, 0),
             (("f", None, "m"), g1, 3), (("f", "Z", "m"), g1, 3), (("f", None, None), g1, 1), (("f", "C", None), g2, 2), (("f", "C", "m"), g2, 2), (("f", None, None), gfile, 1)]
    df = spark.createDataFrame([(i, p, g) for i, (p, g, _) in enumerate(cases)], "i int, p struct<file:string,class_name:string,function_name:string>, g struct<file:string,class_name:string,function_name:string>")
    assert [r.d for r in df.select("i", R.match_depth(F.col("p"), F.col("g")).alias("d")).orderBy("i").collect()] == [d for *_, d in cases]


def test_soft_f1(spark):
    g = [("f", "C", "m")]
    for pred, want in ((("f", "C", "m"), 1.0), (("f", "C", None), 0.5), (("f", None, None), 0.2), (("f", "C", "x"), 0.5), (("o", "C", "m"), 0.0)):
        assert layered(spark, [pred], g).reward == pytest.approx(want)
    assert layered(spark, [("f", "C", "m"), ("o", None, None)], g).reward == pytest.approx(2 / 3)
    two = layered(spark, [("f", "C", "m"), ("h", None, None)], [("f", "C", "m"), ("h", "D", "n")])
    assert two.reward == pytest.approx(0.6) and two.correct
    three = [("a", "C", "m"), ("b", "C", "m"), ("c", "C", "m")]
    said = [("a", "C", "m"), ("b", "C", None), ("c", "C", None)]
    assert layered(spark, said, three).reward == pytest.approx(2 / 3) and not layered(spark, said, three).correct and layered(spark, said, three, strict=False).correct
    assert layered(spark, [("f", "C", None)], [("f", "C", None)]).reward == 1.0 and layered(spark, [("f", None, None)], [("f", "C", None)]).reward == pytest.approx(0.4)
    fined = layered(spark, [("f", "C", "m"), ("o", "X", "y")], g, overpromise=0.05)
    assert fined.penalty == pytest.approx(0.1) and fined.reward == pytest.approx(0.6)
    assert layered(spark, [], g).reward == 0 and layered(spark, g, []).reward == 0 and not layered(spark, [], []).correct


def test_the_greedy_order_is_kept(spark):
    got = layered(spark, [("f", "X", "g"), ("f", None, "g")], [("f", None, "g"), ("f", "X", "h")], normalised=False)
    assert got.credit == pytest.approx(1.2)


def test_submissions(spark):
    texts = ["", " ", "no", "{}", "[]", '[{"file": "a"}]', '[{"file": " "}]', '[{"file": 5}]', '[{"file": "a", "class_name": 5}]', '[{"file": " a ", "class_name": null, "function_name": "f"}]', '[1]', None,
             '[{"file": "a"}, {"file": "a"}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    rows = df.select("i", R.locations("s").alias("l"), R.submission_reason("s").alias("r")).orderBy("i").collect()
    assert [r.l is not None for r in rows] == [False, False, False, False, True, True, False, False, False, True, False, False, True]
    assert [r.r for r in rows] == ["blank", "blank", "not_a_list", "not_a_list", "empty", None, "bad_item", "bad_item", "bad_item", None, "bad_item", "blank", "duplicate"]
    assert rows[9].l[0].file == "a" and rows[9].l[0].function_name == "f"


def test_set_f1_gold_and_exits(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), ([], ["a"]), (["a"], [])], "s array<string>, t array<string>")
    assert [r[0] for r in df.select(R.set_f1(F.col("s"), F.col("t"))).collect()] == [0.5, 0.0, 0.0]
    gold = {"files": ["a.py", "b.py", "c.py"], "modules": ["a.py:C", "b.py:D"], "entities": ["a.py:C.m", "a.py:f"]}
    kind = "g struct<files:array<string>,modules:array<string>,entities:array<string>>, e string, s string"
    rows = [(gold, "Submitted", json.dumps([{"file": "a.py", "class_name": "C", "function_name": "m"}])), (gold, "Limits", "[]"), (gold, "Submitted", "x"), (gold, None, None), (gold, "Submitted", "[]"),
            ({"files": [], "modules": [], "entities": []}, "Submitted", '[{"file": "a"}]')]
    df = spark.createDataFrame(rows, kind)
    assert [tuple(t) for t in df.select(R.gold_triples(F.col("g")).alias("t")).first().t] == [("a.py", "C", "m"), ("a.py", None, "f"), ("b.py", "D", None), ("c.py", None, None)]
    assert [r.reason for r in R.exit_reward(df, "e", "s", F.col("g")).collect()] == [None, "not_submitted", "invalid_submission", "not_submitted", "empty_locations", "empty_gold"]


def test_names_of_a_patch(spark):
    patch = ("--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@ class A:\n     def m(self):\n+        pass\n@@ -9 +9 @@\n+def top(a):\n-- gone\n@@ -20 +20 @@ def outer(z):\n class B(C):\n+    async def n(self):\n"
             "--- a/old.py\n+++ /dev/null\n")  # fmt: skip
    df = spark.createDataFrame([("k", patch), ("none", None), ("text", "class A:\n def f(")], "k string, patch string")
    got = {r.k: r for r in R.diff_names(df, ["k"], "patch").collect()}
    assert got["k"].files == ["old.py", "x.py"]
    assert got["k"].modules == ["x.py:A", "x.py:B", "x.py:outer", "x.py:top"] and got["k"].entities == ["x.py:A.m", "x.py:B.n", "x.py:outer", "x.py:top"]
    assert all(got[k].files == [] and got[k].entities == [] for k in ("none", "text"))


def test_a_long_line_and_a_class_of_a_hunk(spark):
    patch = "\n".join(["--- a/x.py", "+++ b/x.py", "@@ -1 +1 @@ class A:", "+" + " " * 2_000_000 + "def deep(", "@@ -9 +9 @@", " def free(self):", "+class B(A):", "+    async def own(self):", "--- a/old.py", "+++ /dev/null", "-def gone():"])
    r = spark.createDataFrame([(1, patch), (2, None), (3, "")], "k int, patch string")
    got = {x.k: x for x in R.diff_names(r, ["k"], "patch").collect()}
    assert got[1].files == ["old.py", "x.py"] and got[1].modules == ["x.py:A", "x.py:B", "x.py:free"]
    assert got[1].entities == ["x.py:A.deep", "x.py:B.gone", "x.py:B.own", "x.py:free"]
    assert got[2].files == got[3].files == got[2].entities == []


def test_either_way_of_scoring(spark):
    gold = json.dumps({"files": ["a.py"], "modules": ["a.py:A"], "entities": ["a.py:A.f"]})
    right = json.dumps([{"file": "a.py", "class_name": "A", "function_name": "f"}])
    df = spark.createDataFrame([(1, "Submitted", right, gold), (2, "Submitted", "no", gold), (3, "Timeout", right, gold), (4, None, None, gold)], "k int, status string, said string, gold string")
    for mode in ("layered", "independent"):
        got = {r.k: (r.reward, r.reason, r.correct) for r in R.unified_reward(df, "status", "said", gold_struct("gold"), mode).collect()}
        assert got == {1: (1.0, None, True), 2: (0.0, "invalid_submission", False), 3: (0.0, "not_submitted", False), 4: (0.0, "not_submitted", False)}
    with pytest.raises(ValueError):
        R.unified_reward(df, "status", "said", gold_struct("gold"), "other")


def test_gold_that_is_no_list(spark):
    texts = ['{"files": "a.py", "modules": "[\\"m\\", \\"k\\"]", "entities": null}', '{"files": ["b", "a", "b"]}', None, "{", '{"files": 3}']
    got = [tuple(r.g) for r in spark.createDataFrame([(t,) for t in texts], "gold string").select(gold_struct("gold").alias("g")).collect()]
    assert got == [(["a.py"], ["k", "m"], []), (["a", "b"], [], []), ([], [], []), ([], [], []), (["3"], [], [])]
