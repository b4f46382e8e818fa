import json
import re

import pytest
from pyspark.sql import functions as F

from stepwright.functions import shell as H
from stepwright.operators import truncate as T

INSIDE = ["/tmp", "/tmp/a", "/tmp/a/../b.txt", "/srv/../tmp/x", "/tmp/./x/y", "$TMPDIR/z", "${TMPDIR}", "${TMPDIR}/q/r", "/dev/null"]
OUTSIDE = ["a", "./tmp/x", "/", "/srv/x", "/tmp/..", "/tmp/a/../../srv", "/tmpx/a", "$TMPDIRX/a", "$HOME/tmp", "/dev/nil", "/dev/sda", "tmp/x"]
FRONT = ["", "Z=1 ", "sudo ", "Z=1 nohup time Q= ", "(", "  ( "]
READ = ["ls", "wc -l *.md", "grep -n x y | sort -u", "cd d; cat e", "diff p q && pwd", "/usr/bin/head -3 f"]


def reasons(spark, commands, **options):
    df = spark.createDataFrame(list(enumerate(commands)), "i int, c string").repartition(3)
    return [r.r for r in df.select("i", H.refusal("c", **options).alias("r")).orderBy("i").collect()]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in INSIDE + OUTSIDE + [""]], "p string")
    assert [r.p for r in df.filter(H.is_scratch(F.col("p"))).collect()] == INSIDE


def test_writers_by_target_and_what_stands_in_front(spark):
    writers = [w for w in H.WRITERS if w != "install"]  # that one is forbidden as a word
    lines = [(f"{front}{folder}{w} -f {path}", path) for front in FRONT for folder in ("", "/bin/") for w in writers for path in INSIDE + OUTSIDE]
    assert reasons(spark, [c for c, _ in lines]) == [None if p in INSIDE else "write" for _, p in lines]
    assert set(reasons(spark, [c for c, _ in lines], scratch_writes=False)) == {"write"}
    later = [f"{r}{mark}touch {p}" for r in READ for mark in (";", " | ", "&&", "\n") for p in ("/tmp/k", "k")]
    assert reasons(spark, later) == [None, "write"] * (len(later) // 2)
    assert reasons(spark, ["tee", "rm -r", "mkdir -p V=/srv", "echo rm x"]) == [None] * 4


def test_redirections(spark):
    lines = [(f"{r} {mark}{blank}{quote}{p}{quote}", p) for r in READ for mark in (">", ">>") for blank in ("", " ") for quote in ("", "'", '"') for p in INSIDE + OUTSIDE]
    assert reasons(spark, [c for c, _ in lines]) == [None if p in INSIDE else "redirect" for _, p in lines]
    assert set(reasons(spark, [c for c, _ in lines], scratch_writes=False)) == {"redirect"}
    assert reasons(spark, ["ls 2>&1", "ls 2>/srv/e", "ls &>/srv/e", "ls 2>>/srv/e"]) == [None, None, None, "redirect"]


def test_forbidden_words_and_the_strict_list(spark):
    bare = [m for m in (re.fullmatch(r"\\b(\w+)\\b", p) for p in H.FORBIDDEN) if m]
    lines = [t.format(m[1]) for m in bare for t in ("{} x", "ls; {} x", "cat y | sudo {}", "echo {}")] + [x.upper() for x in ("kill 1", "make all")]
    assert len(bare) > 15 and set(reasons(spark, lines)) == {"forbidden"}
    assert reasons(spark, [None, "", " \n\t"]) == ["empty"] * 3
    assert set(reasons(spark, [f + r for f in FRONT for r in READ], strict=True)) == {None}
    assert reasons(spark, ["curl u", "ls; curl u", "A=1", "time A=1 ls | wc -l"], strict=True) == ["unlisted", "unlisted", None, None]
    assert reasons(spark, ["A=1 " * 20_000 + "rm a", "ls " * 50_000]) == ["write", None]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a/b c",), ("..",), ("",), (None,), ("x" * 99,)], "t string")
    assert [r[0] for r in df.select(H.safe_name("t")).collect()] == ["a__b_c", "repo", "repo", "repo", "x" * 60]
    flags = spark.createDataFrame([("1",), (" TRUE ",), ("off",), ("",), (None,)], "t string")
    assert [r[0] for r in flags.select(H.as_bool("t", True)).collect()] == [True, True, False, True, True]
    assert [r[0] for r in flags.select(H.as_int("t", 7)).collect()] == [1, 7, 7, 7, 7]
    pairs = spark.createDataFrame([("yes, no",), ("a/b",), ("a",), ("a,",), ("a,b,c",)], "t string")
    assert [r[0] for r in pairs.select(H.verdict_pair("t")).collect()] == [["yes", "no"], ["a", "b"], None, None, None]
    assert spark.createDataFrame([("it's",)], "t string").select(H.quote("t")).first()[0] == "'it'\"'\"'s'"
    assert H.warmup_steps(1000, 1, 16, 2, 0.03) == 4 and H.warmup_steps(1, 1, 16, 1, 0.03) == 1


def test_clipping(spark):
    content = [json.dumps({"returncode": 1, "output": 'é"x' * 30}), "plain " * 30, None, "[1]", json.dumps({"output": "a"})]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(content)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(T.tool_clip("c", 10)).collect()]
    assert json.loads(got[0]) == {"returncode": 1, "output": ('é"x' * 30)[:10] + T.MARK}
    assert got[1:4] == [("plain " * 30)[:10] + T.MARK, T.MARK, "[1]" + T.MARK] and json.loads(got[4])["returncode"] is None
    ends = spark.createDataFrame([("abcdefghij",), ("abc",)], "t string").select(T.head_tail("t", 4)).collect()
    assert ends[0][0].startswith("ab\n") and ends[0][0].endswith("\nij") and "6" in ends[0][0] and ends[1][0] == "abc"


@pytest.mark.parametrize("seed", range(3))
def test_dropping_steps_against_trying_all(spark, seed):
    import random

    rnd = random.Random(seed)
    rows, want = [], {}
    for k in range(60):
        n, head = rnd.randrange(1, 7), rnd.choice([5, 30, 95])
        tokens = [rnd.randrange(1, 60) for _ in range(n)]
        clipped = [rnd.randrange(1, t + 1) for t in tokens]
        rows += [(k, i + 1, t, c, head) for i, (t, c) in enumerate(zip(tokens, clipped, strict=True))]
        size = lambda d, parts: head + sum(parts[d:]) + (8 if d else 0)  # noqa: B023, E731
        if size(0, tokens) <= 100:
            want[k] = (0, "fits")
        else:
            fit = [d for d in range(n) if size(d, tokens) <= 100]
            drop = fit[0] if fit else n - 1
            outcome = "unfittable" if head + 8 > 100 else "steps_dropped" if fit else "tools_clipped" if size(n - 1, clipped) <= 100 else "unfittable"
            want[k] = (drop, outcome)
    df = spark.createDataFrame(rows, "k int, step int, tokens int, clipped_tokens int, head_tokens int").repartition(3)
    assert {r.k: (r.n_drop, r.outcome) for r in T.plan(df, "k", 100, 8).collect()} == want
    assert T.plan(df.limit(0), "k", 100, 8).count() == 0


def test_candidates(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 99), (4, 101)], "i int, t int")
    assert [r.i for r in T.oversize_candidates(df, "t", 100).orderBy("i").collect()] == [1, 2, 4]
    assert df.select(F.count("*")).first()[0] == 4
