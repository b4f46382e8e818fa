import json
import random

from stepwright.llm import pieces

MESSAGES = ("array<struct<role:string,content:string,reasoning_content:string,tool_calls:array<struct<id:string,type:string,"
            "function:struct<name:string,arguments:string>>>,tool_call_id:string>>")  # fmt: skip


def frame(spark, rows):
    return spark.createDataFrame(rows, f"row_id bigint, messages {MESSAGES}, text string, piece_no string")


def msg(role, content, reasoning=None, args=None):
    return (role, content, reasoning, None if args is None else [("i", "function", ("f", a)) for a in args], None)


def total(messages):
    return sum(len(m[1] or "") + len(m[2] or "") + sum(len(c[2][1] or "") for c in m[3] or ()) for m in messages or ())


def joined(messages):
    return "".join("".join([m[1] or "", m[2] or "", *[c[2][1] or "" for c in m[3] or ()]]) for m in messages or ())


def test_pieces_are_whole_ordered_and_within_the_limit(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(30):
        words = lambda n: "".join(rnd.choice(["wort ", "a\n", "é𝔫 ", "x\n\n", "🧪"]) for _ in range(n))
        rows.append((i, [msg(rnd.choice(["user", "assistant", "tool"]), words(rnd.randrange(900)), rnd.choice([None, words(90)]), rnd.choice([None, [words(50), None]]))
                         for _ in range(rnd.randrange(1, 9))], "clash", "x"))
    rows += [(100, [msg("user", "y" * 7000)], None, None), (101, [msg("user", "y" * 7001)], None, None), (102, None, None, None), (103, [], None, None),
             (104, [msg("tool", None)], None, None), (105, [msg("user", "z" * 100_000)], None, None), (105, [msg("user", "z" * 100_000)], None, None)]
    got = {}
    for r in pieces.split_oversized(frame(spark, rows), "row_id").collect():
        got.setdefault(r.row_id, []).append(r)
    twice = got.pop(105)
    assert len(twice) % 2 == 0 and len({(r.piece_no, r.text) for r in twice}) * 2 == len(twice)
    for i, messages, _, _ in rows[:-2]:
        own = sorted(got[i], key=lambda r: r.piece_no)
        assert [r.piece_no for r in own] == list(range(1, own[0].n_pieces + 1)) and len(own) == own[0].n_pieces
        assert "".join(r.text[r.repeated :] for r in own) == joined(messages)
        assert all(len(r.text) <= 7000 and r.stop - r.start == len(r.text) for r in own)
        assert (len(own) > 1) == (total(messages) > 7000)
        for a, b in zip(own, own[1:], strict=False):
            assert a.text.endswith(b.text[: b.repeated]) and 0 < b.repeated <= 350
    assert {r.row_id for r in pieces.oversized(frame(spark, rows), "row_id").collect()} == {i for i, m, _, _ in rows if total(m) > 7000}
    assert pieces.oversized(frame(spark, []), "row_id").count() == 0


def test_cuts_prefer_steps_and_repeat_the_last_whole_message():
    fields = [(0, "user", "a" * 60, True), (1, "tool", "b" * 10, True), (2, "assistant", "c" * 50, True)]
    got = pieces.split(fields, limit=100, overlap=20)
    assert [(g[2], g[3]) for g in got] == [(0, "start"), (10, "step")] and got[1][4] == "b" * 10 + "c" * 50
    text = "one line\n" * 30
    got = pieces.split([(0, "user", text, True)], limit=100, overlap=20)
    assert all(g[3] == "line" and g[2] == 20 for g in got[1:]) and all(len(g[4]) <= 100 for g in got)
    assert json.dumps(got)
