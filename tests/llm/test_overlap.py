import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepwright.llm import overlap
from stepwright.llm.words import common_in_order, words

MESSAGES = "array<struct<role:string,content:string>>"


def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=24), st.lists(st.integers(0, 4), max_size=24))
def test_common_words_in_order_against_the_table(a, b):
    longest = lcs_length(a, b)
    assert [common_in_order(a, b, n) for n in range(26)] == [n <= longest for n in range(26)]


def test_words_apart_from_markup():
    assert words("**The** `src/a_b.py`, <b>line</b>\r\n> two &amp; — ﬁve") == ["the", "srcabpy", "line", "two", "five"]
    assert words(None) == words(" \n") == words("--- ...") == []


def case(spark, texts):
    """texts: (instance, splits, statement, tagged)."""
    inst = spark.createDataFrame([(i, s, "src") for i, _, s, _ in texts], "instance_id string, problem_statement string, source string")
    rows = [(n * 10 + k, i, sp, [("system", "x"), ("user", f"Go.\n<report>{t}</report>" if t is not None else "none")], "clash")
            for n, (i, splits, _, t) in enumerate(texts) for k, sp in enumerate(splits)]
    build = spark.createDataFrame(rows, f"row_id bigint, instance_id string, split string, messages {MESSAGES}, report string")
    return inst, build


def test_all_links_against_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = ["the", "of", "is"] * 6 + [f"w{i}" for i in range(40)]
    texts = []
    for f in range(40):
        base = rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 5, 10, 40, 60, 130, 160, 200]))
        for c in range(rnd.randrange(1, 5)):
            own = list(base)
            for _ in range(rnd.randrange(0, max(1, len(base) // 3))):
                at = rnd.randrange(len(own) + 1)
                own[at : at + rnd.randrange(2)] = rnd.choices(vocabulary, k=rnd.randrange(2))
            text = rnd.choice([" ", "\n", " **"]).join(own)
            texts.append((f"i{f}.{c}", rnd.choice([["train"], ["dev"], [" TEST"], ["train", "dev"], [None]]), rnd.choice([text, text, None]), text))
    inst, build = case(spark, texts)
    want = set()
    for a, sa, ta, ra in texts:
        for b, sb, tb, rb in texts:
            held = {"dev", "test"} & {(s or "").strip().lower() for s in sb}
            wa, wb = words(ta if ta and ta.strip() else ra), words(tb if tb and tb.strip() else rb)
            if a != b and "train" in sa and held and wa and wb and 5 * lcs_length(wa, wb) >= 4 * max(len(wa), len(wb)):
                want.add((min(a, b), max(a, b)))
    got = [tuple(r) for r in overlap.overlap_pairs(inst, build).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    inst = inst.withColumn("source", F.expr("array('a', 'b', null)[abs(hash(instance_id)) % 3]"))
    more = inst.filter("abs(hash(instance_id)) % 5 = 0").withColumn("source", F.lit("c"))
    inst = inst.unionByName(more)
    sources = {}
    for r in inst.collect():
        sources.setdefault(r.instance_id, set()).update({r.source} - {None})
    counts = {}
    for a, sa, ta, ra in texts:
        for b, sb, tb, rb in texts:
            if a == b or (min(a, b), max(a, b)) not in want or "train" not in sa:
                continue
            for split in {"dev", "test"} & {(s or "").strip().lower() for s in sb}:
                for group in {(split, x, y) for x in sources[b] or {None} for y in sources[a] or {None}} | {split}:
                    n = counts.setdefault(group, [0, 0, set()])
                    n[0] += 1
                    n[1] += words(ta if ta and ta.strip() else ra) == words(tb if tb and tb.strip() else rb)
                    n[2].add(b)
    report = overlap.overlap_report(inst, build).collect()
    assert {(r.eval_split, r.eval_source, r.train_source): (r.n_pairs, r.n_exact, r.n_eval_instances) for r in report} == {g: (n, e, len(i)) for g, (n, e, i) in counts.items() if isinstance(g, tuple)}
    assert {r.eval_split: (r.split_pairs, r.split_exact, r.split_eval_instances) for r in report} == {g: (n, e, len(i)) for g, (n, e, i) in counts.items() if isinstance(g, str)}


@pytest.mark.parametrize("short", [0, 12, 40, 1000])
def test_texts_that_agree_share_a_signature(monkeypatch, short):
    monkeypatch.setattr(overlap, "SHORT", short)
    rnd, linked = random.Random(short), 0
    hashes = np.random.default_rng(short).integers(0, 2**63, 60).astype(np.uint64)
    counts = np.zeros(1 << overlap.SKETCH_BITS, np.int64)
    counts[overlap._cells(hashes[:50])] = np.random.default_rng(1).integers(49, 60, 50)
    for _ in range(1500):
        a = [rnd.randrange(60) for _ in range(rnd.randrange(1, 80))]
        b = list(a)
        for _ in range(rnd.randrange(0, 2 + len(a) // 4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = [rnd.randrange(60)] * rnd.randrange(2)
        if b and a != b and 5 * lcs_length(a, b) >= 4 * max(len(a), len(b)):
            linked += 1
            x, y = (set(overlap.signatures_of(hashes[w], counts).tolist()) for w in (a, b))
            assert x & y, (a, b)
    assert linked > 300


def test_a_long_text_of_common_words_has_few_signatures():
    found = np.random.default_rng(3).integers(0, 300, 20_000).astype(np.uint64)
    counts = np.full(1 << overlap.SKETCH_BITS, 1000, np.int64)
    tracemalloc.start()
    assert len(overlap.signatures_of(found, counts)) <= 20_000 and max(len(overlap.signatures_of(found[:n], counts)) for n in range(1, 400)) < 1_000
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()


def test_a_long_text_and_its_copy_are_found(spark):
    rnd = random.Random(5)
    long = [f"w{rnd.randrange(300)}" for _ in range(20_000)]
    near = [w if i % 6 else "other" for i, w in enumerate(long)]
    inst, build = case(spark, [("a", ["train"], " ".join(long), None), ("b", ["test"], " ".join(near), None), ("c", ["dev"], " ".join(long[:15_000]), None)])
    assert {tuple(r) for r in overlap.overlap_pairs(inst, build).collect()} == {("a", "b")}


def test_cut_blank_and_missing_statements_fall_back(spark):
    long = " ".join(f"word{i}" for i in range(30))
    texts = [("a", ["train"], long, "x"), ("b", ["test"], long[:50] + " [...]", long), ("c", ["dev"], " \n", long), ("d", ["dev"], None, None), ("e", ["dev"], "…", long.upper()), ("f", ["train"], "", None)]
    inst, build = case(spark, texts)
    assert {tuple(r) for r in overlap.overlap_pairs(inst, build).collect()} == {("a", "b"), ("a", "c"), ("a", "e")}
    assert overlap.overlap_pairs(inst.limit(0), build).count() == 0
    assert overlap.overlap_pairs(inst, build.limit(0)).count() == 0


def test_report_counts_every_source_and_totals_once(spark):
    text = " ".join(f"word{i}" for i in range(30))
    inst, build = case(spark, [("a", ["train"], text, "x"), ("b", ["test"], text, "x")])
    again = spark.createDataFrame([("b", text, "alpha"), ("b", text, "alpha"), ("a", text, None)], inst.schema)
    got = overlap.overlap_report(inst.unionByName(again), build).collect()
    assert sorted((r.eval_split, r.eval_source, r.train_source, r.n_pairs, r.n_exact, r.n_eval_instances) for r in got) == [("test", s, "src", 1, 1, 1) for s in ("alpha", "src")]
    assert {(r.split_pairs, r.split_exact, r.split_eval_instances) for r in got} == {(1, 1, 1)}
