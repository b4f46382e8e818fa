import pytest

from stepwright.operators import repo_splits as S
from stepwright.operators import rules as R

GOLD = '{"files": ["a.py"], "modules": [], "entities": []}'
SCHEMA = "seq int, instance_id string, repo string, problem_statement string, patch string, gold string, extra string"


def test_first_failing_rule(spark):
    rows = [
        (0, "ok", "o/r", "x" * 60, "diff", GOLD), (1, "blank", "o/r", " \n\t ", "diff", GOLD), (2, "short", "o/r", "x" * 5, "d", GOLD), (3, "long", "o/r", "x" * 200, "d", GOLD),
        (4, "new", "o/r", "x" * 75, "a\nnew file mode 100644", GOLD), (5, "gone", "o/r", "x" * 75, "+++ /dev/null\n", GOLD), (6, "nogold", "o/r", "x" * 75, "d", "{}"), (7, "ok", "o/r", "x" * 75, "d", GOLD),
        (8, "bad id!", "o/r", "x" * 75, "d", GOLD), (9, "noslash", "r", "x" * 75, "d", GOLD), (10, "null", "o/r", None, None, None), (11, "early", "o/r", "", "d", GOLD), (12, "early", "o/r", "x" * 75, "d", GOLD),
        (13, "badrepo", "r", "x" * 75, "d", GOLD), (14, "badrepo", "o/r", "x" * 75, "d", GOLD),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA)
    got = {r.seq: r.drop_reason for r in R.with_drop_reason(df, ["seq"], 50, 100).collect()}
    want = {0: None, 1: "empty_statement", 2: "statement_too_short", 3: "statement_too_long", 4: "created_or_deleted_files", 5: "created_or_deleted_files", 6: "no_valid_gold", 7: "duplicate_instance_id",
            8: "invalid_format", 9: "invalid_format", 10: "empty_statement", 11: "empty_statement", 12: None, 13: "invalid_format", 14: "duplicate_instance_id"}
    assert got == want
    report = R.filter_report(R.with_drop_reason(df, ["seq"], 50, 100)).first()
    assert (report.original_total, report.kept_total, report.dropped_total) == (15, 2, 13)
    assert R.filter_report(R.with_drop_reason(df.limit(0), ["seq"])).first().original_total == 0
    with pytest.raises(ValueError, match="patch"):
        R.require_columns(df.drop("patch"))


def test_gold_of_nested_changes(spark):
    kind = "file_changes array<struct<file:string,changes:struct<edited_modules:array<string>,added_modules:array<string>,edited_entities:array<string>,added_entities:array<string>>>>"
    changes = [("a.py", (["a.py:C"], ["a.py:D"], ["a.py:C.f", "a.py:C.f"], None)), ("README.md", (["README.md:x"], None, None, None)), (None, None), ("b.pyi", None)]
    df = spark.createDataFrame([(changes,), (None,), ([],)], kind)
    rows = [r[0] for r in df.select(R.extract_gold("file_changes").alias("g")).collect()]
    assert (rows[0].files, rows[0].modules, rows[0].entities) == (["a.py", "b.pyi"], ["a.py:C", "a.py:D"], ["a.py:C.f"])
    assert all((r.files, r.modules, r.entities) == ([], [], []) for r in rows[1:])
    wide = df.select(R.extract_gold("file_changes", python_only=False, added_modules=False).alias("g")).first()[0]
    assert (wide.files, wide.modules) == (["README.md", "a.py", "b.pyi"], ["README.md:x", "a.py:C"])


def test_repositories_and_ranks(spark):
    rows = [("mirror/own__x.2b8635b7",), ("plain/name",), (" a/b.git ",), ("nothing",), ("a/b/c.DEADBEEF",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "repo string").select(*R.parse_repo("repo")).collect()]
    assert got == [("mirror", "own__x", "2b8635b7"), ("plain", "name", None), ("a", "b", None), ("", "nothing", None), ("a", "b/c", "DEADBEEF")]
    values = spark.createDataFrame([(v,) for v in [5, 1, 9, 7]], "v bigint")
    assert tuple(R.nearest_rank(values, "v", {"p50": 0.5, "p95": 0.95}).first())[:4] == (1, 7, 9, 9)


@pytest.mark.parametrize("n,pool,sizes", [(20, 12, None), (50, 30, (24, 3, 3)), (10, 6, None), (1, 1, (1, 0, 0)), (0, 0, (0, 0, 0))])
def test_split_sizes(spark, n, pool, sizes):
    rows = [(f"i{k}.{c}", f"o/r{k}") for k in range(n) for c in range(2)]
    got = S.make_splits(spark.createDataFrame(rows, "instance_id string, repo string")).collect()
    by = {r.repo: (r.gen_pool, r.prm_split) for r in got}
    assert len(got) == len(rows) and sum(p for p, _ in by.values()) == pool
    count = tuple(sum(s == name for _, s in by.values()) for name in ("train", "dev", "test"))
    assert count == sizes if sizes else (count[1] >= 1 and count[2] >= 1 and sum(count) == pool)


def test_leaks_samples_and_selection(spark):
    inst = spark.createDataFrame([(f"i{k}", f"o/r{k % 5}") for k in range(40)], "instance_id string, repo string")
    splits = S.make_splits(inst)
    assert S.assert_no_leak(splits, "repo", "prm_split") is splits
    with pytest.raises(ValueError, match="several splits"):
        S.assert_no_leak(spark.createDataFrame([("a", "x"), ("a", "y")], "repo string, prm_split string"), "repo", "prm_split")
    one, two = ([r[0] for r in S.hash_sample(inst.repartition(p), "instance_id", 7).collect()] for p in (1, 5))
    assert one == two and len(set(one)) == 7
    assert [r.instance_id for r in S.select_instances(inst, splits, ids=["i9", "i2"]).collect()] == ["i9", "i2"]
    with pytest.raises(ValueError, match="nope"):
        S.select_instances(inst, splits, ids=["nope"])
    pool = {r.instance_id for r in splits.filter("gen_pool").collect()}
    assert {r.instance_id for r in S.select_instances(inst, splits).collect()} == pool
    assert S.select_instances(inst, splits, count=3, sample=True).count() == 3
