import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from stepwright import sinks
from stepwright.sources import pages, sqlite, tables


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "state.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE rollouts (instance_id TEXT, rollout_idx INT, reward REAL, correct INTEGER)")
        c.executemany("INSERT INTO rollouts VALUES (?, ?, ?, ?)", [(f"i{k % 7}", k, k / 2 if k % 3 else None, 1) for k in range(1000)])
        c.execute("CREATE TABLE empty (a TEXT)")
    df = sqlite.read_sqlite(spark, path, "rollouts", partitions=4)
    assert dict(df.dtypes) == {"instance_id": "string", "rollout_idx": "bigint", "reward": "double", "correct": "bigint"}
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.count("*"), F.sum("rollout_idx"), F.count("reward")).first() == (1000, 499500, 666)
    assert sqlite.read_sqlite(spark, path, "rollouts", "rollout_idx long").columns == ["rollout_idx"]
    assert sqlite.read_sqlite(spark, path, "empty").count() == 0
    with pytest.raises(sqlite3.OperationalError):
        sqlite.open_read_only(path).execute("DELETE FROM rollouts")


def test_paged_source(spark):
    def fetch(key, cursor, size):
        start = int(cursor or 0)
        page = [{"id": f"{key}{i}"} for i in range(start, min(start + size, 25))]
        return page, str(start + size) if start + size < 25 else None

    df = pages.read_pages(spark, ["a", "b"], fetch, 10)
    assert sorted(json.loads(r.document)["id"] for r in df.collect()) == sorted(f"{k}{i}" for k in "ab" for i in range(25))
    assert pages.read_pages(spark, [], fetch).count() == 0


def test_issue_files_and_configuration(spark, tmp_path, monkeypatch):
    row = spark.createDataFrame([("i", "o/r", "text", "diff", [("a.py", None)])], tables.ISSUES)
    row.write.parquet(str(tmp_path / "train.parquet"))
    row.withColumn("use_patch", F.lit(False)).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "late.parquet"))
    got = {r.source: (r.use_patch, r.base_commit) for r in tables.read_issues(spark, *[str(tmp_path / f"{n}.parquet") for n in ("train", "late")]).collect()}
    assert got == {"train": (True, None), "late": (False, None)}
    row.drop("patch").write.parquet(str(tmp_path / "bad.parquet"))
    with pytest.raises(ValueError, match="patch"):
        tables.read_issues(spark, str(tmp_path / "bad.parquet"))
    assert tables.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": None, "c": 5}, "d": None, "e": 1}) == {"a": {"b": 1, "c": 5}, "d": 3, "e": 1}
    text = "# c\nexport A=1\nB = \"x # y\"\nC=z # note\nD='q'\nbad line\n"
    assert tables.parse_env(text) == {"A": "1", "B": "x # y", "C": "z", "D": "q"}
    (tmp_path / ".env").write_text(text)
    monkeypatch.setenv("A", "kept")
    assert set(tables.load_env(str(tmp_path / ".env"))) == {"B", "C", "D"} and tables.load_env(str(tmp_path / "none")) == {}
    for name in "BCD":
        monkeypatch.delenv(name)


def test_sample_sink_round_trip(spark, tmp_path):
    kind = tables.SAMPLES.split("messages ")[1].split(", label ")[0]
    talk = [("assistant", None, None, [("a", None, ("bash", '{"command": "ls"}'))], None), ("tool", "x", None, [], "a")]
    rows = [(f"s{k}", f"i{k % 3}", "train" if k % 2 else "dev", talk) for k in range(40)]
    df = spark.createDataFrame(rows, f"sample_id string, instance_id string, split string, messages {kind}").withColumn("messages", sinks.stored_messages("messages"))
    path = sinks.write_samples(df, str(tmp_path / "out"))
    back = tables.read_samples(spark, path)
    assert back.filter("split = 'dev'").count() == 20 and back.count() == 40
    first = back.first().messages
    assert first[0].tool_calls[0].function.arguments == '{"command": "ls"}' and first[0].tool_calls[0].type == "function" and first[1].tool_calls is None
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_samples(df, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_table(df, path)


def test_reports_and_predictions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    as_json, as_text = sinks.write_report(df, str(tmp_path / "deep" / "report"), "Counts")
    assert json.loads(open(as_json).read()) == [{"k": "a", "v": 1}, {"k": "b", "v": None}] and "| a | 1 |" in open(as_text).read()
    with pytest.raises(ValueError):
        sinks.write_report(spark.range(5), str(tmp_path / "big"), "x", most_rows=3)
    both = sinks.concat_predictions(df, df.withColumn("truncated", F.lit(True)))
    assert both.count() == 4 and both.filter("truncated IS NULL").count() == 2


def test_configuration_traces_and_remembered_tables(spark, tmp_path):
    from stepwright import sinks
    from stepwright.sources import tables

    (tmp_path / "c.json").write_text('{"a": {"b": 2, "c": null}, "d": 1}')
    assert tables.read_config(str(tmp_path / "c.json"), {"a": {"b": 1, "c": 3}}) == {"a": {"b": 2, "c": 3}, "d": 1}
    assert tables.read_config(str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"a": {"b": 5}}))
    assert tables.read_config(str(tmp_path / "c.yaml"), {"a": {"c": 3}}) == {"a": {"b": 5, "c": 3}}
    assert json.loads(open(sinks.write_trace({"spans": [1]}, str(tmp_path / "x" / "y" / "t.json"))).read()) == {"spans": [1]}
    made = []
    table = lambda key: sinks.remembered(str(tmp_path / "kept"), key, lambda: made.append(key) or spark.range(3), spark).count()
    assert (table("k1"), table("k1"), table("k2"), made) == (3, 3, 3, ["k1", "k2"])
