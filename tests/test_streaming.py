import datetime as dt

import pytest

from stepwright.streaming import rollouts as R

KIND = "instance_id string, node_key string, rollout_idx int, is_consumed int, correct int, arrived_at timestamp_ntz"
T = dt.datetime(2025, 1, 1)


def test_state_over_batches_equals_the_batch(spark, tmp_path):
    rows = [(f"i{k % 3}", f"n{k % 2}", k % 5, int(k % 7 == 0), k % 2, T + dt.timedelta(hours=k)) for k in range(60)]
    for part in range(6):
        spark.createDataFrame(rows[part::6], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = lambda: R.stream_of(spark, str(tmp_path / "t"), 1)
    got = {r.instance_id: (r.n_slots, r.n_repeats, r.n_consumed) for r in R.ledger_totals(R.drain(R.ledger(stream()), "update", R.SLOT)).collect()}
    want = {}
    for i in {r[0] for r in rows}:
        slots = {}
        for r in rows:
            if r[0] == i:
                slots[r[1:3]] = max(slots.get(r[1:3], 0), r[3])
        want[i] = (len(slots), sum(r[0] == i for r in rows) - len(slots), sum(slots.values()))
    assert got == want
    rates = {(r.instance_id, r.node_key): r.n for r in R.drain(R.node_rates(stream()), "update", ["instance_id", "node_key"]).collect()}
    assert sum(rates.values()) == 60
    assert R.drain(R.first_deliveries(stream(), "400 days"), "append").count() == len({r[:3] for r in rows})
    assert sum(r.n for r in R.drain(R.arrivals(stream()), "complete").collect()) == 60


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "e"))
    assert R.drain(R.ledger(R.stream_of(spark, str(tmp_path / "e"))), "update", R.SLOT).count() == 0


STATE = ["instance_id string, node_key string, visits int, in_pool int", "instance_id string, node_key string, rollout_idx int, is_consumed int", "instance_id string, n_rounds int"]


def state_of(spark, rows):
    """Tables for the slots of ``rows``, none of them consumed."""
    nodes, slots, trees = sorted({r[:2] for r in rows}), sorted({r[:3] for r in rows}), sorted({r[0] for r in rows})
    return [spark.createDataFrame(x, s) for x, s in zip(([(*n, 1, 0) for n in nodes], [(*s, 0) for s in slots], [(t, 2) for t in trees]), STATE, strict=True)]


def hot(n):
    return [("hot" if k % 10 else f"i{k % 7}", "root" if k % 4 == 0 else f"n{k % 30}", k % 11, 1, 1, T + dt.timedelta(minutes=k)) for k in range(n)]


def test_sessions_are_committed_once_with_most_rows_on_one_instance(spark, tmp_path):
    rows = hot(1500)
    for part in range(3):
        spark.createDataFrame(rows[part::3], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    n, s, t = R.commit_sessions(R.stream_of(spark, str(tmp_path / "t"), 1), *state_of(spark, rows + [("idle", "n1", 0)]))
    used = {r[:3] for r in rows}
    assert {tuple(r)[:3]: r.is_consumed for r in s.collect()} == {k: 1 for k in used} | {("idle", "n1", 0): 0}
    count = lambda key: {k: sum(key(u) == k for u in used) for k in {key(u) for u in used}}
    visits = count(lambda u: u[:2])
    assert {(r.instance_id, r.node_key): (r.visits, r.in_pool) for r in n.collect()} == {k: (1 + v, int(k[1] != "root")) for k, v in visits.items()} | {("idle", "n1"): (1, 0)}
    rounds = count(lambda u: u[0] if u[1] != "root" else None)
    assert {r.instance_id: r.n_rounds for r in t.collect()} == {i: 2 + rounds.get(i, 0) for i in {u[0] for u in used} | {"idle"}}
    ledger = {r.instance_id: r.n_slots for r in R.ledger_totals(R.drain(R.ledger(R.stream_of(spark, str(tmp_path / "t"))), "update", R.SLOT)).collect()}
    assert ledger == count(lambda u: u[0])


def test_a_failed_commit_leaves_the_last_version(spark, tmp_path, monkeypatch):
    rows = hot(40)
    for part in range(2):
        spark.createDataFrame(rows[part::2], KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    marks, mark = [], R._mark

    def fails_at_the_second(spark, folder, version):
        if version == 1:
            raise OSError("lost")
        marks.append(folder)
        mark(spark, folder, version)

    monkeypatch.setattr(R, "_mark", fails_at_the_second)
    with pytest.raises(Exception, match="lost"):
        R.commit_sessions(R.stream_of(spark, str(tmp_path / "t"), 1), *state_of(spark, rows))
    assert sorted(R._marked(spark, marks[0])) == [-1, 0]
    base = marks[0].removesuffix("/done")
    first = spark.read.parquet(f"{base}/v0/slots").filter("is_consumed = 1").count()
    assert 0 < first < len({r[:3] for r in rows}) and spark.read.parquet(f"{base}/v0/nodes").selectExpr("sum(visits - 1) n").first().n == first


def test_without_a_shared_folder_a_cluster_is_refused(spark, monkeypatch):
    from stepwright import session

    class Context:
        master = "spark://host:7077"
        _jsc = None

    class None_:
        def isDefined(self):
            return False

    class Fake:
        sparkContext = Context
        conf = {}

    Context._jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: None_()})()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake)
