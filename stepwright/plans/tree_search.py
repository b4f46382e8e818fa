"""Search, state changes and best-of-N on the state tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwright.operators import choose as C
from stepwright.operators import search as G
from stepwright.operators import store as K
from stepwright.session import table


def _q(function, *tables):
    return lambda spark, sf: function(*[table(spark, sf, t) for t in tables])


def _nodes(n):
    """Each node once, by its greatest ledger."""
    return n.groupBy("instance_id", "node_key").agg(F.max("mc_score").alias("mc_score"), F.max("visits").alias("visits"), F.max("in_pool").alias("in_pool"))


def _slots(r):
    """Each slot once, by its greatest ledger."""
    return r.groupBy(*K.SLOT).agg(F.max("is_consumed").alias("is_consumed"), F.max("n_steps").alias("n_steps"), F.max("correct").alias("correct"), F.max("reward").alias("reward"), F.max("exit_status").alias("exit_status"))


def _budget(n, r):
    asked = G.missing_slots(n, r, 5).groupBy("instance_id", "node_key").agg(F.count(F.lit(1)).alias("n"))
    return G.allocate(asked, ["node_key"], budget=300, per_instance=4)


def _bisect(r):
    """Sessions on the root rollouts; the rate of a prefix is a closed formula of its length and the instance."""
    sessions = _slots(r).filter("node_key = 'root' AND n_steps >= 2").groupBy("instance_id").agg(F.max("n_steps").alias("length")).select(F.col("instance_id").alias("session"), F.lit(0).alias("base"), "length")
    every = sessions.select("session", "length", F.explode(F.sequence(F.lit(1), F.col("length"))).alias("probe"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", "session", F.col("probe").cast("string"))), 1, 4), 16, 10).cast("int")
    rates = every.select("session", "probe", (F.pmod(key, F.lit(6)) / F.lit(5.0)).alias("mc"))
    return G.bisect(sessions, rates)


def _halves(r):
    slots = _slots(r)
    odd = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in K.SLOT])), 1, 4), 16, 10).cast("int"), F.lit(3))
    return slots.filter(odd != 0), slots.filter(odd != 1).withColumn("reward", F.round(F.col("reward") + 1, 4)).withColumn("is_consumed", F.lit(9))


def _upsert(r):
    return K.upsert(*_halves(r)).select(*K.SLOT, "is_consumed", F.round("reward", 6).alias("reward"))


def _insert(r):
    return K.insert_ignore(*_halves(r), K.SLOT).select(*K.SLOT, "is_consumed", "inserted")


def _delete(t, n, r):
    """What is left of each table, as (table_name, key)."""
    left = K.delete_instances(t.filter("status <> 'done'"), tree_instances=t, nodes=n, rollouts=r)
    key = {"tree_instances": ["instance_id"], "nodes": ["instance_id", "node_key"], "rollouts": ["instance_id", "node_key", "rollout_idx"]}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), F.concat_ws("|", *[F.col(c).cast("string") for c in key[name]]).alias("key")) for name, df in left.items()])


def _commit(t, n, r):
    """The rows of the three tables that a round of sessions changed, with their new values."""
    nodes, slots, trees = _nodes(n), _slots(r), t.select("instance_id", "n_rounds")
    picked = G.qu_select(G.qu_scores(nodes, slots))
    a, b, c = G.consume(nodes, slots, trees, picked, picked.filter("node_key <> 'root'"))
    row = lambda df, name, key, values: df.select(F.lit(name).alias("table_name"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"), F.concat_ws("|", *[F.col(v).cast("string") for v in values]).alias("state"))
    parts = [("nodes", nodes, a, ["instance_id", "node_key"], ["visits", "in_pool"]), ("rollouts", slots, b, K.SLOT, ["is_consumed"]), ("tree_instances", trees, c, ["instance_id"], ["n_rounds"])]
    changed = [row(new, name, key, values).join(row(old, name, key, values), ["table_name", "key", "state"], "left_anti") for name, old, new, key, values in parts]
    return reduce(DataFrame.unionByName, changed)


def _scores(r):
    """A score for every prefix of a rollout: a closed formula of the slot and the step."""
    key = F.concat_ws(":", "instance_id", "node_key", F.col("rollout_idx").cast("string"), F.col("t").cast("string"))
    p = F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("double") / 65535.0
    return _slots(r).filter("n_steps > 0").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n_steps") - 1))).withColumn("p", F.round(p, 3))


def _resumed(t, n, r):
    out = G.resumed(t.select("instance_id", "status"), _nodes(n), _slots(r))
    return out.select("instance_id", "node_key", F.round("mc", 6).alias("mc"), "n_valid", "visits", "n_consumed", "n_open")


def _statuses(t, n, r):
    """What each tree is after its root's rollouts, by the state as it stands."""
    return G.statuses(t.select("instance_id", "status", "n_rounds"), _nodes(n), _slots(r), budget_left=False).select("instance_id", "status", F.round("root_mc", 6).alias("root_mc"))


def _root_candidates(r):
    """Root rollouts with the aggregates of their prefixes."""
    agg = C.rollout_aggregates(_scores(r), K.SLOT)
    return _slots(r).filter("node_key = 'root'").join(agg, K.SLOT, "left")


QUERIES = {
    "qu_scores": _q(lambda n, r: G.qu_scores(_nodes(n), _slots(r)).withColumn("qu", F.round("qu", 6)), "nodes", "rollouts"),
    "qu_select": _q(lambda n, r: G.qu_select(G.qu_scores(_nodes(n), _slots(r))).withColumn("qu", F.round("qu", 6)), "nodes", "rollouts"),
    "missing_slots": _q(lambda n, r: G.missing_slots(n, r, 5), "nodes", "rollouts"),
    "slot_array": _q(lambda n, r: G.slot_array(n, r, 5, "correct").select("instance_id", "node_key", F.array_join(F.transform("slots", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), "").alias("slots")), "nodes", "rollouts"),
    "budget_alloc": _q(_budget, "nodes", "rollouts"),
    "task_order": _q(lambda r: G.task_order(r.select(F.concat_ws("/", "instance_id", "node_key", F.col("rollout_idx").cast("string")).alias("task_id"), (F.col("node_key") != "root").cast("int").alias("priority"), F.col("created_at").alias("seq"))), "rollouts"),
    "bisect_trace": _q(_bisect, "rollouts"),
    "session_commit": _q(_commit, "tree_instances", "nodes", "rollouts"),
    "resumed_pool": _q(_resumed, "tree_instances", "nodes", "rollouts"),
    "tree_statuses": _q(_statuses, "tree_instances", "nodes", "rollouts"),
    "upsert_merge": _q(_upsert, "rollouts"),
    "insert_ignore": _q(_insert, "rollouts"),
    "cascade_delete": _q(_delete, "tree_instances", "nodes", "rollouts"),
    "rollout_aggs": _q(lambda r: C.rollout_aggregates(_scores(r), K.SLOT), "rollouts"),
    "cap_candidates": _q(lambda r: C.cap(_slots(r).filter("node_key = 'root'"), "instance_id", 3).select("instance_id", "rollout_idx"), "rollouts"),
    "selectors": _q(lambda r: C.selected(_root_candidates(r)).withColumn("reward", F.round("reward", 6)), "rollouts"),
    "best_of": _q(lambda r: C.best_of(C.selected(_root_candidates(r))), "rollouts"),
    "best_of_intervals": _q(lambda r: C.paired_intervals(C.selected(_root_candidates(r))), "rollouts"),
    "candidate_histogram": _q(lambda r: C.candidate_histogram(_slots(r).filter("node_key = 'root'"), "instance_id"), "rollouts"),
}

_B = """n AS (SELECT instance_id, node_key, max(mc_score) AS mc_score, max(visits) AS visits, max(in_pool) AS in_pool FROM nodes GROUP BY ALL),
    r AS (SELECT instance_id, node_key, rollout_idx, max(is_consumed) AS is_consumed, max(n_steps) AS n_steps, max(correct) AS correct, max(reward) AS reward, max(exit_status) AS exit_status FROM rollouts GROUP BY ALL)"""
_QU = f"""{_B}, pool AS (SELECT *, sum(visits) OVER (PARTITION BY instance_id) AS total FROM n WHERE node_key = 'root' OR in_pool = 1),
    qu AS (SELECT p.instance_id, p.node_key, r.rollout_idx, round(pow(0.5, 1 - mc_score) * pow(0.9, coalesce(n_steps, 0) / 6.0) + 0.125 * sqrt(total) / (1 + visits), 9) AS qu
        FROM pool p JOIN r ON r.instance_id = p.instance_id AND r.node_key = p.node_key WHERE mc_score > 0 AND mc_score < 1 AND is_consumed = 0 AND exit_status IS NOT NULL),
    best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY qu DESC, node_key, rollout_idx) AS rn FROM qu) WHERE rn = 1)"""
_MISSING = "m AS (SELECT DISTINCT instance_id, node_key, s AS slot FROM nodes, range(5) t(s) WHERE NOT EXISTS (SELECT 1 FROM rollouts x WHERE x.instance_id = nodes.instance_id AND x.node_key = nodes.node_key AND x.rollout_idx = s))"
_HALF = f"""{_B}, h AS (SELECT *, ('0x' || left(md5(instance_id || '|' || node_key || '|' || rollout_idx), 4))::INT % 3 AS o FROM r),
    old AS (SELECT * FROM h WHERE o <> 0), new AS (SELECT * REPLACE (round(reward + 1, 4) AS reward, 9 AS is_consumed) FROM h WHERE o <> 1)"""
_SCORES = f"""{_B}, sc AS (SELECT instance_id, node_key, rollout_idx, t, round(('0x' || left(md5(instance_id || ':' || node_key || ':' || rollout_idx || ':' || t), 4))::INT / 65535.0::DOUBLE, 3) AS p
        FROM (SELECT *, unnest(range(n_steps)) AS t FROM r WHERE n_steps > 0)),
    ag AS (SELECT instance_id, node_key, rollout_idx, count(*) AS n_scores, round(avg(p), 6) AS agg_mean, round(min(p), 6) AS agg_min, round(max_by(p, t), 6) AS agg_last, round(sum(pow(0.95, t) * p) / sum(pow(0.95, t)), 6) AS agg_discounted FROM sc GROUP BY ALL),
    ca AS (SELECT r.*, n_scores, agg_mean, agg_min, agg_last FROM r LEFT JOIN ag USING (instance_id, node_key, rollout_idx) WHERE node_key = 'root'),
    se AS (SELECT instance_id, selector, first(rollout_idx ORDER BY k1, k2, rollout_idx) AS rollout_idx, first(reward ORDER BY k1, k2, rollout_idx) AS reward, first(correct ORDER BY k1, k2, rollout_idx) AS correct FROM (
        SELECT *, 'shortest' AS selector, coalesce(n_steps, 'inf'::DOUBLE) AS k1, '' AS k2 FROM ca UNION ALL SELECT *, 'oracle', -coalesce(reward, '-inf'::DOUBLE), '' FROM ca UNION ALL SELECT *, 'prm_mean', -coalesce(agg_mean, '-inf'::DOUBLE), '' FROM ca
        UNION ALL SELECT *, 'prm_min', -coalesce(agg_min, '-inf'::DOUBLE), '' FROM ca UNION ALL SELECT *, 'prm_last', -coalesce(agg_last, '-inf'::DOUBLE), '' FROM ca
        UNION ALL SELECT *, 'random', 0, sha1('42:' || instance_id || ':' || rollout_idx) FROM ca) GROUP BY ALL)"""
ORACLES = {
    "qu_scores": f"WITH {_QU} SELECT instance_id, node_key, rollout_idx, round(qu, 6) AS qu FROM qu",
    "qu_select": f"WITH {_QU} SELECT instance_id, node_key, rollout_idx, round(qu, 6) AS qu FROM best",
    "missing_slots": f"WITH {_MISSING} SELECT instance_id, node_key, slot::INT AS slot FROM m",
    "slot_array": f"""WITH {_B}, k AS (SELECT DISTINCT instance_id, node_key FROM nodes) SELECT k.instance_id, k.node_key, string_agg(coalesce(r.correct::VARCHAR, '-'), '' ORDER BY s) AS slots
        FROM k CROSS JOIN range(5) t(s) LEFT JOIN r ON r.instance_id = k.instance_id AND r.node_key = k.node_key AND r.rollout_idx = s GROUP BY ALL""",
    "budget_alloc": f"""WITH {_MISSING}, a AS (SELECT instance_id, node_key, count(*) AS n FROM m GROUP BY ALL),
        b AS (SELECT *, greatest(0, least(n, 4 - coalesce(sum(n) OVER (PARTITION BY instance_id ORDER BY node_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS c FROM a)
        SELECT instance_id, node_key, n, greatest(0, least(c, 300 - coalesce(sum(c) OVER (ORDER BY md5(instance_id), instance_id, node_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS allowed FROM b""",
    "task_order": """SELECT task_id, priority, seq FROM (SELECT instance_id || '/' || node_key || '/' || rollout_idx AS task_id, (node_key <> 'root')::INT AS priority, created_at AS seq,
        row_number() OVER (PARTITION BY instance_id, node_key, rollout_idx ORDER BY created_at NULLS FIRST) AS rn FROM rollouts) WHERE rn = 1""",
    "bisect_trace": f"""WITH RECURSIVE {_B}, s AS (SELECT instance_id AS session, max(n_steps)::INT AS length FROM r WHERE node_key = 'root' AND n_steps >= 2 GROUP BY 1),
        w AS (SELECT session, 0 AS confirmed, length AS span, 0 AS probe, '' AS kind FROM s
            UNION ALL SELECT session, CASE WHEN mc > 0 THEN pr ELSE confirmed END, CASE WHEN mc > 0 THEN span - span // 2 ELSE span // 2 END, pr, CASE WHEN mc > 0 THEN 'expanded' ELSE 'leaf' END
            FROM (SELECT *, confirmed + span // 2 AS pr, (('0x' || left(md5(session || ':' || (confirmed + span // 2)), 4))::INT % 6) / 5.0::DOUBLE AS mc FROM w WHERE span >= 2) WHERE mc < 1)
        SELECT session, probe, kind FROM w WHERE kind <> ''""",
    "session_commit": f"""WITH {_QU} SELECT 'nodes' AS table_name, instance_id || '|' || node_key AS key, (visits + 1) || '|' || CASE WHEN node_key <> 'root' THEN 1 ELSE in_pool END AS state FROM n JOIN (SELECT instance_id, node_key FROM best) USING (instance_id, node_key)
        UNION ALL SELECT 'rollouts', instance_id || '|' || node_key || '|' || rollout_idx, '1' FROM best
        UNION ALL SELECT 'tree_instances', instance_id, (n_rounds + 1)::VARCHAR FROM tree_instances WHERE instance_id IN (SELECT instance_id FROM best WHERE node_key <> 'root')""",
    "resumed_pool": f"""WITH {_B}, live AS (SELECT DISTINCT instance_id FROM tree_instances WHERE status NOT IN ('done', 'failed')),
        u AS (SELECT instance_id, node_key, coalesce(avg(correct::DOUBLE), 0) AS mc, count(correct) AS n_valid, count(*) FILTER (is_consumed = 1) AS n_consumed, count(*) FILTER (is_consumed = 0 AND exit_status IS NOT NULL) AS n_open FROM r GROUP BY ALL)
        SELECT instance_id, node_key, round(mc, 6) AS mc, coalesce(n_valid, 0) AS n_valid, visits, coalesce(n_consumed, 0) AS n_consumed, coalesce(n_open, 0) AS n_open
        FROM n JOIN live USING (instance_id) LEFT JOIN u USING (instance_id, node_key) WHERE node_key = 'root' OR in_pool = 1""",
    "tree_statuses": f"""WITH {_QU}, ro AS (SELECT instance_id, coalesce(avg(correct::DOUBLE), 0) AS root_mc, count(correct) AS v FROM r WHERE node_key = 'root' GROUP BY 1),
        t AS (SELECT instance_id, status AS old, n_rounds FROM tree_instances),
        w AS (SELECT DISTINCT qu.instance_id FROM qu JOIN t USING (instance_id) WHERE n_rounds < 20 OR node_key = 'root')
        SELECT t.instance_id, CASE WHEN old IN ('done', 'failed') THEN old WHEN coalesce(v, 0) = 0 THEN 'failed' WHEN w.instance_id IS NOT NULL THEN 'budget_exhausted' ELSE 'done' END AS status,
            round(CASE WHEN coalesce(v, 0) > 0 THEN root_mc END, 6) AS root_mc FROM t LEFT JOIN ro USING (instance_id) LEFT JOIN w ON w.instance_id = t.instance_id""",
    "upsert_merge": f"""WITH {_HALF} SELECT instance_id, node_key, rollout_idx, coalesce(old.is_consumed, new.is_consumed) AS is_consumed, round(CASE WHEN new.instance_id IS NOT NULL THEN new.reward ELSE old.reward END, 6) AS reward
        FROM old FULL JOIN new USING (instance_id, node_key, rollout_idx)""",
    "insert_ignore": f"""WITH {_HALF} SELECT instance_id, node_key, rollout_idx, is_consumed, false AS inserted FROM old UNION ALL
        SELECT instance_id, node_key, rollout_idx, is_consumed, true FROM new WHERE o = 0""",
    "cascade_delete": """WITH g AS (SELECT instance_id FROM tree_instances WHERE status <> 'done') SELECT 'tree_instances' AS table_name, instance_id AS key FROM tree_instances WHERE instance_id NOT IN (SELECT * FROM g)
        UNION ALL SELECT 'nodes', concat_ws('|', instance_id, node_key) FROM nodes WHERE instance_id NOT IN (SELECT * FROM g)
        UNION ALL SELECT 'rollouts', concat_ws('|', instance_id, node_key, rollout_idx) FROM rollouts WHERE instance_id NOT IN (SELECT * FROM g)""",
    "rollout_aggs": f"WITH {_SCORES} SELECT * FROM ag",
    "cap_candidates": f"WITH {_B} SELECT instance_id, rollout_idx FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY rollout_idx) AS rn FROM r WHERE node_key = 'root') WHERE rn <= 3",
    "selectors": f"WITH {_SCORES} SELECT instance_id, selector, rollout_idx, round(reward, 6) AS reward, correct FROM se",
    "best_of": f"""WITH {_SCORES} SELECT s.selector, count(*) AS n, round(avg(s.reward), 6) AS mean_reward, round(avg(s.correct), 6) AS correct_rate, round(avg(o.reward - s.reward), 6) AS regret,
        round(avg(CASE WHEN s.reward > b.reward THEN 1.0 WHEN s.reward = b.reward THEN 0.5 ELSE 0 END), 6) AS win_rate, round(avg(s.reward - b.reward), 6) AS mean_difference
        FROM se s JOIN se o ON o.instance_id = s.instance_id AND o.selector = 'oracle' JOIN se b ON b.instance_id = s.instance_id AND b.selector = 'random' GROUP BY 1""",
    "candidate_histogram": f"WITH {_B} SELECT n_candidates, count(*) AS n_keys FROM (SELECT count(*) AS n_candidates FROM r WHERE node_key = 'root' GROUP BY instance_id) GROUP BY 1",
}

_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
ORACLES["best_of_intervals"] = f"""WITH {_SCORES}, g AS (SELECT s.instance_id, s.selector, unnest([{{'measure': 'reward', 'gap': s.reward::DOUBLE - b.reward::DOUBLE}}, {{'measure': 'correct', 'gap': s.correct::DOUBLE - b.correct::DOUBLE}}]) AS x
        FROM se s JOIN se b ON b.instance_id = s.instance_id AND b.selector = 'random' WHERE s.selector <> 'random'),
    w AS (SELECT selector, x.measure AS measure, x.gap AS gap, b, ('0x' || left(md5('42:' || b || ':' || instance_id), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM g, range(1, 201) t(b) WHERE x.gap IS NOT NULL),
    m AS (SELECT selector, measure, b, sum(k * gap) / sum(k) AS mean FROM (SELECT *, {' + '.join(f'(u >= {c!r}::DOUBLE)::INT' for c in _CDF)} AS k FROM w) WHERE k > 0 GROUP BY ALL)
    SELECT selector, measure, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, count(*) AS n_boot FROM m GROUP BY ALL"""
