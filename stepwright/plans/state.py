"""Trees, nodes and rollouts: scans, Monte-Carlo tables, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright.operators import mc
from stepwright.session import table


def _q(function, *tables):
    def query(spark, sf):
        return function(*[table(spark, sf, t) for t in tables])

    return query


def _root_rollouts(rollouts):
    steps = F.try_parse_json("result_json")
    parsed = rollouts.filter("node_key = 'root'").withColumn("v", steps)
    return parsed.select("instance_id", "rollout_idx", "correct", "is_consumed", F.col("v").isNotNull().alias("readable"))


def _rollout_rows(rollouts):
    return rollouts.select("instance_id", "node_key", "rollout_idx", "is_consumed", "consumed_iteration", "correct", F.round("reward", 6).alias("reward"), "submitted", "replay_drift", "exit_status")


def _tree_state(trees, nodes, rollouts):
    """Each tree with its readable nodes and rollouts; cut-off JSON is counted and left out."""
    readable = lambda c: F.try_parse_json(c).isNotNull()
    n = nodes.groupBy("instance_id").agg(F.count_if(readable("prefix_json")).alias("n_nodes"), F.count_if(~readable("prefix_json")).alias("bad_nodes"), F.min("created_at").alias("first_node_at"))
    r = rollouts.groupBy("instance_id").agg(F.count_if(readable("result_json")).alias("n_rollouts"), F.count_if(~readable("result_json")).alias("bad_rollouts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return trees.select("instance_id", "status").join(n, "instance_id", "left").join(r, "instance_id", "left").select("instance_id", "status", zero("n_nodes"), zero("bad_nodes"), zero("n_rollouts"), zero("bad_rollouts"), F.round("first_node_at", 3).alias("first_node_at"))


def _in_pool(nodes):
    pool = (F.col("node_key") == "root") | (F.col("in_pool") == 1)
    return nodes.filter(pool & mc.gated("mc_score")).select("instance_id", "node_key", F.round("mc_score", 6).alias("mc_score"), "visits").distinct()


QUERIES = {
    "tree_status": _q(lambda t: t.select("instance_id", "status"), "tree_instances"),
    "heads_present": _q(lambda t: t.filter("messages_head_json IS NOT NULL").select("instance_id", F.length("messages_head_json").cast("bigint").alias("n_chars")), "tree_instances"),
    "nodes_ordered": _q(lambda n: n.select("instance_id", "node_key", "status", "visits", "in_pool").orderBy("instance_id", "node_key"), "nodes"),
    "root_rollouts": _q(_root_rollouts, "rollouts"),
    "rollout_rows": _q(_rollout_rows, "rollouts"),
    "tree_state": _q(_tree_state, "tree_instances", "nodes", "rollouts"),
    "mc_table": _q(lambda r: mc.mc_table(r).withColumn("mc", F.round("mc", 6)), "rollouts"),
    "mc_valid": _q(lambda r: mc.mc_valid(r).withColumn("mc", F.round("mc", 6)), "rollouts"),
    "mc_gate": _q(lambda r: mc.mc_table(r).filter(mc.gated()).select("instance_id", "node_key", F.round("mc", 6).alias("mc")), "rollouts"),
    "leaf_nodes": _q(lambda r: mc.mc_table(r).filter(mc.is_leaf()).select("instance_id", "node_key", "n"), "rollouts"),
    "leaf_counts": _q(mc.with_leaves, "tree_instances", "nodes"),
    "tree_summary": _q(mc.tree_summary, "tree_instances", "nodes", "rollouts"),
    "table_counts": _q(lambda t, n, r: mc.table_counts(tree_instances=t, nodes=n, rollouts=r), "tree_instances", "nodes", "rollouts"),
    "rollout_report": _q(mc.report, "tree_instances", "nodes", "rollouts"),
    "status_histogram": _q(lambda t: mc.histogram(t, "status"), "tree_instances"),
    "exit_histogram": _q(lambda r: mc.histogram(r, "exit_status"), "rollouts"),
    "run_stats": _q(mc.run_stats, "rollouts"),
    "selectable_nodes": _q(_in_pool, "nodes"),
    "latest_slots": _q(lambda r: mc.latest_rollouts(r.drop("result_json")).select("instance_id", "node_key", "rollout_idx", "is_consumed", F.round("reward", 6).alias("reward")), "rollouts"),
    "replay_drift": _q(lambda r: r.groupBy("instance_id").agg(F.count_if(F.col("replay_drift") != 0).alias("n_drift"), F.count(F.lit(1)).alias("n")), "rollouts"),
}

_MC = "SELECT instance_id, node_key, avg(CAST(correct AS DOUBLE)) AS mc, count(*) AS n FROM rollouts GROUP BY ALL"
_SUMMARY = """
    n AS (SELECT instance_id, count(*) AS n_nodes FROM nodes GROUP BY 1),
    r AS (SELECT instance_id, count(*) AS n_rollouts, sum(correct)::BIGINT AS n_correct, sum(is_consumed)::BIGINT AS n_consumed,
                 sum(submitted)::BIGINT AS n_submitted, avg(reward) AS avg_reward FROM rollouts GROUP BY 1),
    s AS (SELECT instance_id, status, n_rounds, root_mc, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_rollouts, 0) AS n_rollouts,
                 coalesce(n_correct, 0) AS n_correct, coalesce(n_consumed, 0) AS n_consumed, coalesce(n_submitted, 0) AS n_submitted,
                 round(avg_reward, 6) AS avg_reward FROM tree_instances LEFT JOIN n USING (instance_id) LEFT JOIN r USING (instance_id)),
    l AS (SELECT t.instance_id, t.status, coalesce(n_leaves, 0) AS n_leaves FROM tree_instances t LEFT JOIN
          (SELECT instance_id, count(*) AS n_leaves FROM nodes WHERE node_key <> 'root' AND mc_score = 0 GROUP BY 1) x USING (instance_id))"""
ORACLES = {
    "tree_status": "SELECT instance_id, status FROM tree_instances",
    "heads_present": "SELECT instance_id, length(messages_head_json) AS n_chars FROM tree_instances WHERE messages_head_json IS NOT NULL",
    "nodes_ordered": "SELECT instance_id, node_key, status, visits, in_pool FROM nodes ORDER BY 1, 2",
    "root_rollouts": "SELECT instance_id, rollout_idx, correct, is_consumed, json_valid(result_json) AS readable FROM rollouts WHERE node_key = 'root'",
    "rollout_rows": "SELECT instance_id, node_key, rollout_idx, is_consumed, consumed_iteration, correct, round(reward, 6) AS reward, submitted, replay_drift, exit_status FROM rollouts",
    "tree_state": """
        SELECT t.instance_id, t.status, coalesce(n.a, 0) AS n_nodes, coalesce(n.b, 0) AS bad_nodes, coalesce(r.a, 0) AS n_rollouts, coalesce(r.b, 0) AS bad_rollouts,
               round(n.c, 3) AS first_node_at FROM tree_instances t
        LEFT JOIN (SELECT instance_id, count(*) FILTER (json_valid(prefix_json)) AS a, count(*) FILTER (NOT json_valid(prefix_json)) AS b, min(created_at) AS c FROM nodes GROUP BY 1) n USING (instance_id)
        LEFT JOIN (SELECT instance_id, count(*) FILTER (json_valid(result_json)) AS a, count(*) FILTER (NOT json_valid(result_json)) AS b FROM rollouts GROUP BY 1) r USING (instance_id)""",
    "mc_table": f"SELECT instance_id, node_key, round(mc, 6) AS mc, n FROM ({_MC})",
    "mc_valid": """SELECT instance_id, node_key, round(coalesce(count(*) FILTER (correct = 1)::DOUBLE / nullif(count(correct), 0), 0), 6) AS mc,
                   count(correct) AS n_valid FROM rollouts GROUP BY ALL""",
    "mc_gate": f"SELECT instance_id, node_key, round(mc, 6) AS mc FROM ({_MC}) WHERE mc > 0 AND mc < 1",
    "leaf_nodes": f"SELECT instance_id, node_key, n FROM ({_MC}) WHERE node_key <> 'root' AND mc = 0",
    "leaf_counts": f"WITH {_SUMMARY} SELECT * FROM l",
    "tree_summary": f"WITH {_SUMMARY} SELECT * FROM s",
    "table_counts": "SELECT 'tree_instances' AS table_name, count(*) AS n FROM tree_instances UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'rollouts', count(*) FROM rollouts",
    "rollout_report": f"""WITH {_SUMMARY}, a AS (SELECT count(*) AS n_trees, count(*) FILTER (status = 'done') AS n_done, sum(n_nodes)::BIGINT AS n_nodes, sum(n_rollouts)::BIGINT AS n_rollouts,
            sum(n_correct)::BIGINT AS n_correct, sum(n_consumed)::BIGINT AS n_consumed, sum(n_submitted)::BIGINT AS n_submitted, sum(coalesce(avg_reward, 0) * n_rollouts) AS w FROM s),
        b AS (SELECT sum(n_leaves)::BIGINT AS n_leaves, count(*) FILTER (n_leaves > 0) AS trees_with_leaf FROM l)
        SELECT n_trees, n_done, n_nodes, n_rollouts, n_correct, n_consumed, n_submitted, n_leaves, trees_with_leaf, round(n_correct / n_rollouts, 4) AS correct_rate,
               round(n_submitted / n_rollouts, 4) AS submit_rate, round(w / n_rollouts, 4) AS mean_reward FROM a, b""",
    "status_histogram": "SELECT status, count(*) AS n FROM tree_instances GROUP BY 1",
    "exit_histogram": "SELECT exit_status, count(*) AS n FROM rollouts GROUP BY 1",
    "run_stats": """SELECT count(*) AS n_total, count(exit_status) AS n_ok, count(*) - count(exit_status) AS n_failed, round((count(*) - count(exit_status)) / count(*), 6) AS fail_rate,
        round(avg(n_steps) FILTER (exit_status IS NOT NULL), 6) AS avg_steps, round(avg(reward) FILTER (exit_status IS NOT NULL), 6) AS avg_reward FROM rollouts""",
    "selectable_nodes": "SELECT DISTINCT instance_id, node_key, round(mc_score, 6) AS mc_score, visits FROM nodes WHERE (node_key = 'root' OR in_pool = 1) AND mc_score > 0 AND mc_score < 1",
    "latest_slots": """SELECT instance_id, node_key, rollout_idx, is_consumed, round(reward, 6) AS reward FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, node_key, rollout_idx
        ORDER BY arrived_at DESC NULLS LAST, is_consumed DESC NULLS LAST, consumed_iteration DESC NULLS LAST, created_at DESC NULLS LAST, correct DESC NULLS LAST, reward DESC NULLS LAST) AS rn FROM rollouts) WHERE rn = 1""",
    "replay_drift": "SELECT instance_id, count(*) FILTER (replay_drift <> 0) AS n_drift, count(*) AS n FROM rollouts GROUP BY 1",
}
