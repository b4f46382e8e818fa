"""Streams over the rollouts, drained, so that they can be compared with batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright.session import table
from stepwright.streaming import rollouts as R


def _stream(spark, sf):
    return R.stream_of(spark, f"{sf}/rollouts.parquet").drop("result_json")


def stream_mc(spark, sf):
    """Rates a node: each batch gives the nodes that it changed, the last state of each counts."""
    return R.drain(R.node_rates(_stream(spark, sf)), "update", ["instance_id", "node_key"])


def stream_arrivals(spark, sf):
    """Rollouts a day of arrival, complete mode: there are as many rows as days."""
    out = R.drain(R.arrivals(_stream(spark, sf)), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "n_correct")


def stream_ledger(spark, sf):
    """Slots, repeats and consumed slots an instance, from the state of each slot."""
    return R.ledger_totals(R.drain(R.ledger(_stream(spark, sf)), "update", R.SLOT))


def stream_dedupe(spark, sf):
    """Slots after repeated deliveries are dropped, counted an instance; the table isn't in the order of arrival and is read as one
    batch, so the delay holds for all of it and state for later batches is for 30 days of arrival."""
    stream = R.stream_of(spark, f"{sf}/rollouts.parquet", 1_000_000).drop("result_json")
    return R.drain(R.first_deliveries(stream).select(*R.SLOT), "append").groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))


def stream_commit(spark, sf):
    """Every consumed rollout as the end of a session: visits and pool of its node after all commits, of the nodes that changed."""
    stream = _stream(spark, sf).filter("is_consumed = 1").select(*R.SLOT)
    nodes = table(spark, sf, "nodes").groupBy("instance_id", "node_key").agg(F.max("visits").alias("visits"), F.max("in_pool").alias("in_pool"))
    slots = table(spark, sf, "rollouts").select(*R.SLOT, F.lit(0).alias("is_consumed")).distinct()
    trees = table(spark, sf, "tree_instances").select("instance_id", "n_rounds")
    n, s, t = R.commit_sessions(stream, nodes, slots, trees)
    used = s.groupBy("instance_id", "node_key").agg(F.sum("is_consumed").alias("n_consumed"))
    return n.join(used, ["instance_id", "node_key"]).join(t, "instance_id").select("instance_id", "node_key", "visits", "in_pool", F.col("n_consumed").cast("bigint").alias("n_consumed"))


QUERIES = {"stream_mc": stream_mc, "stream_arrivals": stream_arrivals, "stream_ledger": stream_ledger, "stream_dedupe": stream_dedupe, "stream_commit": stream_commit}
ORACLES = {
    "stream_mc": "SELECT instance_id, node_key, round(avg(CAST(correct AS DOUBLE)), 6) AS mc, count(*) AS n FROM rollouts GROUP BY ALL",
    "stream_arrivals": "SELECT date_trunc('day', arrived_at)::TIMESTAMP AS start, count(*) AS n, count(*) FILTER (correct = 1) AS n_correct FROM rollouts GROUP BY 1",
    "stream_ledger": """WITH s AS (SELECT instance_id, node_key, rollout_idx, count(*) AS k, max(is_consumed) AS c FROM rollouts GROUP BY ALL)
        SELECT instance_id, count(*) AS n_slots, sum(k - 1)::BIGINT AS n_repeats, count(*) FILTER (c > 0) AS n_consumed FROM s GROUP BY 1""",
    "stream_commit": """WITH k AS (SELECT DISTINCT instance_id, node_key, rollout_idx FROM rollouts WHERE is_consumed = 1), c AS (SELECT instance_id, node_key, count(*) AS k FROM k GROUP BY ALL),
        n AS (SELECT instance_id, node_key, max(visits) AS v, max(in_pool) AS p FROM nodes GROUP BY ALL), u AS (SELECT DISTINCT instance_id, node_key FROM rollouts)
        SELECT instance_id, node_key, (v + coalesce(k, 0))::INT AS visits, (CASE WHEN k IS NOT NULL AND node_key <> 'root' THEN 1 ELSE p END)::INT AS in_pool, coalesce(k, 0) AS n_consumed
        FROM n JOIN u USING (instance_id, node_key) LEFT JOIN c USING (instance_id, node_key) JOIN (SELECT instance_id FROM tree_instances) t USING (instance_id)""",
    "stream_dedupe": "SELECT instance_id, count(*) AS n FROM (SELECT DISTINCT instance_id, node_key, rollout_idx FROM rollouts) GROUP BY 1",
}
