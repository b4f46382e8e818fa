"""Problems 2 and 4: flat tables of nested records, and per-key results under skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepwright.operators import nested, skew
from stepwright.session import table


def _holders(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, t) for t in ("build_dataset", "nodes", "rollouts")]


def _flat(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return nested.table_of(nested.holders(*_holders(spark, sf), kinds=(kind,)), kind)

    query.__doc__ = f"Every {kind} of the three nested holders as a flat row."
    return query


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls that no answer belongs to."""
    return nested.unanswered_calls(*_holders(spark, sf))


def p4_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, success rates and latest rows per repo and per instance of the rollouts."""
    return skew.repo_stats(table(spark, sf, "instances")).unionByName(skew.rollout_stats(table(spark, sf, "rollouts")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that hold at least 4 % of all rows of their table."""
    instances, rollouts = table(spark, sf, "instances"), table(spark, sf, "rollouts")
    heavy = skew.heavy_keys(skew.repo_stats(instances), instances.count()).unionByName(
        skew.heavy_keys(skew.rollout_stats(rollouts), rollouts.count())
    )
    return heavy.select("table_name", "key_value")


QUERIES = {
    "p2_found": p2_found,
    "p2_steps": _flat("step"),
    "p2_calls": _flat("call"),
    "p2_answers": _flat("answer"),
    "p2_matches": _flat("match"),
    "p4_found": p4_found,
    "p4_stats": p4_stats,
}
ORACLES = {
    "p4_found": """
        SELECT 'instances' AS table_name, repo AS key_value FROM instances WHERE repo IS NOT NULL
        GROUP BY repo HAVING count(*) >= 0.04 * (SELECT count(*) FROM instances)
        UNION ALL
        SELECT 'rollouts', instance_id FROM rollouts WHERE instance_id IS NOT NULL
        GROUP BY instance_id HAVING count(*) >= 0.04 * (SELECT count(*) FROM rollouts)""",
    "p4_stats": """
        WITH i AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY loaded_at DESC NULLS LAST, instance_id DESC NULLS LAST,
                          source DESC NULLS LAST) AS rn FROM instances),
             r AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY arrived_at DESC NULLS LAST, created_at DESC NULLS LAST,
                          node_key DESC NULLS LAST, rollout_idx DESC NULLS LAST) AS rn FROM rollouts)
        SELECT 'instances' AS table_name, repo AS key_value, count(*) AS n_rows, count(use_patch) AS n_judged,
               count(*) FILTER (use_patch) AS n_success, (count(*) FILTER (use_patch))::DOUBLE / nullif(count(use_patch), 0) AS success_rate,
               max(instance_id) FILTER (rn = 1) AS latest_row,
               rtrim(rtrim(strftime(max(loaded_at) FILTER (rn = 1), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS latest_at
        FROM i GROUP BY repo
        UNION ALL
        SELECT 'rollouts', instance_id, count(*), count(correct), count(*) FILTER (correct = 1),
               (count(*) FILTER (correct = 1))::DOUBLE / nullif(count(correct), 0),
               max(node_key || '|' || rollout_idx) FILTER (rn = 1),
               rtrim(rtrim(strftime(max(arrived_at) FILTER (rn = 1), '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')
        FROM r GROUP BY instance_id""",
}
