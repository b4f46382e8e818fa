"""Queries around scorers, executors and trajectory evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright.operators import choose as C
from stepwright.operators import metrics as M
from stepwright.operators import scoring as Q
from stepwright.operators import search as G
from stepwright.operators import store as K
from stepwright.plans.evaluation import _D, _auc, scored
from stepwright.plans.tree_search import _MISSING
from stepwright.session import table


def _q(function, *tables):
    return lambda spark, sf: function(*[table(spark, sf, t) for t in tables])


def _heads(t, r):
    """Heads come from results where those have one, else from the tree."""
    return G.resolve_head(t, r, F.get_json_object("result_json", "$.messages_head")).select("instance_id", F.md5("head").alias("head"))


def _failures(r):
    """Per instance, rollouts by how they ended, failures as one text of status and number."""
    counts = r.groupBy("instance_id", "exit_status").agg(F.count(F.lit(1)).alias("n"))
    failed = F.coalesce("exit_status", F.lit("none")) != "Submitted"
    entry = F.when(failed, F.concat_ws("=", F.coalesce("exit_status", F.lit("none")), F.col("n").cast("string")))
    return counts.groupBy("instance_id").agg(F.sum(F.when(~failed, F.col("n")).otherwise(0)).alias("n_ok"), F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"), F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("failures"))


def _trajectory(r):
    """Correlation of the rollouts' aggregated scores with how they ended."""
    both = lambda c, y: M.rounded(M.pearson(F.col(c), F.col(y)), f"{c}_{y}")
    return _frame(r).agg(F.count(F.lit(1)).alias("n"), *[both(c, y) for c in _AGGS for y in _ENDS])


_AGGS, _ENDS = ("agg_mean", "agg_min", "agg_last", "agg_discounted"), ("reward", "correct", "submitted")


def _formula(prefixes):
    """Scores that SQL can repeat."""
    key = F.concat_ws(":", "instance_id", "node_key", F.col("rollout_idx").cast("string"), F.col("t").cast("string"))
    return prefixes.withColumn("p", F.round(F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("double") / 65535.0, 3))


def _frame(r, **limits):
    slots = r.groupBy(*K.SLOT).agg(*[F.max(c).alias(c) for c in ("n_steps", "correct", "reward", "exit_status", "submitted")])
    return Q.trajectory_frame(slots, K.SLOT, _formula, **limits)


def _frame_rows(r, **limits):
    return _frame(r, **limits).select("instance_id", "rollout_idx", F.round("reward", 6).alias("reward"), "correct", "submitted", "n_steps", "exit_status", *_AGGS, F.col("n_scores").alias("scored_steps"), F.array_join(F.transform("scores", lambda p: F.format_string("%.3f", p)), ",").alias("scores"))


def _gap(d):
    """AUC of samples by source of their label, and the gap between them."""
    auc = M.roc_auc(d, "y", "s", ["label_source"])
    value = lambda name: F.max(F.when(F.col("label_source") == name, F.col("auc")))
    return auc.agg(value("node_mc").alias("node_mc"), value("leaf_chain").alias("leaf_chain")).withColumn("gap", F.round(F.col("node_mc") - F.col("leaf_chain"), 6))


def _pick(b):
    """The sample whose length is nearest to each target; of equal ones the first."""
    targets = b.sparkSession.createDataFrame([(t,) for t in (100, 500, 1000)], "target int")
    wide = b.filter("rendered_tokens > 0").agg(*[F.min(F.struct(F.abs(F.col("rendered_tokens") - t).alias("d"), "row_id")).alias(f"t{t}") for t in (100, 500, 1000)])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"t{t}.row_id").alias("row_id")) for t in (100, 500, 1000)])).alias("x"))
    return long.select("x.target", "x.row_id").join(targets, "target", "left_semi")


def _verdicts(d):
    """Which of three ways to read a score ranks best."""
    ways = d.select("row_id", "y", F.explode(F.array(F.struct(F.lit("as_is").alias("pair"), F.col("s").alias("v")), F.struct(F.lit("turned").alias("pair"), (1 - F.col("s")).alias("v")), F.struct(F.lit("flat").alias("pair"), F.lit(0.5).alias("v")))).alias("w"))
    auc = M.roc_auc(ways.select("y", "w.pair", "w.v"), "y", "v", ["pair"])
    return C.usable_pair(auc, "pair", "auc")


QUERIES = {
    "light_trajectory": _q(lambda n: Q.light_trajectory(n, ["instance_id", "node_key"], "prefix_json"), "nodes"),
    "resolved_heads": _q(_heads, "tree_instances", "rollouts"),
    "failure_map": _q(_failures, "rollouts"),
    "scripted_rollouts": _q(lambda n, r: Q.scripted_rollouts(G.missing_slots(n, r, 5).withColumnRenamed("slot", "rollout_idx")), "nodes", "rollouts"),
    "batch_scores": _q(lambda b: Q.score(b.select("row_id", F.col("sample_id").alias("t")), ["row_id"], "t"), "build_dataset"),
    "trajectory_eval": _q(_trajectory, "rollouts"),
    "trajectory_frame": _q(_frame_rows, "rollouts"),
    "trajectory_frame_short": _q(lambda r: _frame_rows(r, most_steps=2, candidates=3), "rollouts"),
    "auc_gap": _q(lambda b: _gap(scored(b)), "build_dataset"),
    "nearest_length": _q(_pick, "build_dataset"),
    "verdict_pick": _q(lambda b: _verdicts(scored(b)), "build_dataset"),
    "eval_cap": _q(lambda b: b.filter("lower(trim(split)) = 'dev'").orderBy("row_id").limit(50).select("row_id"), "build_dataset"),
    "upsert_twice": _q(lambda r: K.upsert(K.upsert(*(h := _halves(r))), h[1]).select(*K.SLOT, F.round("reward", 6).alias("reward")), "rollouts"),
}


def _halves(r):
    from stepwright.plans.tree_search import _halves as halves

    return halves(r)


def _corr(x: str, y: str) -> str:
    return f"round(CASE WHEN NOT isnan(corr({x}::DOUBLE, {y}::DOUBLE)) THEN corr({x}::DOUBLE, {y}::DOUBLE) END, 6) AS {x}_{y}"


def _frame_sql(steps: int, candidates: int) -> str:
    """Root rollouts by slot, the first of each instance, with the scores of their first prefixes."""
    p = "round(('0x' || left(md5(instance_id || ':' || node_key || ':' || rollout_idx || ':' || t), 4))::INT / 65535.0::DOUBLE, 3)"
    return f"""sl AS (SELECT instance_id, node_key, rollout_idx, max(n_steps) AS n_steps, max(correct) AS correct, max(reward) AS reward, max(exit_status) AS exit_status, max(submitted) AS submitted FROM rollouts WHERE node_key = 'root' GROUP BY ALL),
        ro AS (SELECT * FROM sl QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY rollout_idx) <= {candidates}),
        pr AS (SELECT *, {p} AS p FROM (SELECT *, unnest(range(least(n_steps, {steps}))) AS t FROM ro WHERE n_steps > 0)),
        fr AS (SELECT instance_id, node_key, rollout_idx, any_value(n_steps) AS n_steps, any_value(correct) AS correct, any_value(reward) AS reward, any_value(exit_status) AS exit_status, any_value(submitted) AS submitted, count(*) AS scored_steps,
            round(avg(p), 6) AS agg_mean, round(min(p), 6) AS agg_min, round(arg_max(p, t), 6) AS agg_last, round(sum(pow(0.95, t) * p) / sum(pow(0.95, t)), 6) AS agg_discounted, string_agg(printf('%.3f', p), ',' ORDER BY t) AS scores FROM pr GROUP BY ALL)"""


def _oracles():
    from stepwright.plans.tree_search import _HALF

    u = "('0x' || substr(md5('42:' || instance_id || ':' || node_key || ':' || slot), {}, 4))::INT / 65536.0::DOUBLE"
    return {
        "resolved_heads": """WITH h AS (SELECT instance_id, first(x ORDER BY rollout_idx, x) AS x FROM (SELECT instance_id, rollout_idx, json_extract_string(CASE WHEN json_valid(result_json) THEN result_json END, '$.messages_head') AS x FROM rollouts)
            WHERE x IS NOT NULL GROUP BY 1) SELECT t.instance_id, md5(coalesce(h.x, messages_head_json)) AS head FROM tree_instances t LEFT JOIN h USING (instance_id)""",
        "failure_map": """WITH c AS (SELECT instance_id, coalesce(exit_status, 'none') AS s, count(*) AS n FROM rollouts GROUP BY ALL)
            SELECT instance_id, (coalesce(sum(n) FILTER (s = 'Submitted'), 0))::BIGINT AS n_ok, (coalesce(sum(n) FILTER (s <> 'Submitted'), 0))::BIGINT AS n_failed, coalesce(string_agg(s || '=' || n, ',' ORDER BY s || '=' || n) FILTER (s <> 'Submitted'), '') AS failures FROM c GROUP BY 1""",
        "scripted_rollouts": f"""WITH {_MISSING}, x AS (SELECT instance_id, node_key, slot::INT AS rollout_idx, {u.format(1)} AS f, ({u.format(5)} < 0.5)::INT AS correct, (floor({u.format(9)} * 6) + 1)::INT AS n_steps FROM m)
            SELECT instance_id, node_key, rollout_idx, correct, correct::DOUBLE AS reward, n_steps, 'Submitted' AS exit_status FROM x WHERE f >= 0.1""",
        "batch_scores": "SELECT row_id, (('0x' || left(md5(coalesce(sample_id, '')), 4))::INT % 1000) / 1000.0::DOUBLE AS score FROM build_dataset",
        "trajectory_eval": f"WITH {_frame_sql(32, 5)} SELECT count(*) AS n, {', '.join(_corr(c, y) for c in _AGGS for y in _ENDS)} FROM fr",
        "trajectory_frame": f"WITH {_frame_sql(32, 5)} SELECT instance_id, rollout_idx, round(reward, 6) AS reward, correct, submitted, n_steps, exit_status, {', '.join(_AGGS)}, scored_steps, scores FROM fr",
        "trajectory_frame_short": f"WITH {_frame_sql(2, 3)} SELECT instance_id, rollout_idx, round(reward, 6) AS reward, correct, submitted, n_steps, exit_status, {', '.join(_AGGS)}, scored_steps, scores FROM fr",
        "auc_gap": f"WITH {_D}, a AS ({_auc('label_source')}), b AS (SELECT max(auc) FILTER (label_source = 'node_mc') AS node_mc, max(auc) FILTER (label_source = 'leaf_chain') AS leaf_chain FROM a) SELECT *, round(node_mc - leaf_chain, 6) AS gap FROM b",
        "nearest_length": "SELECT t::INT AS target, (SELECT first(row_id ORDER BY abs(rendered_tokens - t), row_id) FROM build_dataset WHERE rendered_tokens > 0) AS row_id FROM (VALUES (100), (500), (1000)) v(t)",
        "verdict_pick": f"""WITH {_D}, w AS (SELECT y, 'as_is' AS pair, s AS v FROM d UNION ALL SELECT y, 'turned', 1 - s FROM d UNION ALL SELECT y, 'flat', 0.5 FROM d), a AS ({_auc('pair', 'w', 'v')})
            SELECT pair, auc, auc > 0.55 AS usable FROM a ORDER BY coalesce(auc, -1) DESC, pair LIMIT 1""",
        "eval_cap": "SELECT row_id FROM build_dataset WHERE lower(trim(split)) = 'dev' ORDER BY row_id LIMIT 50",
        "upsert_twice": f"WITH {_HALF} SELECT instance_id, node_key, rollout_idx, round(CASE WHEN new.instance_id IS NOT NULL THEN new.reward ELSE old.reward END, 6) AS reward FROM old FULL JOIN new USING (instance_id, node_key, rollout_idx)",
    }


ORACLES = _oracles()
