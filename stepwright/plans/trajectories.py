"""Trajectories and samples on the samples before dedupe, and on nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright.operators import mc as M
from stepwright.operators import repo_splits as RS
from stepwright.operators import samples as D
from stepwright.operators import steps as S
from stepwright.session import table


def _q(function, *tables):
    def query(spark, sf):
        return function(*[table(spark, sf, t) for t in tables or ("build_dataset",)])

    return query


def _step_sizes(b):
    steps = b.select("row_id", F.posexplode(S.split_steps("messages")).alias("at", "s"))
    return steps.select("row_id", (F.col("at") + 1).alias("step_index"), F.size("s.tail").cast("bigint").alias("n_tail"))


def _prefix_keys(b):
    return b.select("row_id", F.posexplode(S.prefix_keys(S.split_steps("messages"))).alias("k", "node_key"))


def _canonical(b):
    c = S.canonical("messages")
    text = F.array_join(F.transform(c, lambda m: F.concat_ws("|", m["role"], m["content"], F.coalesce(m["reasoning_content"], F.lit("-")), F.coalesce(F.size(m["tool_calls"]).cast("string"), F.lit("-")), F.coalesce(m["tool_call_id"], F.lit("-")))), "\n")
    return b.select("row_id", F.size(c).cast("bigint").alias("n"), F.md5(text).alias("digest"))


def _rendered(b):
    text = S.rendered_text(S.canonical("messages"))
    return b.select("row_id", F.length(text).cast("bigint").alias("n_chars"), S.approx_tokens(text).cast("bigint").alias("tokens"))


def _round_trip(b):
    flat = S.flattened(S.split_steps("messages"))
    return b.select("row_id", F.size(flat).cast("bigint").alias("n_flat"), F.md5(F.array_join(F.transform(flat, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")).alias("digest"))


def _prompt(b):
    p = S.prompt("Judge the last step.", F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"], S.canonical("messages"), "Was it right?")
    return b.select("row_id", F.size(p).cast("bigint").alias("n"), F.md5(F.array_join(F.transform(p, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")).alias("digest"))


def _keyed(b):
    return b.select("row_id", "instance_id", "step_index", "node_key", F.lower(F.trim("label_source")).alias("label_source"), F.md5(S.rendered_text("messages")).alias("prefix"))


def _deduped(b):
    return D.dedupe(_keyed(b), ["instance_id", "prefix", "step_index"], ["node_key", "row_id"])


def _node_samples(n, r, i, t):
    out = D.node_samples(n, r, RS.make_splits(i), t)
    return out.select("instance_id", "repo", "prm_split", "node_key", "step_index", F.col("steps").cast("bigint").alias("steps"), F.round("label", 6).alias("label"), "label_source", F.round("mc", 6).alias("mc"), "n")


def _eligibility(n, r):
    return M.eligibility(n.select("instance_id", "node_key", "mc_score", "prefix_json"), M.mc_table(r), D.n_steps(), D.key_matches()).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


def _labels(r):
    m = M.mc_table(r).filter("mc IS NOT NULL")
    return m.select("instance_id", "node_key", D.binary(F.col("mc")).alias("label_binary"), F.round("mc", 6).alias("label_soft"), F.round(D.mixed(F.col("mc")), 6).alias("label"))


def _audit(t, i):
    splits = RS.make_splits(i).filter("prm_split IS NOT NULL").select("instance_id").distinct().withColumn("placed", F.lit(True))
    state = t.join(splits, "instance_id", "left")
    done = F.col("status") == "done"
    return state.agg(F.count(F.lit(1)).alias("n_trees"), F.count_if(done).alias("n_done"), F.count_if(done & F.col("placed").isNotNull()).alias("n_usable"), F.count_if(done & F.col("placed").isNull()).alias("n_without_split"), F.count_if(done & F.col("messages_head_json").isNull()).alias("n_without_head"))


def _clean(b):
    return b.withColumn("split", F.lower(F.trim("split"))).withColumn("label_source", F.lower(F.trim("label_source")))


QUERIES = {
    "step_rows": _q(lambda b: S.step_rows(b, "row_id")),
    "step_sizes": _q(_step_sizes),
    "prefix_messages_k2": _q(lambda b: b.select("row_id", F.size(S.prefix_messages("messages", 2)).cast("bigint").alias("n"), F.size(S.prefix_messages("messages", 0)).cast("bigint").alias("n_head"))),
    "extract_exit": _q(lambda b: b.select("row_id", S.extract_exit("messages").alias("submission"))),
    "head_user": _q(lambda b: b.select("row_id", F.md5(S.head_user("messages")).alias("digest"))),
    "prefix_keys": _q(_prefix_keys),
    "leaf_chain": _q(lambda b: S.leaf_chain(b, "row_id", "step_count")),
    "canonical_messages": _q(_canonical),
    "rendered_tokens": _q(_rendered),
    "steps_round_trip": _q(_round_trip),
    "prompt_assembly": _q(_prompt),
    "call_answers": _q(lambda b: S.first_observations(b, "row_id").filter("call_id IS NOT NULL").withColumn("observation", F.md5("observation"))),
    "prefix_steps": _q(lambda n: n.select("instance_id", "node_key", D.n_steps().cast("bigint").alias("n_steps")), "nodes"),
    "node_labels": _q(_labels, "rollouts"),
    "node_eligibility_audit": _q(_eligibility, "nodes", "rollouts"),
    "build_audit": _q(_audit, "tree_instances", "instances"),
    "node_samples": _q(_node_samples, "nodes", "rollouts", "instances", "tree_instances"),
    "sample_dedupe": _q(lambda b: _deduped(b).select("row_id", "instance_id", "step_index", "node_key", "label_source")),
    "dedupe_stats": _q(lambda b: D.dedupe_stats(_keyed(b).filter("label_source IS NOT NULL"), _deduped(b).filter("label_source IS NOT NULL"))),
    "label_distribution": _q(lambda b: D.label_distribution(_clean(b), "split", "label", F.col("label_binary") == 1)),
    "class_weights": _q(lambda b: D.class_weights(_clean(b).filter("split = 'train'"), "label_binary")),
    "length_stats": _q(lambda b: D.length_stats(_clean(b), "rendered_tokens", "split")),
    "sample_order": _q(lambda b: D.ordered(_clean(b).select("row_id", "split", "instance_id", "step_index", "node_key", "label_source"), "split")),
    "sample_ids": _q(lambda b: b.select("row_id", D.sample_id().alias("made_id"))),
    "manifest": _q(lambda b: D.manifest(_clean(b), "split")),
}

_M = "SELECT row_id, unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS pos FROM build_dataset"
_STEPS = f"""
    m0 AS ({_M}), kept AS (SELECT row_id, m, pos FROM m0 WHERE m.role IN ('assistant', 'tool', 'user') AND pos < coalesce((SELECT min(x.pos) FROM m0 x WHERE x.row_id = m0.row_id AND x.m.role = 'exit'), 1000000)),
    st AS (SELECT *, sum((m.role = 'assistant')::INT) OVER (PARTITION BY row_id ORDER BY pos)::INT AS step_index FROM kept)"""
_CALLS = "array_to_string(list_transform(m.tool_calls, lambda c: concat_ws(': ', c.\"function\".name, c.\"function\".arguments)), chr(10))"
_ONE = f"concat_ws(chr(10), m.role || ': ' || coalesce(m.content, ''), nullif(m.reasoning_content, ''), CASE WHEN len(m.tool_calls) > 0 THEN {_CALLS} END)"
_KEYED = f"""k AS (SELECT row_id, md5(string_agg({_ONE}, chr(10) ORDER BY pos)) AS prefix FROM ({_M}) GROUP BY 1),
    d AS (SELECT b.row_id, b.instance_id, b.step_index, b.node_key, lower(trim(b.label_source)) AS label_source, k.prefix,
          row_number() OVER (PARTITION BY b.instance_id, k.prefix, b.step_index ORDER BY CASE lower(trim(b.label_source)) WHEN 'node_mc' THEN -2 WHEN 'leaf_chain' THEN -1 ELSE 0 END,
                             b.node_key NULLS FIRST, b.row_id) AS rn FROM build_dataset b JOIN k USING (row_id))"""
_MC = "mc AS (SELECT instance_id, node_key, avg(CAST(correct AS DOUBLE)) AS mc, count(*) AS n FROM rollouts GROUP BY ALL)"
_NS = "CASE WHEN json_valid(prefix_json) AND json_type(CASE WHEN json_valid(prefix_json) THEN prefix_json END) = 'ARRAY' THEN json_array_length(CASE WHEN json_valid(prefix_json) THEN prefix_json END)::BIGINT END"
_CLEAN = "c AS (SELECT * REPLACE (lower(trim(split)) AS split, lower(trim(label_source)) AS label_source) FROM build_dataset)"


def _oracles():
    from stepwright.plans.issues import _SPLITS

    reason = "CASE WHEN n IS NULL OR n = 0 THEN 'no_rollouts' WHEN n < 3 THEN 'min_rollouts' WHEN coalesce(steps, 0) = 0 THEN 'empty_prefix' WHEN mc_score IS NOT NULL AND abs(mc_score - mc) > 1e-6 THEN 'mc_mismatch' END"
    limits = ", ".join(f"round(avg((rendered_tokens <= {m})::INT), 6) AS within_{m}" for m in (4096, 8192, 16384))
    quantiles = ", ".join(f"floor(quantile_cont(rendered_tokens, {q}))::BIGINT AS p{round(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99))
    return {
        "step_rows": f"WITH {_STEPS} SELECT row_id, pos::INT AS pos, step_index, m.role AS role FROM st WHERE step_index > 0",
        "step_sizes": f"WITH {_STEPS} SELECT row_id, step_index, count(*) - 1 AS n_tail FROM st WHERE step_index > 0 GROUP BY ALL",
        "prefix_messages_k2": f"""WITH a AS (SELECT row_id, list(pos ORDER BY pos) FILTER (m.role = 'assistant') AS p, count(*) AS n FROM ({_M}) GROUP BY 1)
            SELECT row_id, CASE WHEN len(p) >= 3 THEN p[3] ELSE n END AS n, p[1] AS n_head FROM a""",
        "extract_exit": f"SELECT row_id, coalesce(max_by(m.content, pos) FILTER (m.role = 'exit'), '') AS submission FROM ({_M}) GROUP BY 1",
        "head_user": f"SELECT row_id, md5(max_by(m.content, pos) FILTER (m.role = 'user')) AS digest FROM ({_M}) GROUP BY 1",
        "prefix_keys": f"""WITH {_STEPS}, t AS (SELECT row_id, step_index, string_agg(coalesce(m.role, '') || chr(31) || coalesce(m.content, '') || chr(31) || coalesce(m.tool_call_id, ''), chr(30) ORDER BY pos) AS s
                FROM st WHERE step_index > 0 GROUP BY ALL)
            SELECT row_id, step_index AS k, 'n_' || left(sha1(string_agg(s, '') OVER (PARTITION BY row_id ORDER BY step_index)), 16) AS node_key FROM t
            UNION ALL SELECT row_id, 0, 'root' FROM build_dataset""",
        "leaf_chain": """SELECT row_id, step_index, CASE WHEN step_index = step_count THEN 0.0 ELSE 1.0 END::DOUBLE AS label FROM
            (SELECT row_id, step_count, unnest(range(1, step_count + 1))::INT AS step_index FROM build_dataset)""",
        "canonical_messages": f"""SELECT row_id, count(*) AS n, md5(string_agg(concat_ws('|', m.role, coalesce(m.content, ''), coalesce(CASE WHEN m.role = 'assistant' THEN m.reasoning_content END, '-'),
            coalesce(CASE WHEN m.role = 'assistant' AND len(list_filter(m.tool_calls, lambda c: coalesce(c."function".name, '') <> '')) > 0
                THEN len(list_filter(m.tool_calls, lambda c: coalesce(c."function".name, '') <> ''))::VARCHAR END, '-'), coalesce(CASE WHEN m.role = 'tool' THEN m.tool_call_id END, '-')), chr(10) ORDER BY pos)) AS digest
            FROM ({_M}) WHERE m.role IN ('assistant', 'tool', 'user') GROUP BY 1""",
        "rendered_tokens": f"""WITH t AS (SELECT row_id, string_agg({_ONE}, chr(10) ORDER BY pos) AS x FROM ({_M}) WHERE m.role IN ('assistant', 'tool', 'user') GROUP BY 1)
            SELECT row_id, length(x) AS n_chars, greatest(1, round_even(length(x) / 3.5, 0))::BIGINT AS tokens FROM t""",
        "steps_round_trip": f"WITH {_STEPS} SELECT row_id, count(*) AS n_flat, md5(string_agg(coalesce(m.content, ''), chr(10) ORDER BY pos)) AS digest FROM st WHERE step_index > 0 GROUP BY 1",
        "prompt_assembly": f"""WITH u AS (SELECT row_id, min_by(m.content, pos) FILTER (m.role = 'user') AS c FROM ({_M}) GROUP BY 1),
            t AS (SELECT row_id, count(*) AS n, string_agg(m.role || ':' || coalesce(m.content, ''), chr(10) ORDER BY pos) AS x FROM ({_M}) WHERE m.role IN ('assistant', 'tool', 'user') GROUP BY 1)
            SELECT row_id, n + 3 AS n, md5('system:Judge the last step.' || chr(10) || 'user:' || c || chr(10) || x || chr(10) || 'user:Was it right?') AS digest FROM t JOIN u USING (row_id)""",
        "call_answers": f"""WITH {_STEPS}, c AS (SELECT row_id, step_index, unnest(m.tool_calls).id AS call_id FROM st WHERE m.role = 'assistant'),
            a AS (SELECT row_id, step_index, m.tool_call_id AS call_id, md5(first(m.content ORDER BY pos)) AS observation FROM st WHERE m.role = 'tool' GROUP BY ALL)
            SELECT c.row_id, c.step_index, c.call_id, a.call_id IS NOT NULL AS answered, observation FROM c LEFT JOIN a USING (row_id, step_index, call_id) WHERE c.call_id IS NOT NULL""",
        "prefix_steps": f"SELECT instance_id, node_key, {_NS} AS n_steps FROM nodes",
        "node_labels": f"WITH {_MC} SELECT instance_id, node_key, (mc > 0.5)::INT AS label_binary, round(mc, 6) AS label_soft, round((mc > 0.5)::INT * 0.8 + mc * 0.2, 6) AS label FROM mc WHERE mc IS NOT NULL",
        "node_eligibility_audit": f"WITH {_MC} SELECT skip_reason, count(*) AS n FROM (SELECT {reason} AS skip_reason FROM (SELECT *, {_NS} AS steps FROM nodes) LEFT JOIN mc USING (instance_id, node_key)) GROUP BY 1",
        "build_audit": f"""WITH {_SPLITS}, x AS (SELECT t.*, p.instance_id IS NOT NULL AS placed FROM tree_instances t LEFT JOIN (SELECT DISTINCT instance_id FROM sp WHERE prm_split IS NOT NULL) p USING (instance_id))
            SELECT count(*) AS n_trees, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'done' AND placed) AS n_usable, count(*) FILTER (status = 'done' AND NOT placed) AS n_without_split,
                   count(*) FILTER (status = 'done' AND messages_head_json IS NULL) AS n_without_head FROM x""",
        "node_samples": f"""WITH {_SPLITS}, {_MC}, l AS (SELECT *, row_number() OVER (PARTITION BY instance_id, node_key ORDER BY created_at DESC NULLS LAST, visits DESC NULLS LAST, in_pool DESC NULLS LAST,
                mc_score DESC NULLS LAST, steps DESC NULLS LAST) AS rn FROM (SELECT *, {_NS} AS steps FROM nodes)),
            g AS (SELECT * FROM (SELECT l.*, mc.mc, mc.n, {reason} AS skip_reason FROM l LEFT JOIN mc USING (instance_id, node_key) WHERE rn = 1)
                WHERE skip_reason IS NULL AND instance_id IN (SELECT instance_id FROM tree_instances WHERE status = 'done' AND messages_head_json IS NOT NULL)),
            p AS (SELECT instance_id, any_value(repo) AS repo, any_value(prm_split) AS prm_split FROM sp WHERE prm_split IS NOT NULL GROUP BY 1)
            SELECT instance_id, repo, prm_split, node_key, step_index::INT AS step_index, steps, CASE WHEN step_index = steps THEN 0.0 ELSE 1.0 END::DOUBLE AS label, 'leaf_chain' AS label_source, round(mc, 6) AS mc, n
            FROM (SELECT *, unnest(range(1, steps + 1)) AS step_index FROM g WHERE node_key <> 'root' AND mc = 0) JOIN p USING (instance_id)
            UNION ALL SELECT instance_id, repo, prm_split, node_key, steps::INT, steps, round((mc > 0.5)::INT * 0.8 + mc * 0.2, 6), 'node_mc', round(mc, 6), n FROM g JOIN p USING (instance_id) WHERE NOT (node_key <> 'root' AND mc = 0)""",
        "sample_dedupe": f"WITH {_KEYED} SELECT row_id, instance_id, step_index, node_key, label_source FROM d WHERE rn = 1",
        "dedupe_stats": f"""WITH {_KEYED} SELECT label_source, count(*) AS before, count(*) FILTER (rn = 1) AS "after", count(*) FILTER (rn > 1) AS collisions FROM d WHERE label_source IS NOT NULL GROUP BY 1""",
        "label_distribution": f"""WITH {_CLEAN} SELECT s.split, count(c.row_id) AS n, count(*) FILTER (label_source = 'node_mc') AS n_node_mc, count(*) FILTER (label_source = 'leaf_chain') AS n_leaf_chain, round(coalesce(avg((label_binary = 1)::INT), 0), 6) AS pos_rate, round(coalesce(avg(label::DOUBLE), 0), 6) AS mean_label
            FROM (VALUES ('train'), ('dev'), ('test')) s(split) LEFT JOIN c ON c.split = s.split GROUP BY 1""",
        "class_weights": f"""WITH {_CLEAN} SELECT 1.0::DOUBLE AS w_pos, CASE WHEN count(label_binary) = 0 OR count(*) FILTER (label_binary = 0) = 0 THEN 1.0
            ELSE round(least(4.0, count(*) FILTER (label_binary = 1) / greatest(1, count(*) FILTER (label_binary = 0))), 6) END::DOUBLE AS w_neg FROM c WHERE split = 'train'""",
        "length_stats": f"""WITH {_CLEAN} SELECT split, count(*) AS n, min(rendered_tokens)::BIGINT AS min, max(rendered_tokens)::BIGINT AS max, round(avg(rendered_tokens), 6) AS mean, {quantiles}, {limits}
            FROM c WHERE rendered_tokens IS NOT NULL GROUP BY 1""",
        "sample_order": f"WITH {_CLEAN} SELECT row_id, split, instance_id, step_index, node_key, label_source FROM c",
        "sample_ids": "SELECT row_id, concat_ws('::', instance_id, node_key, step_index) AS made_id FROM build_dataset",
        "manifest": f"""WITH {_CLEAN} SELECT 'split' AS section, split AS key, count(*)::DOUBLE AS value FROM c GROUP BY 2 UNION ALL SELECT 'source', label_source, count(*)::DOUBLE FROM c GROUP BY 2
            UNION ALL SELECT 'distinct', 'instances', count(DISTINCT instance_id)::DOUBLE FROM c""",
    }


ORACLES = _oracles()
