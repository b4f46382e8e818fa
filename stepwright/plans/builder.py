"""The dataset builder: samples with messages, what fits the window, the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright.operators import builder as B
from stepwright.operators import mc as M
from stepwright.operators import repo_splits as RS
from stepwright.operators import samples as D
from stepwright.operators import steps as S
from stepwright.plans.texts import _q
from stepwright.plans.trajectories import _M, _MC, _NS
from stepwright.session import written

#: Characters of the window, and of a tool's content that is clipped.
LIMIT, KEEP = 2_000, 80


def _text(messages):
    """One line a message: role, content, the id it answers, and the size of its calls' arguments."""
    return F.array_join(F.transform(messages, lambda m: F.concat_ws("|", m["role"], F.coalesce(m["content"], F.lit("")), F.coalesce(m["tool_call_id"], F.lit("-")), F.coalesce(F.array_join(F.transform(m["tool_calls"], lambda c: c["function"]["name"]), "+"), F.lit("-")))), "\n")


def _samples(n, r, i, t):
    return B.build_samples(n, r, RS.make_splits(i), t)


def _built(n, r, i, t):
    out = _samples(n, r, i, t)
    return out.select("sample_id", "instance_id", "prm_split", "step_index", "label_source", F.size("messages").cast("bigint").alias("n_messages"), F.md5(_text(F.col("messages"))).alias("digest"))


def _round_trip(n):
    steps = B.parsed_steps("prefix_json")
    read = n.select("instance_id", "node_key", steps.alias("s")).filter("s IS NOT NULL")
    again = read.select("instance_id", "node_key", "s", B.stored_steps(F.col("s")).alias("stored")).withColumn("t", B.parsed_steps("stored"))
    flat = S.flattened(F.transform("t", lambda s: F.struct(s["assistant"].alias("assistant"), F.coalesce(s["tail"], F.array().cast(f"array<{B.MESSAGE}>")).alias("tail"))))
    body = F.array_join(F.transform(flat, lambda m: F.concat_ws("|", F.coalesce(m["role"], F.lit("")), F.coalesce(m["content"], F.lit("")))), "\n")
    return again.select("instance_id", "node_key", F.size("t").cast("bigint").alias("n_steps"), F.size(flat).cast("bigint").alias("n_messages"), F.md5(body).alias("digest"), F.col("s").eqNullSafe(F.col("t")).alias("same"))


def _fitted(b):
    out = b.select("row_id", B.fitted(S.canonical("messages"), LIMIT, keep=KEEP).alias("f"))
    return out.select("row_id", "f.outcome", F.col("f.n_dropped").cast("bigint").alias("n_dropped"), F.size("f.messages").cast("bigint").alias("n_messages"), F.md5(F.array_join(F.transform("f.messages", lambda m: F.concat_ws("|", m["role"], m["content"])), "\n")).alias("digest"))


def _manifest(n, r, i, t):
    before = written(_samples(n, r, i, t).drop("messages"))
    after = before.filter("label_source = 'node_mc' OR step_index < steps")
    skipped = M.eligibility(n.select("instance_id", "node_key", "mc_score", "prefix_json"), M.mc_table(r), D.n_steps(), D.key_matches()).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))
    return B.full_manifest(before, after, skipped, "prm_split", B.fingerprint(nodes=(n, "created_at"), rollouts=(r, "created_at"))).filter("section NOT LIKE 'length%'")


QUERIES = {
    "build_samples": _q(_built, "nodes", "rollouts", "instances", "tree_instances"),
    "prefix_round_trip": _q(_round_trip, "nodes"),
    "truncated_messages": _q(_fitted, "build_dataset"),
    "full_manifest": _q(_manifest, "nodes", "rollouts", "instances", "tree_instances"),
}


def _oracles():
    from stepwright.operators.truncate import MARK
    from stepwright.plans.issues import _SPLITS
    from stepwright.plans.trajectories import ORACLES as T

    samples = T["node_samples"]
    plain = "CASE WHEN json_valid(prefix_json) THEN CASE WHEN json_type(CASE WHEN json_valid(prefix_json) THEN prefix_json END) = 'VARCHAR' THEN json_extract_string(CASE WHEN json_valid(prefix_json) THEN prefix_json END, '$') ELSE prefix_json END END"
    steps = """st AS (SELECT * EXCLUDE (j), unnest(json_extract(j, '$[*]')) AS s, generate_subscripts(json_extract(j, '$[*]'), 1) AS k FROM px),
        ms AS (SELECT instance_id, node_key, k, 0 AS pl, json_extract(s, '$.assistant') AS m FROM st UNION ALL
            SELECT instance_id, node_key, k, generate_subscripts(json_extract(s, '$.tail[*]'), 1) AS pl, unnest(json_extract(s, '$.tail[*]')) AS m FROM st WHERE json_type(s, '$.tail') = 'ARRAY')"""
    latest = f"""px AS (SELECT instance_id, node_key, prefix_json AS j FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, node_key ORDER BY created_at DESC NULLS LAST, visits DESC NULLS LAST, in_pool DESC NULLS LAST, mc_score DESC NULLS LAST,
        {_NS} DESC NULLS LAST) AS rn FROM nodes) WHERE rn = 1 AND json_valid(prefix_json) AND json_type(prefix_json) = 'ARRAY')"""
    names = """array_to_string(list_transform(list_filter(json_extract_string(m, '$.tool_calls[*].function.name'), lambda x: coalesce(x, '') <> ''), lambda x: x), '+')"""
    line = f"""concat_ws('|', json_extract_string(m, '$.role'), coalesce(json_extract_string(m, '$.content'), ''), coalesce(CASE WHEN json_extract_string(m, '$.role') = 'tool' THEN json_extract_string(m, '$.tool_call_id') END, '-'),
        CASE WHEN json_extract_string(m, '$.role') = 'assistant' AND {names} <> '' THEN {names} ELSE '-' END)"""
    one = "concat_ws(chr(10), m.role || ': ' || coalesce(m.content, ''), nullif(CASE WHEN m.role = 'assistant' THEN m.reasoning_content END, ''), CASE WHEN m.role = 'assistant' AND len(list_filter(m.tool_calls, lambda c: coalesce(c.\"function\".name, '') <> '')) > 0 THEN array_to_string(list_transform(list_filter(m.tool_calls, lambda c: coalesce(c.\"function\".name, '') <> ''), lambda c: concat_ws(': ', c.\"function\".name, c.\"function\".arguments)), chr(10)) END)"
    extra = len(MARK) + 7
    j = "CASE WHEN json_valid(m.content) THEN m.content END"
    clip = f"""CASE WHEN m.role = 'tool' AND length(m.content) > {KEEP} THEN CASE WHEN json_valid(m.content) AND json_type({j}) = 'OBJECT'
        THEN '{{"returncode": ' || coalesce(json_extract_string({j}, '$.returncode'), 'null') || ', "output": ' || to_json(left(coalesce(json_extract_string({j}, '$.output'), ''), {KEEP}) || '{MARK}')::VARCHAR || '}}'
        ELSE left(m.content, {KEEP}) || '{MARK}' END ELSE coalesce(m.content, '') END"""
    extra_keys = ("actions", "raw_output", "returncode", "exit_status", "submission", "exception_info")
    return {
        "build_samples": f"""WITH sa AS ({samples}), {latest}, {steps}, tx AS (SELECT instance_id, node_key, k, count(*) AS c, string_agg({line}, chr(10) ORDER BY pl) AS t FROM ms WHERE json_extract_string(m, '$.role') IN ('assistant', 'tool', 'user') GROUP BY ALL),
            hd AS (SELECT instance_id, max(h) AS h FROM (SELECT instance_id, list_last(list_transform(list_filter(json_extract(messages_head_json, '$[*]'), lambda x: json_extract_string(x, '$.role') = 'user'), lambda x: json_extract_string(x, '$.content'))) AS h FROM tree_instances WHERE json_valid(messages_head_json)) GROUP BY 1),
            jn AS (SELECT sa.instance_id, sa.node_key, sa.prm_split, sa.step_index, sa.label_source, any_value(h) AS h, coalesce(sum(c), 0) AS c, string_agg(t, chr(10) ORDER BY k) AS t FROM sa JOIN hd USING (instance_id)
                LEFT JOIN tx ON tx.instance_id = sa.instance_id AND tx.node_key = sa.node_key AND tx.k <= sa.step_index WHERE h IS NOT NULL GROUP BY ALL)
            SELECT concat_ws('::', instance_id, node_key, step_index) AS sample_id, instance_id, prm_split, step_index, label_source, (c + 1)::BIGINT AS n_messages, md5('user|' || h || '|-|-' || coalesce(chr(10) || t, '')) AS digest FROM jn""",
        "prefix_round_trip": f"""WITH px0 AS (SELECT instance_id, node_key, row_number() OVER () AS id, {plain} AS j FROM nodes), px AS (SELECT instance_id, node_key || chr(0) || id AS node_key, id, j FROM px0 WHERE json_valid(j) AND json_type(CASE WHEN json_valid(j) THEN j END) = 'ARRAY'), {steps},
            a AS (SELECT node_key, count(*) AS n, md5(string_agg(coalesce(json_extract_string(m, '$.role'), '') || '|' || coalesce(json_extract_string(m, '$.content'), ''), chr(10) ORDER BY k, pl)) AS digest FROM ms GROUP BY 1)
            SELECT px.instance_id, string_split(px.node_key, chr(0))[1] AS node_key, json_array_length(j)::BIGINT AS n_steps, coalesce(a.n, 0) AS n_messages, coalesce(digest, md5('')) AS digest, true AS same FROM px LEFT JOIN a USING (node_key)""",
        "light_trajectory": f"""WITH px0 AS (SELECT instance_id, node_key, row_number() OVER () AS id, {plain} AS j FROM nodes), px AS (SELECT instance_id, node_key || chr(0) || id AS node_key, j FROM px0 WHERE json_valid(j) AND json_type(CASE WHEN json_valid(j) THEN j END) = 'ARRAY'), {steps}
            SELECT instance_id, string_split(node_key, chr(0))[1] AS node_key, k::INT AS step_index, pl::INT AS message_index, json_extract_string(m, '$.role') AS role, json_extract_string(m, '$.content') AS content, json_extract_string(m, '$.tool_call_id') AS tool_call_id,
                {', '.join(f"json_extract_string(m, '$.extra.{c}') AS {c}" for c in extra_keys)} FROM ms WHERE m IS NOT NULL AND json_type(m) <> 'NULL'""",
        "truncated_messages": f"""WITH a AS (SELECT row_id, m, row_number() OVER (PARTITION BY row_id ORDER BY pos) AS pl FROM ({_M}) WHERE m.role IN ('assistant', 'tool', 'user')), b AS (SELECT *, length({one}) + 1 AS n FROM a),
            c AS (SELECT *, sum(n) OVER (PARTITION BY row_id) AS total, sum(n) OVER (PARTITION BY row_id ORDER BY pl DESC) AS rest, min(CASE WHEN m.role = 'assistant' THEN pl END) OVER (PARTITION BY row_id) AS f,
                max(CASE WHEN m.role = 'assistant' THEN pl END) OVER (PARTITION BY row_id) AS l FROM b),
            d AS (SELECT *, coalesce(sum(CASE WHEN pl < f THEN n END) OVER (PARTITION BY row_id), 0) AS head FROM c),
            e AS (SELECT *, min(CASE WHEN m.role = 'assistant' AND head + {extra} + rest <= {LIMIT} THEN pl END) OVER (PARTITION BY row_id) AS good FROM d),
            g AS (SELECT *, CASE WHEN total <= {LIMIT} OR f IS NULL THEN f ELSE coalesce(good, l) END AS keep FROM e),
            h AS (SELECT row_id, pl, m.role AS role, coalesce(m.content, '') AS content, {clip} AS clipped, {one.replace("coalesce(m.content, '')", clip)} AS ct, total, head, good, f, keep FROM g WHERE pl < coalesce(f, 1000000) OR pl >= keep
                UNION ALL SELECT row_id, f - 0.5, 'user', '{MARK}', '{MARK}', 'user: {MARK}', total, head, good, f, keep FROM g WHERE pl = 1 AND keep > f),
            x AS (SELECT row_id, any_value(total) AS total, any_value(head) AS head, any_value(good) AS good, any_value(coalesce(keep - f, 0)) AS n_dropped, count(*) AS n_messages, sum(length(ct) + 1) AS size, any_value(f) AS f,
                md5(string_agg(role || '|' || content, chr(10) ORDER BY pl)) AS whole, md5(string_agg(role || '|' || clipped, chr(10) ORDER BY pl)) AS short FROM h GROUP BY 1),
            o AS (SELECT *, CASE WHEN total <= {LIMIT} THEN 'fits' WHEN (CASE WHEN f IS NULL THEN total ELSE head END) + {extra} > {LIMIT} THEN 'unfittable' WHEN good IS NOT NULL THEN 'steps_dropped' WHEN size <= {LIMIT} THEN 'tools_clipped' ELSE 'unfittable' END AS outcome FROM x)
            SELECT row_id, outcome, n_dropped::BIGINT AS n_dropped, n_messages, CASE WHEN outcome IN ('fits', 'steps_dropped') THEN whole ELSE short END AS digest FROM o""",
        "full_manifest": f"""WITH sa AS ({samples}), af AS (SELECT * FROM sa WHERE label_source = 'node_mc' OR step_index < steps), sp3 AS (SELECT unnest(['train', 'dev', 'test']) AS s),
            lb AS (SELECT s, count(label) AS n, coalesce(avg((label > 0.5)::INT), 0) AS p, coalesce(avg(label), 0) AS m FROM sp3 LEFT JOIN af ON prm_split = s GROUP BY 1),
            dd AS (SELECT label_source, count(*) AS b, count(*) FILTER (label_source = 'node_mc' OR step_index < steps) AS a FROM sa GROUP BY 1),
            tr AS (SELECT count(*) FILTER (label > 0.5) AS p, count(*) FILTER (label <= 0.5) AS g, count(*) AS n FROM af WHERE prm_split = 'train')
            SELECT 'count' AS section, s AS key, n::DOUBLE AS value FROM lb UNION ALL SELECT 'pos_rate', s, round(p, 6) FROM lb UNION ALL SELECT 'mean_label', s, round(m, 6) FROM lb
            UNION ALL SELECT 'source', prm_split || '/' || label_source, count(*) FROM af GROUP BY 2
            UNION ALL SELECT 'dedupe_before', label_source, b FROM dd UNION ALL SELECT 'dedupe_after', label_source, a FROM dd UNION ALL SELECT 'dedupe_collisions', label_source, b - a FROM dd
            UNION ALL SELECT 'skipped', skip_reason, n FROM ({T['node_eligibility_audit']}) WHERE skip_reason IS NOT NULL
            UNION ALL SELECT 'weight', 'w_pos', 1.0 UNION ALL SELECT 'weight', 'w_neg', CASE WHEN n = 0 OR g = 0 THEN 1.0 ELSE round(least(4.0, p / greatest(1, g)), 6) END FROM tr
            UNION ALL SELECT 'input_n', 'nodes', count(*) FROM nodes UNION ALL SELECT 'input_n', 'rollouts', count(*) FROM rollouts
            UNION ALL SELECT 'input_newest', 'nodes', max(created_at) FROM nodes UNION ALL SELECT 'input_newest', 'rollouts', max(created_at) FROM rollouts""",
    }


ORACLES = _oracles()
