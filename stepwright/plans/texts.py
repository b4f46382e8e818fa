"""Truncation, command policy and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright.functions import shell as H
from stepwright.operators import steps as S
from stepwright.operators import truncate as T
from stepwright.session import table

LIMIT, MARK_TOKENS = 600, 8


def _q(function, *tables):
    return lambda spark, sf: function(*[table(spark, sf, t) for t in tables or ("build_dataset",)])


def _sizes(b):
    """Tokens of each step by characters; the head is what stands before the first assistant message."""
    head = F.filter("messages", lambda m: m["role"].isin("system"))
    first = F.filter("messages", lambda m: m["role"] == "user")
    n_head = F.coalesce(F.length(F.get(head, F.lit(0))["content"]), F.lit(0)) + F.coalesce(F.length(F.get(first, F.lit(0))["content"]), F.lit(0))
    said = lambda m: F.coalesce(F.length(m["content"]), F.lit(0))
    steps = b.select("row_id", (n_head / 4).cast("int").alias("head_tokens"), F.posexplode(S.split_steps("messages")).alias("at", "s"))
    whole = said(F.col("s.assistant")) + F.aggregate("s.tail", F.lit(0), lambda n, m: n + said(m))
    clipped = said(F.col("s.assistant")) + F.aggregate("s.tail", F.lit(0), lambda n, m: n + F.when(m["role"] == "tool", F.least(said(m), F.lit(80))).otherwise(said(m)))
    return steps.select("row_id", (F.col("at") + 1).alias("step"), (whole / 4).cast("int").alias("tokens"), (clipped / 4).cast("int").alias("clipped_tokens"), "head_tokens")


def _plan(b):
    out = T.plan(_sizes(b), "row_id", LIMIT, MARK_TOKENS)
    return out.select("row_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_steps", "total", "floor", "n_drop")], "outcome")


def _tools(b):
    """The contents of all tool messages."""
    return b.select("row_id", F.posexplode("messages").alias("pos", "m")).filter("m.role = 'tool'").select("row_id", "pos", F.col("m.content").alias("content")).filter("content IS NOT NULL")


def _commands(b):
    calls = b.select("row_id", F.explode("messages").alias("m")).select("row_id", F.explode("m.tool_calls").alias("c"))
    return calls.select("row_id", F.col("c.id").alias("call_id"), F.get_json_object("c.function.arguments", "$.command").alias("command")).filter("command IS NOT NULL")


def _policy(b):
    return _commands(b).select("row_id", "call_id", H.refusal("command").alias("reason"), H.refusal("command", strict=True, scratch_writes=False).alias("strict_reason"))


def _clip(b):
    return _tools(b).select("row_id", "pos", F.length(T.head_tail("content", 60)).cast("bigint").alias("n"), F.md5(T.head_tail("content", 60)).alias("digest"))


QUERIES = {
    "trunc_plan": _q(_plan),
    "trunc_outcomes": _q(lambda b: _plan(b).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("n_drop").alias("n_drop"))),
    "oversize_candidates": _q(lambda b: T.oversize_candidates(b, "rendered_tokens", 1000).select("row_id", "rendered_tokens")),
    "tool_clip": _q(lambda b: _tools(b).select("row_id", "pos", T.tool_clip("content", 40).alias("clipped"))),
    "head_tail_clip": _q(_clip),
    "command_forbidden": _q(lambda b: _commands(b).select("row_id", "call_id", H.forbidden_pattern("command").alias("forbidden"))),
    "command_policy": _q(_policy),
    "safe_names": _q(lambda i: i.select("repo").distinct().select("repo", H.safe_name("repo").alias("name")), "instances"),
    "shell_quote": _q(lambda b: _commands(b).select("row_id", "call_id", H.quote("command").alias("quoted"))),
    "switches": _q(lambda i: i.select("instance_id", "source", H.as_bool("source", True).alias("flag"), H.as_int("commit8", -1).alias("number")), "instances"),
    "verdict_pairs": _q(lambda i: i.select("repo").distinct().select("repo", F.array_join(H.verdict_pair("repo"), "+").alias("pair")), "instances"),
}

_FORBIDDEN_SQL = "|".join(H.FORBIDDEN).replace("'", "''")


def _policy_sql(commands):
    """The rules of the policy over (row_id, call_id, command)."""
    names = lambda words: ", ".join(f"'{w}'" for w in words)
    path = r"regexp_replace(o, '^(\$TMPDIR|\$\{TMPDIR\})(/.*)?$', '/tmp\2')"
    steps = f"list_prepend([]::VARCHAR[], list_transform(list_filter(string_split({path}, '/'), lambda n: n NOT IN ('', '.')), lambda n: [n]))"
    folded = f"list_reduce({steps}, lambda done, n: CASE WHEN n[1] = '..' THEN done[1:len(done) - 1] ELSE list_concat(done, n) END)"
    off = f"lambda o: NOT ({path} LIKE '/%' AND coalesce({folded}[1] = 'tmp' OR {folded}[1:2] = ['dev', 'null'], false))"
    part = r"'(?s)^[\s(]*(?:(?:[A-Za-z_]\w*=\S*|time|command|nohup|sudo)\s+)*(\S+)\s*(.*)$'"
    setting = r"'^[A-Za-z_]\w*='"
    return rf"""{commands}, b AS (SELECT row_id, call_id, regexp_replace(command, '^\s+|\s+$', '', 'g') AS t FROM c WHERE command IS NOT NULL),
        s AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '[;&|\n]'), lambda p: {{'program': regexp_extract(p, {part}, 1), 'arguments': regexp_extract(p, {part}, 2)}}),
                lambda x: x.program <> '' AND NOT regexp_matches(x.program, {setting})) AS parts,
            list_transform(regexp_extract_all(t, '(?:^|[^12&])>+\s*(\S+)', 1), lambda x: trim(x, '''"')) AS sent FROM b),
        w AS (SELECT *, list_transform(parts, lambda x: regexp_extract(x.program, '[^/]*$')) AS names,
            flatten(list_transform(list_filter(parts, lambda x: regexp_extract(x.program, '[^/]*$') IN ({names(H.WRITERS)})),
                lambda x: list_filter(regexp_split_to_array(x.arguments, '\s+'), lambda o: o <> '' AND o NOT LIKE '-%' AND NOT regexp_matches(o, {setting})))) AS written FROM s),
        v AS (SELECT *, regexp_matches(t, '(?i){_FORBIDDEN_SQL}') AS never FROM w)
        SELECT row_id, call_id,
            CASE WHEN t = '' THEN 'empty' WHEN never THEN 'forbidden' WHEN len(list_filter(written, {off})) > 0 THEN 'write' WHEN len(list_filter(sent, {off})) > 0 THEN 'redirect' END AS reason,
            CASE WHEN t = '' THEN 'empty' WHEN never THEN 'forbidden' WHEN len(written) > 0 THEN 'write' WHEN len(sent) > 0 THEN 'redirect'
                 WHEN len(list_filter(names, lambda n: n NOT IN ({names(H.READERS)}))) > 0 THEN 'unlisted' END AS strict_reason FROM v"""


def _oracles():
    from stepwright.plans.trajectories import _M, _STEPS

    commands = f"""c0 AS (SELECT row_id, unnest(m.tool_calls) AS c FROM ({_M})),
        c AS (SELECT row_id, c.id AS call_id, json_extract_string(CASE WHEN json_valid(c."function".arguments) THEN c."function".arguments END, '$.command') AS command FROM c0)"""
    plan = f"""{_STEPS}, z AS (SELECT row_id, step_index AS step, sum(coalesce(length(m.content), 0)) // 4 AS tokens,
            sum(CASE WHEN m.role = 'tool' THEN least(coalesce(length(m.content), 0), 80) ELSE coalesce(length(m.content), 0) END) // 4 AS clipped FROM st WHERE step_index > 0 GROUP BY ALL),
        hd AS (SELECT row_id, (coalesce(length(min_by(m.content, pos) FILTER (m.role = 'system')), 0) + coalesce(length(min_by(m.content, pos) FILTER (m.role = 'user')), 0)) // 4 AS head FROM ({_M}) GROUP BY 1),
        y AS (SELECT z.*, head, sum(tokens) OVER w AS rest FROM z JOIN hd USING (row_id) WINDOW w AS (PARTITION BY z.row_id ORDER BY step DESC)),
        x AS (SELECT row_id, max(step) AS n_steps, max(head) AS head, max(rest) AS trajectory, min(step - 1) FILTER (rest + head + CASE WHEN step > 1 THEN {MARK_TOKENS} ELSE 0 END <= {LIMIT}) AS least, max_by(clipped, step) AS last_clip FROM y GROUP BY 1),
        p AS (SELECT row_id, n_steps::BIGINT AS n_steps, (trajectory + head)::BIGINT AS total, (head + {MARK_TOKENS})::BIGINT AS floor,
            (CASE WHEN trajectory + head <= {LIMIT} THEN 0 ELSE coalesce(least, n_steps - 1) END)::BIGINT AS n_drop,
            CASE WHEN trajectory + head <= {LIMIT} THEN 'fits' WHEN head + {MARK_TOKENS} > {LIMIT} THEN 'unfittable' WHEN least IS NOT NULL THEN 'steps_dropped'
                 WHEN head + CASE WHEN n_steps > 1 THEN {MARK_TOKENS} ELSE 0 END + last_clip <= {LIMIT} THEN 'tools_clipped' ELSE 'unfittable' END AS outcome FROM x)"""
    tool = f"f AS (SELECT row_id, pos::INT AS pos, m.content AS content FROM ({_M}) WHERE m.role = 'tool')"
    safe = "left(regexp_replace(regexp_replace(replace(repo, '/', '__'), '[^A-Za-z0-9_.-]', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 60)"
    return {
        "trunc_plan": f"WITH {plan} SELECT * FROM p",
        "trunc_outcomes": f"WITH {plan} SELECT outcome, count(*) AS n, sum(n_drop)::BIGINT AS n_drop FROM p GROUP BY 1",
        "oversize_candidates": "SELECT row_id, rendered_tokens FROM build_dataset WHERE rendered_tokens IS NULL OR rendered_tokens = 0 OR rendered_tokens > 1000",
        "tool_clip": f"""WITH {tool} SELECT row_id, pos, CASE WHEN json_valid(content) AND json_type(CASE WHEN json_valid(content) THEN content END) = 'OBJECT'
            THEN '{{"returncode": ' || coalesce(json_extract_string(CASE WHEN json_valid(content) THEN content END, '$.returncode'), 'null') || ', "output": '
                || to_json(left(coalesce(json_extract_string(CASE WHEN json_valid(content) THEN content END, '$.output'), ''), 40) || '{T.MARK}')::VARCHAR || '}}'
            ELSE left(content, 40) || '{T.MARK}' END AS clipped FROM f WHERE content IS NOT NULL""",
        "head_tail_clip": f"""WITH {tool}, h AS (SELECT row_id, pos, CASE WHEN length(content) <= 60 THEN content ELSE left(content, 30) || chr(10) || '... [' || (length(content) - 60) || ' characters left out] ...' || chr(10) || right(content, 30) END AS t
            FROM f WHERE content IS NOT NULL) SELECT row_id, pos, length(t) AS n, md5(t) AS digest FROM h""",
        "command_forbidden": f"WITH {commands} SELECT row_id, call_id, regexp_matches(command, '(?i){_FORBIDDEN_SQL}') AS forbidden FROM c WHERE command IS NOT NULL",
        "command_policy": "WITH " + _policy_sql(commands),
        "safe_names": f"SELECT repo, coalesce(nullif({safe}, ''), 'repo') AS name FROM (SELECT DISTINCT repo FROM instances)",
        "shell_quote": f"""WITH {commands} SELECT row_id, call_id, '''' || replace(command, '''', '''"''"''') || '''' AS quoted FROM c WHERE command IS NOT NULL""",
        "switches": "SELECT instance_id, source, CASE WHEN coalesce(trim(source), '') = '' THEN true ELSE lower(trim(source)) IN ('1', 'true', 'yes', 'on') END AS flag, CASE WHEN regexp_matches(commit8, '^[0-9]+$') THEN coalesce(try_cast(commit8 AS INT), -1) ELSE -1 END AS number FROM instances",
        "verdict_pairs": """SELECT repo, CASE WHEN len(p) = 2 AND len(list_filter(p, lambda x: x = '')) = 0 THEN array_to_string(p, '+') END AS pair FROM
            (SELECT repo, list_transform(regexp_split_to_array(repo, '[,/]'), lambda x: trim(x)) AS p FROM (SELECT DISTINCT repo FROM instances))""",
    }


ORACLES = _oracles()
