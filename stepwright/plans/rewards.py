"""Rewards of the rollouts' submissions against the instances' gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright.operators import reward as R
from stepwright.operators.rules import gold_struct
from stepwright.session import table

KEYS = ["instance_id", "node_key", "rollout_idx", "is_consumed"]


def submissions(rollouts):
    """Readable results with their submission; a result may be wrapped once."""
    told = lambda path: F.try_variant_get("v", path, "string")
    parsed = rollouts.select(*KEYS, "exit_status", F.try_parse_json("result_json").alias("v")).filter("v IS NOT NULL")
    return parsed.select(*KEYS, "exit_status", F.coalesce(told("$.submission"), told("$.result.submission")).alias("submission"))


def with_gold(rollouts, instances):
    gold = instances.groupBy("instance_id").agg(F.max("gold").alias("gold"))
    return submissions(rollouts).join(gold, "instance_id")


def _layered(r, i):
    out = R.exit_reward(with_gold(r, i), "exit_status", "submission", gold_struct("gold"), overpromise=0.05, duplicate=0.05)
    return out.select(*KEYS, "reason", F.col("n_pred").cast("bigint").alias("n_pred"), F.col("n_gold").cast("bigint").alias("n_gold"), F.col("exact_hits").cast("bigint").alias("exact_hits"),
                      F.round("penalty", 6).alias("penalty"), F.round("reward", 6).alias("reward"), "correct")


def _independent(r, i):
    df = with_gold(r, i).withColumn("p", R.locations("submission")).filter("p IS NOT NULL")
    names, gold = R.location_names(F.col("p")), gold_struct("gold")
    return df.select(*KEYS, F.round(R.set_f1(names["files"], gold["files"]), 6).alias("file_f1"), F.round(R.set_f1(names["modules"], gold["modules"]), 6).alias("module_f1"),
                     F.round(R.set_f1(names["entities"], gold["entities"]), 6).alias("entity_f1"), F.round(R.three_level(names, gold), 6).alias("reward"))


def _triples(i):
    t = i.select("instance_id", "source", F.posexplode(R.gold_triples(gold_struct("gold"))).alias("at", "t"))
    return t.select("instance_id", "source", "t.file", "t.class_name", "t.function_name", R.gold_depth(F.col("t")).alias("depth"))


def _names(i):
    out = R.diff_names(i.select("instance_id", "source", "patch").dropDuplicates(["instance_id", "source"]), ["instance_id", "source"], "patch")
    return out.select("instance_id", "source", *[F.array_join(c, "|").alias(c) for c in ("files", "modules", "entities")])


def _patch_f1(i):
    named = R.diff_names(i.select("instance_id", "source", "patch").dropDuplicates(["instance_id", "source"]), ["instance_id", "source"], "patch")
    gold = i.groupBy("instance_id", "source").agg(F.max("gold").alias("gold"))
    both = named.join(gold, ["instance_id", "source"])
    said = F.struct("files", "modules", "entities")
    blank = both.join(i.select("instance_id", "source", (F.coalesce(F.trim("patch"), F.lit("")) == "").alias("blank")).groupBy("instance_id", "source").agg(F.bool_and("blank").alias("blank")), ["instance_id", "source"])
    return blank.select("instance_id", "source", F.round(R.three_level(said, gold_struct("gold")), 6).alias("reward"), F.when(F.col("blank"), "empty_patch").alias("reason"))


def _unified(r, i):
    """Both ways of scoring beside each other."""
    scored = with_gold(r, i)
    one = lambda mode: R.unified_reward(scored, "exit_status", "submission", gold_struct("gold"), mode).select(*KEYS, F.lit(mode).alias("mode"), "reason", F.round("reward", 6).alias("reward"), "correct")
    return one("layered").filter("reason IS NULL OR reason IN ('not_submitted', 'invalid_submission')").unionByName(one("independent"))


def _q(function, *tables):
    return lambda spark, sf: function(*[table(spark, sf, t) for t in tables])


QUERIES = {
    "locations_valid": _q(lambda r: submissions(r).select(*KEYS, F.size(R.locations("submission")).cast("bigint").alias("n"), R.submission_reason("submission").alias("refused")), "rollouts"),
    "layered_reward": _q(_layered, "rollouts", "instances"),
    "independent_reward": _q(_independent, "rollouts", "instances"),
    "unified_reward": _q(_unified, "rollouts", "instances"),
    "gold_triples": _q(_triples, "instances"),
    "diff_locations": _q(_names, "instances"),
    "patch_reward": _q(_patch_f1, "instances"),
    "diff_like": _q(lambda i: i.select("instance_id", "source", R.is_diff_like("patch").alias("diff_like")), "instances"),
}

_SUB = """s0 AS (SELECT instance_id, node_key, rollout_idx, is_consumed, exit_status, CASE WHEN json_valid(result_json) THEN result_json END AS j FROM rollouts),
    s AS (SELECT * EXCLUDE (j), coalesce(json_extract_string(j, '$.submission'), json_extract_string(j, '$.result.submission')) AS submission FROM s0 WHERE j IS NOT NULL),
    p0 AS (SELECT *, CASE WHEN json_valid(submission) THEN submission END AS sj FROM s),
    p1 AS (SELECT *, CASE WHEN json_type(sj) = 'ARRAY' THEN json_extract(sj, '$[*]') END AS items FROM p0),
    p AS (SELECT *, CASE WHEN len(list_filter(items, lambda e: NOT coalesce(json_type(e) = 'OBJECT' AND json_type(e, '$.file') = 'VARCHAR' AND trim(json_extract_string(e, '$.file')) <> ''
            AND coalesce(json_type(e, '$.class_name'), 'NULL') IN ('NULL', 'VARCHAR') AND coalesce(json_type(e, '$.function_name'), 'NULL') IN ('NULL', 'VARCHAR'), false))) = 0
        THEN list_transform(items, lambda e: {'f': trim(json_extract_string(e, '$.file')), 'c': nullif(json_extract_string(e, '$.class_name'), ''), 'm': nullif(json_extract_string(e, '$.function_name'), '')}) END AS preds FROM p1)"""
_GOLD = """g0 AS (SELECT instance_id, source, gold, coalesce(json_extract_string(gold, '$.files[*]'), []) AS fs, coalesce(json_extract_string(gold, '$.modules[*]'), []) AS ms, list_sort(list_distinct(coalesce(json_extract_string(gold, '$.entities[*]'), []))) AS es FROM instances),
    g1 AS (SELECT *, list_transform(es, lambda e: {'f': regexp_extract(e, '^(.*):([^:]*)$', 1), 'n': regexp_extract(e, '^(.*):([^:]*)$', 2)}) AS en FROM g0),
    g2 AS (SELECT *, list_transform(en, lambda e: {'f': e.f, 'c': CASE WHEN regexp_matches(e.n, '^[^.]+\\..+$') THEN regexp_extract(e.n, '^([^.]*)\\.(.*)$', 1) END,
        'm': CASE WHEN regexp_matches(e.n, '^[^.]+\\..+$') THEN regexp_extract(e.n, '^([^.]*)\\.(.*)$', 2) ELSE e.n END}) AS et FROM g1),
    g3 AS (SELECT *, list_concat(et, list_transform(list_filter(list_sort(list_distinct(ms)), lambda m: len(list_filter(et, lambda x: x.f = regexp_extract(m, '^(.*):([^:]*)$', 1)
        AND (coalesce(x.c, '') = regexp_extract(m, '^(.*):([^:]*)$', 2) OR coalesce(x.m, '') = regexp_extract(m, '^(.*):([^:]*)$', 2)))) = 0),
        lambda m: {'f': regexp_extract(m, '^(.*):([^:]*)$', 1), 'c': regexp_extract(m, '^(.*):([^:]*)$', 2), 'm': NULL::VARCHAR})) AS bt FROM g2),
    g AS (SELECT *, list_concat(bt, list_transform(list_filter(list_sort(list_distinct(fs)), lambda f: len(list_filter(bt, lambda x: x.f = f)) = 0), lambda f: {'f': f, 'c': NULL::VARCHAR, 'm': NULL::VARCHAR})) AS golds FROM g3),
    gi AS (SELECT instance_id, max_by(golds, gold) AS golds, max(gold) AS gold FROM g GROUP BY 1)"""
_DEPTH = """CASE WHEN a.f <> b.f THEN 0 WHEN b.c IS NOT NULL THEN CASE WHEN a.c IS DISTINCT FROM b.c THEN 1 WHEN b.m IS NOT NULL AND a.m IS NOT DISTINCT FROM b.m THEN 3 ELSE 2 END
    WHEN b.m IS NOT NULL THEN CASE WHEN a.m IS NOT DISTINCT FROM b.m THEN 3 ELSE 1 END ELSE 1 END"""
_DIFF = r"""l0 AS (SELECT DISTINCT ON (instance_id, source) instance_id, source, coalesce(patch, '') AS patch FROM instances),
    l1 AS (SELECT instance_id, source, unnest(regexp_split_to_array(patch, '\r\n|\r|\n')) AS line, generate_subscripts(regexp_split_to_array(patch, '\r\n|\r|\n'), 1) AS pos FROM l0),
    l2 AS (SELECT *, regexp_extract(line, '^(\+\+\+|---)\s+(?:[ab]/)?(/dev/null|.+)$', 1) AS mark, trim(regexp_extract(line, '^(\+\+\+|---)\s+(?:[ab]/)?(/dev/null|.+)$', 2)) AS p FROM l1),
    l3 AS (SELECT *, CASE WHEN mark <> '' AND p <> '/dev/null' AND p <> '' THEN p END AS path, CASE WHEN mark = '+++' AND p <> '/dev/null' AND p <> '' THEN p END AS start FROM l2),
    l4 AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY instance_id, source ORDER BY pos) AS file, regexp_matches(line, '^@@[^@\n]*@@\s*(.*)$') AS hunk,
        regexp_extract(line, '^@@[^@\n]*@@\s*(.*)$', 1) AS ctx, regexp_replace(substr(line, 2), '^\s+', '') AS body FROM l3),
    l5 AS (SELECT *, mark = '' AND file IS NOT NULL AS live, regexp_matches(line, '^[-+ ].') AND NOT hunk AS inside FROM l4),
    l6 AS (SELECT *, CASE WHEN start IS NOT NULL THEN '' WHEN live AND hunk THEN regexp_extract(ctx, '^\s*class\s+([A-Za-z_]\w*)\s*[:\(]', 1)
        WHEN live AND inside THEN nullif(regexp_extract(body, '^\s*class\s+([A-Za-z_]\w*)\s*[:\(]', 1), '') END AS ev,
        CASE WHEN live AND hunk AND regexp_extract(ctx, '^\s*class\s+([A-Za-z_]\w*)\s*[:\(]', 1) = '' THEN nullif(regexp_extract(ctx, '^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(', 1), '')
        WHEN live AND inside AND regexp_extract(body, '^\s*class\s+([A-Za-z_]\w*)\s*[:\(]', 1) = '' THEN nullif(regexp_extract(body, '^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(', 1), '') END AS func FROM l5),
    l7 AS (SELECT *, nullif(last_value(ev IGNORE NULLS) OVER (PARTITION BY instance_id, source ORDER BY pos), '') AS cls FROM l6),
    l AS (SELECT instance_id, source, coalesce(list_sort(list(DISTINCT path) FILTER (path IS NOT NULL)), []) AS files, coalesce(list_sort(list(DISTINCT file || ':' || coalesce(cls, func)) FILTER (func IS NOT NULL)), []) AS modules,
        coalesce(list_sort(list(DISTINCT file || ':' || concat_ws('.', cls, func)) FILTER (func IS NOT NULL)), []) AS entities FROM l7 GROUP BY ALL)"""


def _f1(a: str, b: str) -> str:
    return f"coalesce(2.0 * len(list_intersect({a}, {b})) / nullif(len(list_distinct({a})) + len(list_distinct({b})), 0), 0)"


ORACLES = {
    "locations_valid": f"""WITH {_SUB} SELECT instance_id, node_key, rollout_idx, is_consumed, len(preds) AS n, CASE WHEN coalesce(trim(submission), '') = '' THEN 'blank' WHEN items IS NULL THEN 'not_a_list'
        WHEN preds IS NULL THEN 'bad_item' WHEN len(preds) = 0 THEN 'empty' WHEN len(list_distinct(preds)) < len(preds) THEN 'duplicate' END AS refused FROM p""",
    "layered_reward": f"""WITH {_SUB}, {_GOLD},
        q AS (SELECT p.instance_id, node_key, rollout_idx, is_consumed, exit_status, preds AS found, CASE WHEN exit_status = 'Submitted' THEN coalesce(preds, []) ELSE [] END AS preds, golds,
            row_number() OVER () AS rid FROM p JOIN gi USING (instance_id)),
        c0 AS (SELECT rid, unnest(preds) AS a, generate_subscripts(preds, 1) AS i, golds FROM q), c1 AS (SELECT rid, a, i, unnest(golds) AS b, generate_subscripts(golds, 1) AS j FROM c0),
        c2 AS (SELECT *, {_DEPTH} AS d FROM c1), c3 AS (SELECT *, [0.2, 0.5, 1.0][d]::DOUBLE AS w, [0.2, 0.5, 1.0][CASE WHEN b.m IS NOT NULL THEN 3 WHEN b.c IS NOT NULL THEN 2 ELSE 1 END]::DOUBLE AS l FROM c2 WHERE d > 0),
        c AS (SELECT rid, list_reduce(list_prepend({{'u': []::VARCHAR[], 'c': 0.0::DOUBLE, 'h': 0, 'fs': []::VARCHAR[]}}, list({{'u': ['p' || i, 'g' || j], 'c': w / l, 'h': (d = 3)::INT, 'fs': [a.f]}} ORDER BY -w, -d, i, j)),
            lambda x, y: CASE WHEN list_has_any(x.u, y.u) THEN x ELSE {{'u': list_concat(x.u, y.u), 'c': x.c + y.c, 'h': x.h + y.h, 'fs': list_concat(x.fs, y.fs)}} END) AS r FROM c3 GROUP BY 1),
        e AS (SELECT q.*, coalesce(r.c, 0) AS credit, coalesce(r.h, 0) AS hits, list_filter(list_zip(preds, range(1, len(preds) + 1)), lambda z: NOT list_contains(coalesce(r.u, []), 'p' || z[2])) AS lone, coalesce(r.fs, []) AS fs FROM q LEFT JOIN c USING (rid)),
        f AS (SELECT *, 0.05::DOUBLE * coalesce(list_sum(list_transform(lone, lambda z: (z[1].c IS NOT NULL)::INT + (z[1].m IS NOT NULL)::INT)), 0) + 0.05::DOUBLE * len(list_filter(lone, lambda z: list_contains(fs, z[1].f))) AS penalty FROM e),
        h AS (SELECT *, CASE WHEN len(preds) = 0 OR len(golds) = 0 THEN 0 ELSE 2 * greatest(0, credit - penalty) / (len(preds) + len(golds)) END AS rw FROM f)
        SELECT instance_id, node_key, rollout_idx, is_consumed, CASE WHEN exit_status IS DISTINCT FROM 'Submitted' THEN 'not_submitted' WHEN found IS NULL THEN 'invalid_submission' WHEN len(found) = 0 THEN 'empty_locations'
            WHEN len(golds) = 0 THEN 'empty_gold' END AS reason, len(preds) AS n_pred, len(golds) AS n_gold, hits::BIGINT AS exact_hits, round(penalty, 6) AS penalty, round(rw, 6) AS reward,
            rw >= 0.6 AND (len(golds) < 2 OR hits >= ceil(len(golds) / 2)) AS correct FROM h""",
    "independent_reward": f"""WITH {_SUB}, {_GOLD}, q AS (SELECT p.*, list_transform(preds, lambda x: x.f) AS pf, list_filter(list_transform(preds, lambda x: x.f || ':' || coalesce(x.c, x.m)), lambda y: y IS NOT NULL) AS pm,
            list_filter(list_transform(preds, lambda x: CASE WHEN x.m IS NOT NULL THEN x.f || ':' || concat_ws('.', x.c, x.m) END), lambda y: y IS NOT NULL) AS pe,
            coalesce(json_extract_string(gi.gold, '$.files[*]'), []) AS gf, coalesce(json_extract_string(gi.gold, '$.modules[*]'), []) AS gm, coalesce(json_extract_string(gi.gold, '$.entities[*]'), []) AS ge
            FROM p JOIN gi USING (instance_id) WHERE preds IS NOT NULL)
        SELECT instance_id, node_key, rollout_idx, is_consumed, round({_f1('pf', 'gf')}, 6) AS file_f1, round({_f1('pm', 'gm')}, 6) AS module_f1, round({_f1('pe', 'ge')}, 6) AS entity_f1,
            round({_f1('pf', 'gf')} + {_f1('pm', 'gm')} + {_f1('pe', 'ge')}, 6) AS reward FROM q""",
    "gold_triples": f"""WITH {_GOLD}, t AS (SELECT instance_id, source, unnest(golds) AS t FROM g) SELECT instance_id, source, t.f AS file, t.c AS class_name, t.m AS function_name,
        CASE WHEN coalesce(t.m, '') <> '' THEN 3 WHEN coalesce(t.c, '') <> '' THEN 2 ELSE 1 END AS depth FROM t""",
    "diff_locations": f"WITH {_DIFF} SELECT instance_id, source, array_to_string(files, '|') AS files, array_to_string(modules, '|') AS modules, array_to_string(entities, '|') AS entities FROM l",
    "patch_reward": f"""WITH {_DIFF}, k AS (SELECT instance_id, source, max(gold) AS gold FROM instances GROUP BY ALL), x AS (SELECT l.*, coalesce(json_extract_string(gold, '$.files[*]'), []) AS gf,
            coalesce(json_extract_string(gold, '$.modules[*]'), []) AS gm, coalesce(json_extract_string(gold, '$.entities[*]'), []) AS ge FROM l JOIN k ON l.instance_id = k.instance_id AND l.source IS NOT DISTINCT FROM k.source)
        SELECT x.instance_id, x.source, round({_f1('files', 'gf')} + {_f1('modules', 'gm')} + {_f1('entities', 'ge')}, 6) AS reward, CASE WHEN blank THEN 'empty_patch' END AS reason
        FROM x JOIN (SELECT instance_id, source, bool_and(coalesce(trim(patch), '') = '') AS blank FROM instances GROUP BY ALL) b ON b.instance_id = x.instance_id AND b.source IS NOT DISTINCT FROM x.source""",
    "diff_like": """SELECT instance_id, source, coalesce(contains(h, 'diff --git') OR contains(h, '+++ ') OR contains(h, '@@ '), false) AS diff_like FROM
        (SELECT instance_id, source, left(regexp_replace(patch, '^\\s+', ''), 2000) AS h FROM instances)""",
}

_LAYERED = ORACLES["layered_reward"].replace("0.05::DOUBLE", "0.0::DOUBLE")
ORACLES["unified_reward"] = f"""SELECT instance_id, node_key, rollout_idx, is_consumed, 'layered' AS mode, reason, reward, correct FROM ({_LAYERED}) WHERE reason IS NULL OR reason IN ('not_submitted', 'invalid_submission')
    UNION ALL SELECT instance_id, node_key, rollout_idx, is_consumed, 'independent', reason, reward, reward >= 0.6 FROM (
        SELECT l.instance_id, l.node_key, l.rollout_idx, l.is_consumed, CASE WHEN l.reason IN ('not_submitted', 'invalid_submission') THEN l.reason END AS reason,
            CASE WHEN l.reason IN ('not_submitted', 'invalid_submission') THEN 0.0 ELSE round(i.reward / 3, 6) END::DOUBLE AS reward
        FROM ({_LAYERED}) l LEFT JOIN (SELECT DISTINCT * FROM ({ORACLES["independent_reward"]})) i USING (instance_id, node_key, rollout_idx, is_consumed))"""
