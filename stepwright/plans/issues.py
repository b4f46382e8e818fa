"""Issue instances: rules, gold, repositories, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright.operators import repo_splits as S
from stepwright.operators import rules as R
from stepwright.session import table

ORDER = ["loaded_at", "source", "instance_id", "repo"]


def _q(function, *tables):
    def query(spark, sf):
        return function(*[table(spark, sf, t) for t in tables or ("instances",)])

    return query


def _reasoned(i):
    return R.with_drop_reason(R.require_columns(i), ORDER)


def _parsed(i):
    owner, name, commit = R.parse_repo("repo")
    return i.select("instance_id", "source", owner.alias("owner"), name.alias("name"), commit.alias("commit8"), R.repo_url(owner, name).alias("url"))


def _gold(i):
    gold = R.gold_struct("gold")
    return i.select("instance_id", "source", F.array_join(gold["files"], "|").alias("files"), F.array_join(gold["modules"], "|").alias("modules"), F.array_join(gold["entities"], "|").alias("entities"))


def _gold_stats(i):
    g = R.gold_struct("gold")
    has = lambda c: F.count_if(F.size(g[c]) > 0)
    return i.agg(has("files").alias("n_with_files"), has("modules").alias("n_with_modules"), has("entities").alias("n_with_entities"), F.count_if(R.is_empty(g)).alias("n_empty"))


def _repo_distribution(i):
    counts = i.groupBy("repo").agg(F.count(F.lit(1)).alias("size"))
    return R.nearest_rank(counts, "size", {"median": 0.5})


def _env(i):
    return i.select("instance_id", "source", F.length(F.when(F.coalesce("use_patch", F.lit(True)), F.col("patch"))).cast("bigint").alias("patch_chars"), F.col("base_commit").isNotNull().alias("checkout"))


def _gold_union(i):
    g = R.gold_struct("gold")
    names = F.array_sort(F.array_union(g["modules"], g["entities"]))
    return i.select("instance_id", "source", F.array_join(names, "|").alias("names"), F.size(names).cast("bigint").alias("n"))


def _python_only(i):
    paths = i.select("instance_id", "source", F.explode(R.gold_struct("gold")["files"]).alias("path"))
    return paths.groupBy("instance_id", "source").agg(F.count_if(R.is_python_path("path")).alias("n_python"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "filter_reasons": _q(lambda i: _reasoned(i).select("instance_id", "source", "drop_reason")),
    "filter_kept": _q(lambda i: _reasoned(i).filter("drop_reason IS NULL").select("instance_id", "source", "repo")),
    "filter_report": _q(lambda i: R.filter_report(_reasoned(i))),
    "filter_counts": _q(lambda i: _reasoned(i).filter("drop_reason IS NOT NULL").groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))),
    "statement_stats": _q(lambda i: R.nearest_rank(i.select(F.length(F.coalesce("problem_statement", F.lit(""))).cast("bigint").alias("len")), "len", {"p50": 0.5, "p95": 0.95})),
    "repo_distribution": _q(_repo_distribution),
    "source_counts": _q(lambda i: i.groupBy("source").agg(F.count(F.lit(1)).alias("n"))),
    "gold_typed": _q(_gold),
    "gold_stats": _q(_gold_stats),
    "gold_union": _q(_gold_union),
    "gold_python": _q(_python_only),
    "parse_repo": _q(_parsed),
    "patch_flags": _q(lambda i: i.select("instance_id", "source", R.creates_or_deletes_files("patch").alias("creates_or_deletes"))),
    "env_params": _q(_env),
    "repo_set": _q(lambda i: R.first_commits(i, "loaded_at")),
    "repo_splits": _q(lambda i: S.make_splits(i)),
    "split_report": _q(lambda i: S.split_report(S.make_splits(i))),
    "split_leaks": _q(lambda b: S.leaking(b, "repo", "split"), "build_dataset"),
    "split_scan": _q(lambda b: b.filter("split IS NOT NULL").select("instance_id", "split").distinct(), "build_dataset"),
    "sample_hash_n": _q(lambda i: S.hash_sample(i.select("instance_id").distinct(), "instance_id", 25)),
    "spot_check": _q(lambda b: S.stratified_sample(b, "row_id", "split", 20).select("row_id", "split"), "build_dataset"),
    "pool_semi": _q(lambda i: S.select_instances(i, S.make_splits(i)).select("instance_id", "source")),
    "pool_first_n": _q(lambda i: S.select_instances(i.select("instance_id", "repo").distinct(), S.make_splits(i), count=15).select("instance_id")),
}

_GOLD = "(SELECT *, list_sort(list_distinct(coalesce(json_extract_string(gold, '$.files[*]'), []))) AS f, list_sort(list_distinct(coalesce(json_extract_string(gold, '$.modules[*]'), []))) AS m, list_sort(list_distinct(coalesce(json_extract_string(gold, '$.entities[*]'), []))) AS e FROM instances)"
_REASONS = f"""
    a AS (SELECT *, coalesce(problem_statement, '') AS t, trim(repo) AS tr FROM {_GOLD}),
    b AS (SELECT *, CASE WHEN regexp_replace(t, '[\\s\\p{{Z}}]+', '', 'g') = '' THEN 'empty_statement' WHEN length(t) > 20000 THEN 'statement_too_long'
        WHEN regexp_matches(coalesce(patch, ''), '(?m)^new file mode') OR regexp_matches(coalesce(patch, ''), '(?m)^deleted file mode') OR regexp_matches(coalesce(patch, ''), '(?m)^(---|\\+\\+\\+) /dev/null\\b') THEN 'created_or_deleted_files'
        WHEN len(f) + len(m) + len(e) = 0 THEN 'no_valid_gold' END AS early FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY instance_id, early IS NULL ORDER BY loaded_at NULLS FIRST, source NULLS FIRST, instance_id, repo) AS rn FROM b),
    d AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN rn > 1 THEN 'duplicate_instance_id'
        WHEN NOT contains(repo, '/') OR string_split(tr, '/')[1] = '' OR NOT regexp_matches(instance_id, '^[A-Za-z0-9_.-]+$') THEN 'invalid_format' END AS drop_reason FROM c)"""
_PARSED = r"""(SELECT *, CASE WHEN contains(t, '/') THEN string_split(t, '/')[1] ELSE '' END AS o, CASE WHEN contains(t, '/') THEN substr(t, instr(t, '/') + 1) ELSE t END AS rest
    FROM (SELECT *, CASE WHEN trim(repo) LIKE '%.git' THEN left(trim(repo), length(trim(repo)) - 4) ELSE trim(repo) END AS t FROM instances))"""
_SPLITS = """
    r AS (SELECT repo, row_number() OVER (ORDER BY sha1('42:' || repo), repo) - 1 AS pos, count(*) OVER () AS k FROM (SELECT DISTINCT repo FROM instances WHERE repo IS NOT NULL)),
    n1 AS (SELECT *, round_even(k * 0.6, 0) AS n FROM r),
    n2 AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.1, 0)) ELSE round_even(n * 0.1, 0) END AS d FROM n1),
    n3 AS (SELECT *, CASE WHEN n >= 3 AND d + d > n - 1 THEN 1 ELSE d END AS e FROM n2),
    s AS (SELECT repo, pos < n AS gen_pool, CASE WHEN pos >= n THEN NULL WHEN n - 2 * e < 0 OR pos < n - 2 * e THEN 'train' WHEN pos < n - e THEN 'dev' ELSE 'test' END AS prm_split FROM n3),
    sp AS (SELECT i.instance_id, i.repo, coalesce(gen_pool, false) AS gen_pool, prm_split FROM instances i LEFT JOIN s USING (repo))"""
ORACLES = {
    "filter_reasons": f"WITH {_REASONS} SELECT instance_id, source, drop_reason FROM d",
    "filter_kept": f"WITH {_REASONS} SELECT instance_id, source, repo FROM d WHERE drop_reason IS NULL",
    "filter_report": f"""WITH {_REASONS} SELECT count(*) AS original_total, count(*) - count(drop_reason) AS kept_total, count(drop_reason) AS dropped_total,
        count(DISTINCT repo) AS n_repos_original, count(DISTINCT repo) FILTER (drop_reason IS NULL) AS n_repos_kept FROM d""",
    "filter_counts": f"WITH {_REASONS} SELECT drop_reason, count(*) AS n FROM d WHERE drop_reason IS NOT NULL GROUP BY 1",
    "statement_stats": """WITH l AS (SELECT list_sort(list(length(coalesce(problem_statement, '')))) AS v FROM instances)
        SELECT v[1] AS min, v[len(v) // 2 + 1] AS p50, v[floor(len(v) * 0.95)::INT + 1] AS p95, v[len(v)] AS max, len(v) AS n_values FROM l""",
    "repo_distribution": """WITH l AS (SELECT list_sort(list(n)) AS v FROM (SELECT count(*) AS n FROM instances GROUP BY repo))
        SELECT v[1] AS min, v[len(v) // 2 + 1] AS median, v[len(v)] AS max, len(v) AS n_values FROM l""",
    "source_counts": "SELECT source, count(*) AS n FROM instances GROUP BY 1",
    "gold_typed": f"SELECT instance_id, source, array_to_string(f, '|') AS files, array_to_string(m, '|') AS modules, array_to_string(e, '|') AS entities FROM {_GOLD}",
    "gold_stats": f"""SELECT count(*) FILTER (len(f) > 0) AS n_with_files, count(*) FILTER (len(m) > 0) AS n_with_modules, count(*) FILTER (len(e) > 0) AS n_with_entities,
        count(*) FILTER (len(f) + len(m) + len(e) = 0) AS n_empty FROM {_GOLD}""",
    "gold_union": f"SELECT instance_id, source, array_to_string(u, '|') AS names, len(u) AS n FROM (SELECT *, list_sort(list_distinct(list_concat(m, e))) AS u FROM {_GOLD})",
    "gold_python": f"""SELECT instance_id, source, count(*) FILTER (p LIKE '%.py' OR p LIKE '%.pyi' OR p LIKE '%.py/%') AS n_python, count(*) AS n FROM
        (SELECT instance_id, source, lower(trim(string_split(unnest(f), ':')[1])) AS p FROM {_GOLD}) GROUP BY ALL""",
    "parse_repo": f"""SELECT instance_id, source, o AS owner, regexp_replace(rest, '\\.[0-9a-fA-F]{{8}}$', '') AS name, nullif(regexp_extract(rest, '\\.([0-9a-fA-F]{{8}})$', 1), '') AS commit8,
        'https://github.com/' || o || '/' || regexp_replace(rest, '\\.[0-9a-fA-F]{{8}}$', '') AS url FROM {_PARSED}""",
    "patch_flags": """SELECT instance_id, source, regexp_matches(p, '(?m)^new file mode') OR regexp_matches(p, '(?m)^deleted file mode') OR regexp_matches(p, '(?m)^(---|\\+\\+\\+) /dev/null\\b')
        AS creates_or_deletes FROM (SELECT *, coalesce(patch, '') AS p FROM instances)""",
    "env_params": "SELECT instance_id, source, CASE WHEN coalesce(use_patch, true) THEN length(patch) END AS patch_chars, base_commit IS NOT NULL AS checkout FROM instances",
    "repo_set": "SELECT repo, first(base_commit ORDER BY loaded_at, base_commit) FILTER (base_commit IS NOT NULL) AS base_commit FROM instances GROUP BY 1",
    "repo_splits": f"WITH {_SPLITS} SELECT * FROM sp",
    "split_report": f"WITH {_SPLITS} SELECT gen_pool, prm_split, count(DISTINCT repo) AS n_repos, count(*) AS n_instances FROM sp GROUP BY ALL",
    "split_leaks": "SELECT repo, count(DISTINCT split) AS n_splits FROM build_dataset WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "split_scan": "SELECT DISTINCT instance_id, split FROM build_dataset WHERE split IS NOT NULL",
    "sample_hash_n": "SELECT instance_id FROM (SELECT DISTINCT instance_id FROM instances) ORDER BY sha1('42:' || instance_id), instance_id LIMIT 25",
    "spot_check": """SELECT row_id, split FROM (SELECT row_id, split, row_number() OVER (PARTITION BY split ORDER BY sha1('42:' || row_id), row_id) AS pos FROM build_dataset) WHERE pos <= 7
        ORDER BY split NULLS LAST, pos LIMIT 20""",
    "pool_semi": f"WITH {_SPLITS} SELECT instance_id, source FROM instances WHERE instance_id IN (SELECT instance_id FROM sp WHERE gen_pool)",
    "pool_first_n": f"WITH {_SPLITS} SELECT instance_id FROM (SELECT DISTINCT instance_id, repo FROM instances) WHERE instance_id IN (SELECT instance_id FROM sp WHERE gen_pool) ORDER BY 1 LIMIT 15",
}
