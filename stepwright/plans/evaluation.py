"""Metrics of scored samples; the score is a closed formula of the row id, so that SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepwright.operators import metrics as M
from stepwright.plans import texts
from stepwright.session import table


def scored(b):
    clean = F.lower(F.trim("split"))
    score = ((F.col("row_id") * 7919) % 1000) / 1000.0 * 0.8 + F.col("label_binary") * 0.15
    return b.filter("label_binary IS NOT NULL").select(
        "row_id", "step_index", "step_count", "rendered_tokens", "label", "mc_score", clean.alias("split"), F.lower(F.trim("label_source")).alias("label_source"),
        F.col("label_binary").cast("int").alias("y"), F.round(score, 2).alias("s"))


def _q(function):
    return lambda spark, sf: function(scored(table(spark, sf, "build_dataset")))


def _truncated(b):
    """Metrics of samples that don't fit the context window whole, and of those that do; the gap is of the AUC, null without both."""
    plan = texts._plan(b).select("row_id", (F.col("outcome") != "fits").alias("cut"))
    d = scored(b).join(plan, "row_id", "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    parts = M.bucket_metrics(d, "y", "s", F.when(F.col("cut"), "truncated").otherwise("not_truncated"))
    auc = lambda name: F.max(F.when(F.col("bucket") == name, F.col("auc")))
    gap = parts.agg(F.round(auc("truncated") - auc("not_truncated"), 6).alias("auc_gap_truncated_minus_clean"))
    return parts.crossJoin(gap)


QUERIES = {
    "truncated_buckets": lambda spark, sf: _truncated(table(spark, sf, "build_dataset")),
    "dev_brier": _q(lambda d: d.filter("split = 'dev'").withColumn("p", M.sigmoid(F.col("s") * 4 - 2)).agg(M.rounded(M.brier("y", "p"), "brier"))),
    "roc_auc": _q(lambda d: M.roc_auc(d, "y", "s")),
    "roc_auc_by_source": _q(lambda d: M.roc_auc(d, "y", "s", ["label_source"])),
    "average_ranks": _q(lambda d: M.average_ranks(d, "row_id", "s")),
    "pr_auc": _q(lambda d: M.pr_auc(d, "y", "s", "row_id")),
    "class_metrics": _q(lambda d: M.class_metrics(d, "y", "s")),
    "brier": _q(lambda d: d.agg(M.rounded(M.brier("y", "s"), "brier"))),
    "log_loss": _q(lambda d: d.agg(M.rounded(M.log_loss("y", "s"), "log_loss"))),
    "calibration_bins": _q(lambda d: M.calibration(d, "y", "s")),
    "ece": _q(lambda d: M.ece(d, "y", "s")),
    "pearson": _q(lambda d: d.agg(M.rounded(M.pearson(F.col("mc_score"), F.col("s")), "pearson"))),
    "spearman": _q(lambda d: M.spearman(d, "row_id", "mc_score", "s")),
    "soft_bce": _q(lambda d: d.filter("label IS NOT NULL").withColumn("l", F.col("label").cast("double")).withColumn("z", F.col("s") * 4 - 2).agg(M.rounded(M.soft_bce("l", "z", 1.0, 2.0), "loss"))),
    "dev_metrics": _q(lambda d: M.roc_auc(d.filter("split = 'dev'").withColumn("p", F.round(M.sigmoid(F.col("s") * 4 - 2), 9)), "y", "p")),
    "position_buckets": _q(lambda d: M.bucket_metrics(d, "y", "s", M.position_bucket("step_index"))),
    "relative_buckets": _q(lambda d: M.bucket_metrics(d, "y", "s", M.relative_bucket("step_index", "step_count"))),
    "length_buckets": _q(lambda d: M.bucket_metrics(d, "y", "s", M.length_bucket("rendered_tokens"))),
    "split_summary": _q(lambda d: M.summary(d, "y", "s", "split", "mc_score")),
    "bootstrap_auc": _q(lambda d: M.bootstrap_metric(d, "row_id", ["y", "s"], lambda rows, w, by: M.roc_auc(rows, "y", "s", by, w), "auc", n_boot=20)),
    "bootstrap_ci": _q(lambda d: M.bootstrap_ci(d, "row_id", "s", n_boot=50)),
}

_D = """d AS (SELECT row_id, step_index, step_count, rendered_tokens, label, mc_score, lower(trim(split)) AS split, lower(trim(label_source)) AS label_source, label_binary::INT AS y,
    round(((row_id * 7919) % 1000) / 1000.0::DOUBLE * 0.8::DOUBLE + label_binary * 0.15::DOUBLE, 2) AS s FROM build_dataset WHERE label_binary IS NOT NULL)"""


def _auc(by: str, source: str = "d", score: str = "s") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {by + ', ' if by else ''}count(*) AS n, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif((count(*) FILTER (y = 1)) * (count(*) FILTER (y <> 1)), 0), 6) AS auc
        FROM (SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{score}) - 1) / 2 AS rk FROM {source}) {'GROUP BY ' + by if by else ''}"""


_BIN = " + ".join(f"(s > {e!r}::DOUBLE)::INT" for e in M.EDGES)
_BRIER = "round(avg((s - y) ** 2), 6)"
_LOSS = "round(-avg(y * ln(greatest(1e-7, least(1 - 1e-7, s))) + (1 - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, s)))), 6)"


def _bucket(case: str) -> str:
    return f"""WITH {_D}, b AS (SELECT *, {case} AS bucket FROM d), a AS ({_auc('bucket', 'b')})
        SELECT b.bucket, count(*) AS n, round(avg(y), 6) AS pos_rate, round(avg(s), 6) AS mean_score, {_BRIER} AS brier, any_value(a.auc) AS auc FROM b JOIN a ON a.bucket = b.bucket GROUP BY 1"""


ORACLES = {
    "roc_auc": f"WITH {_D} {_auc('')}",
    "roc_auc_by_source": f"WITH {_D} {_auc('label_source')}",
    "average_ranks": f"WITH {_D} SELECT row_id, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS avg_rank FROM d",
    "pr_auc": f"WITH {_D} SELECT round(avg(k / i), 6) AS pr_auc FROM (SELECT y, sum(y) OVER w AS k, row_number() OVER w AS i FROM d WINDOW w AS (ORDER BY s DESC, row_id)) WHERE y = 1",
    "class_metrics": f"""WITH {_D}, c AS (SELECT count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5 AND y <> 1) AS fp, count(*) FILTER (s < 0.5 AND y <> 1) AS tn, count(*) FILTER (s < 0.5 AND y = 1) AS fn FROM d)
        SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "brier": f"WITH {_D} SELECT {_BRIER} AS brier FROM d",
    "log_loss": f"WITH {_D} SELECT {_LOSS} AS log_loss FROM d",
    "calibration_bins": f"""WITH {_D}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(s) AS s, avg(y) AS y FROM d GROUP BY 1)
        SELECT r.bin::INT AS bin, coalesce(n, 0) AS n, round(s, 6) AS mean_score, round(y, 6) AS pos_rate FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin""",
    "ece": f"WITH {_D}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(s) AS s, avg(y) AS y FROM d GROUP BY 1) SELECT round(sum(n * abs(s - y)) / sum(n), 6) AS ece FROM b",
    "pearson": f"WITH {_D} SELECT round(CASE WHEN NOT isnan(corr(mc_score::DOUBLE, s)) THEN corr(mc_score::DOUBLE, s) END, 6) AS pearson FROM d",
    "spearman": f"""WITH {_D}, r AS (SELECT rank() OVER (ORDER BY mc_score) + (count(*) OVER (PARTITION BY mc_score) - 1) / 2 AS rx, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS ry
        FROM d WHERE mc_score IS NOT NULL) SELECT round(CASE WHEN NOT isnan(corr(rx, ry)) THEN corr(rx, ry) END, 6) AS spearman, count(*) AS n FROM r""",
    "soft_bce": f"""WITH {_D} SELECT round(-avg(label::DOUBLE * -ln(1 + exp(-(s * 4 - 2))) + 2.0 * (1 - label::DOUBLE) * -ln(1 + exp(s * 4 - 2))), 6) AS loss FROM d WHERE label IS NOT NULL""",
    "dev_metrics": f"WITH {_D}, e AS (SELECT *, round(1 / (1 + exp(-(s * 4 - 2))), 9) AS p FROM d WHERE split = 'dev') {_auc('', 'e', 'p')}",
    "position_buckets": _bucket("CASE WHEN step_index IS NULL THEN 'nan' WHEN step_index <= 5 THEN step_index::VARCHAR WHEN step_index <= 10 THEN '6-10' WHEN step_index <= 15 THEN '11-15' WHEN step_index <= 20 THEN '16-20' ELSE '21+' END"),
    "relative_buckets": _bucket("CASE WHEN step_count IS NULL OR step_count <= 0 THEN 'nan' ELSE '[' || least(9, (10 * (step_index - 1)) // greatest(1, step_count)) * 10 || '%,' || (least(9, (10 * (step_index - 1)) // greatest(1, step_count)) * 10 + 10) || '%]' END"),
    "length_buckets": _bucket("CASE WHEN rendered_tokens IS NULL THEN 'nan' WHEN rendered_tokens <= 4096 THEN '<=4K' WHEN rendered_tokens <= 8192 THEN '4-8K' WHEN rendered_tokens <= 12288 THEN '8-12K' WHEN rendered_tokens <= 16384 THEN '12-16K' ELSE '>16K' END"),
    "split_summary": f"""WITH {_D}, a AS ({_auc('split')}), p AS (SELECT split, count(*) AS n, {_BRIER} AS brier, round(avg(((s >= 0.5) = (y = 1))::INT), 6) AS accuracy, {_LOSS} AS log_loss,
        round(CASE WHEN NOT isnan(corr(mc_score::DOUBLE, s)) THEN corr(mc_score::DOUBLE, s) END, 6) AS mc_corr FROM d GROUP BY 1) SELECT p.*, a.auc FROM p LEFT JOIN a ON a.split = p.split""",
    "bootstrap_auc": f"""WITH {_D}, r AS (SELECT b, y, s, ('0x' || left(md5('42:' || b || ':' || row_id), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d, range(1, 21) t(b)),
        w AS (SELECT b, y, s, {' + '.join(f'(u >= {c!r}::DOUBLE)::INT' for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119))} AS w FROM r),
        h AS (SELECT b, s, coalesce(sum(w) FILTER (y = 1), 0) AS p, coalesce(sum(w) FILTER (y <> 1), 0) AS n FROM w WHERE w > 0 GROUP BY ALL),
        a AS (SELECT b, p, n, p * (sum(n) OVER (PARTITION BY b ORDER BY s) - n / 2.0::DOUBLE) AS won FROM h), z AS (SELECT b, round(sum(won) / nullif(sum(p) * sum(n), 0), 6) AS auc FROM a GROUP BY 1)
        SELECT round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high, count(auc) AS n_boot FROM z""",
    "bootstrap_ci": f"""WITH {_D}, r AS (SELECT b, s, ('0x' || left(md5('42:' || b || ':' || row_id), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM d, range(1, 51) t(b)),
        w AS (SELECT b, s, {' + '.join(f'(u >= {c!r}::DOUBLE)::INT' for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119))} AS w FROM r),
        m AS (SELECT b, sum(w * s) / sum(w) AS mean FROM w GROUP BY 1) SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, count(*) AS n_boot FROM m""",
}


def _truncated_sql() -> str:
    plan = texts.ORACLES["trunc_plan"]
    bucket = _bucket("CASE WHEN cut THEN 'truncated' ELSE 'not_truncated' END").replace("FROM d)", "FROM (SELECT d.*, coalesce(o.outcome <> 'fits', false) AS cut FROM d LEFT JOIN pl o USING (row_id)))", 1)
    return f"""WITH pl AS ({plan}), z AS ({bucket}) SELECT *, (SELECT round(max(auc) FILTER (bucket = 'truncated') - max(auc) FILTER (bucket = 'not_truncated'), 6) FROM z) AS auc_gap_truncated_minus_clean FROM z"""


ORACLES["dev_brier"] = f"WITH {_D} SELECT round(avg(pow(1 / (1 + exp(-(s * 4 - 2))) - y, 2)), 6) AS brier FROM d WHERE split = 'dev'"
ORACLES["truncated_buckets"] = _truncated_sql()
