"""Queries of the training-text problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.llm import encode, leaks, overlap, pieces, residue, splits, survivors
from stepwright.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Samples that are too large and are cut."""
    return pieces.oversized(table(spark, sf, "build_dataset"), "row_id")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All samples as ordered pieces under the limit."""
    return pieces.split_oversized(table(spark, sf, "build_dataset"), "row_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Instances whose repository is spread over several splits."""
    return splits.spread_over_splits(table(spark, sf, "build_dataset"))


def p3_assign(spark: SparkSession, sf: str) -> DataFrame:
    """A split for every sample that keeps repositories together."""
    return splits.assign_splits(table(spark, sf, "build_dataset"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of duplicate samples and the row to keep."""
    return survivors.duplicate_groups(table(spark, sf, "build_dataset"))


def p5_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One sample for each (instance, prefix, step) with the best known value of each field."""
    return survivors.survivors(table(spark, sf, "build_dataset"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a training and a held-out instance with the same or nearly the same report."""
    return overlap.overlap_pairs(table(spark, sf, "instances"), table(spark, sf, "build_dataset"))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """The number of such pairs per split and source."""
    return overlap.overlap_report(table(spark, sf, "instances"), table(spark, sf, "build_dataset"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode(table(spark, sf, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that give test items away."""
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The passages of test items that documents hold, with their places."""
    return leaks.leak_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items")).withColumn("coverage", F.round("coverage", 6))


def p8_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without such passages."""
    return leaks.without_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per test item, the number of documents that give it away."""
    return leaks.leak_report(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are template residue or pages without content."""
    return residue.residues(table(spark, sf, "documents")).select("doc_id")


def p9_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of the documents that stay in the corpus."""
    return residue.kept(table(spark, sf, "documents")).select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_pieces": p1_pieces, "p3_found": p3_found, "p3_assign": p3_assign, "p5_found": p5_found, "p5_survivors": p5_survivors,
    "p6_found": p6_found, "p6_report": p6_report, "p7_ids": p7_ids, "p8_found": p8_found, "p8_spans": p8_spans, "p8_cleaned": p8_cleaned, "p8_report": p8_report, "p9_found": p9_found, "p9_kept": p9_kept,
}

_BARE = "nullif(regexp_replace({}, '[\\s\\p{{Z}}]+', '', 'g'), '')"
_REPOSITORY = r"""
    r0 AS (SELECT *, lower(trim(regexp_replace(repo, '[\s\p{Z}]+', ' ', 'g'))) AS t FROM build_dataset),
    r1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '^([a-z+]+://)?([^/@]*@)?', ''), '/+$', ''), '\.git$', '') AS u FROM r0),
    r2 AS (SELECT *, CASE WHEN len(string_split(replace(u, ':', '/'), '/')) >= 3 THEN regexp_replace(u, '^[a-z0-9-]+(\.[a-z0-9-]+)+(:[0-9]+/|[:/])', '') ELSE u END AS v FROM r1),
    r3 AS (SELECT *, regexp_extract(v, '^([^/]+)/[^/]+', 1) AS o, regexp_replace(regexp_replace(regexp_extract(v, '^[^/]+/([^/]+)', 1), '\.git$', ''), '\.[0-9a-f]{8}$', '') AS n FROM r2),
    r4 AS (SELECT *, CASE WHEN n LIKE '%\_\_%' ESCAPE '\' THEN regexp_replace(n, '__', '/') WHEN o <> '' AND n <> '' THEN o || '/' || n END AS repository,
                  lower(regexp_replace(split, '[\s\p{Z}]+', '', 'g')) AS s FROM r3)"""

ORACLES = {
    "p1_found": """
        SELECT row_id FROM build_dataset WHERE coalesce(list_sum(list_transform(messages, lambda m: coalesce(length(m.content), 0)
            + coalesce(length(m.reasoning_content), 0)
            + coalesce(list_sum(list_transform(m.tool_calls, lambda c: coalesce(length(c."function".arguments), 0))), 0))), 0) > 7000""",
    "p3_found": f"""
        WITH {_REPOSITORY}
        SELECT DISTINCT instance_id FROM r4 WHERE instance_id IS NOT NULL AND repository IN (
            SELECT repository FROM r4 WHERE repository IS NOT NULL GROUP BY repository
            HAVING count(DISTINCT s) FILTER (s IN ('train', 'dev', 'test')) > 1)""",
    "p5_found": f"""
        WITH k AS (SELECT row_id, instance_id, step_index, n_rollouts, built_at, lower(regexp_replace(label_source, '[\\s\\p{{Z}}]+', '', 'g')) AS src,
            to_json(list_transform(coalesce(messages, []), lambda m: {{'r': {_BARE.format("m.role")}, 'c': {_BARE.format("m.content")},
                'g': {_BARE.format("m.reasoning_content")}, 'i': {_BARE.format("m.tool_call_id")},
                't': CASE WHEN len(m.tool_calls) > 0 THEN list_transform(m.tool_calls, lambda c: {{'i': {_BARE.format("c.id")}, 't': {_BARE.format("c.type")},
                     'n': {_BARE.format('c."function".name')}, 'a': {_BARE.format('c."function".arguments')}}}) END}})) AS prefix
            FROM build_dataset),
        g AS (SELECT *, min(row_id) OVER w AS group_row_id, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY instance_id, step_index, prefix))
        SELECT group_row_id, first(row_id ORDER BY CASE src WHEN 'node_mc' THEN 0 WHEN 'leaf_chain' THEN 1 ELSE 2 END,
                n_rollouts DESC NULLS LAST, built_at DESC NULLS LAST, row_id) AS keep_row_id
        FROM g WHERE n > 1 GROUP BY group_row_id""",
}
