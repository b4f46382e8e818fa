"""Fitting trajectories into a context window.

A prompt is [system, user context, trajectory, user instruction].  What doesn't fit loses whole steps from
the front, then the outputs of tools are clipped; context and instruction are never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARK = "…[truncated]"
OUTCOMES = ("fits", "steps_dropped", "tools_clipped", "unfittable")


def tool_clip(content: str | Column, keep: int) -> Column:
    """A tool's content with at most ``keep`` characters of output; a JSON object keeps its return code."""
    content = F.col(content) if isinstance(content, str) else content
    parsed = F.try_parse_json(content)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    output = F.concat(F.substring(F.coalesce(F.get_json_object(content, "$.output"), F.lit("")), 1, keep), F.lit(MARK))
    code = F.coalesce(F.get_json_object(content, "$.returncode"), F.lit("null"))
    clipped = F.concat(F.lit('{"returncode": '), code, F.lit(', "output": '), F.to_json(F.array(output)), F.lit("}"))
    clipped = F.regexp_replace(clipped, r"(?s)\"output\": \[(.*)\]\}$", '"output": $1}')
    return F.when(is_object, clipped).otherwise(F.concat(F.substring(F.coalesce(content, F.lit("")), 1, keep), F.lit(MARK)))


def head_tail(text: str | Column, most: int) -> Column:
    """A text of more than ``most`` characters as its two ends with the number of those left out between them."""
    text, half = F.col(text) if isinstance(text, str) else text, most // 2
    n = F.length(text)
    return F.when(n <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n... ["), (n - 2 * half).cast("string"), F.lit(" characters left out] ...\n"), F.right(text, F.lit(half))))


def plan(sizes: DataFrame, key: str, limit: int, mark_tokens: int) -> DataFrame:
    """(key, n_steps, total, floor, n_drop, kept, outcome) of each prompt.

    ``sizes`` has one row a step: (key, step from 1, tokens, clipped_tokens, head_tokens), head_tokens being those
    of context and instruction.  n_drop is the least number of oldest steps without which the rest fits
    with a mark in their place; the last step always stays.  Since dropping more never makes it longer, one
    pass over the sums from the end finds what a bisection would.
    """
    w = Window.partitionBy(key)
    tail = w.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    run = sizes.withColumn("rest", F.sum("tokens").over(tail)).withColumn("clip", F.sum("clipped_tokens").over(tail))
    mark = F.when(F.col("step") > 1, mark_tokens).otherwise(0)
    run = run.withColumn("fits", F.col("rest") + F.col("head_tokens") + mark <= limit)
    out = run.groupBy(key).agg(
        F.max("step").alias("n_steps"), F.max("head_tokens").alias("head_tokens"), F.max("rest").alias("trajectory"), F.min(F.when(F.col("fits"), F.col("step") - 1)).alias("least"),
        F.max_by("clip", "step").alias("last_clip"), F.max_by("rest", "step").alias("last"))
    total = F.col("trajectory") + F.col("head_tokens")
    n_drop = F.when(total <= limit, 0).otherwise(F.coalesce("least", F.col("n_steps") - 1))
    marked = F.when(n_drop > 0, mark_tokens).otherwise(0)
    outcome = (
        F.when(total <= limit, "fits").when(F.col("head_tokens") + mark_tokens > limit, "unfittable").when(F.col("least").isNotNull(), "steps_dropped")
        .when(F.col("head_tokens") + marked + F.col("last_clip") <= limit, "tools_clipped").otherwise("unfittable")
    )
    return out.select(key, "n_steps", total.alias("total"), (F.col("head_tokens") + mark_tokens).alias("floor"), n_drop.alias("n_drop"), outcome.alias("outcome"))


def oversize_candidates(samples: DataFrame, tokens: str, limit: int) -> DataFrame:
    """Rows that need the full test: more tokens than the limit, or a number that can't be trusted (0 or null)."""
    return samples.filter(F.col(tokens).isNull() | (F.col(tokens) == 0) | (F.col(tokens) > limit))
