"""Pluggable scorers and executors behind plain tables: what runs outside gets rows and gives rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.operators import choose as C

Scorer = Callable[[pd.DataFrame], pd.Series]

#: Scorers by name; a scorer is made once a worker by its factory and then sees batches.
SCORERS: dict[str, Callable[[], Scorer]] = {}


def register(name: str, factory: Callable[[], Scorer]) -> None:
    if name in SCORERS:
        raise ValueError(f"{name} is registered")
    SCORERS[name] = factory


def _closed_form() -> Scorer:
    """A score in [0, 1) that depends on the text only: for dry runs."""
    return lambda pdf: pdf["text"].map(lambda t: int(hashlib.md5((t or "").encode("utf-8", "replace")).hexdigest()[:4], 16) % 1000 / 1000.0)


register("closed_form", _closed_form)


def score(df: DataFrame, keys: list[str], text: str, scorer: str | Callable[[], Scorer] = "closed_form") -> DataFrame:
    """(keys, score) of every row; a row whose score fails is null, so that it can be counted and left out."""
    factory = SCORERS[scorer] if isinstance(scorer, str) else scorer
    slim = df.select(*keys, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keys) + ", score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score_batch = factory()
        for pdf in batches:
            try:
                values = score_batch(pdf)
            except Exception:  # one bad row must not lose the batch
                def single(i: int) -> float | None:
                    try:
                        return float(score_batch(pdf.iloc[[i]]).iloc[0])
                    except Exception:
                        return None

                values = pd.Series([single(i) for i in range(len(pdf))], index=pdf.index, dtype="float64")
            yield pdf[keys].assign(score=values.astype("float64"))

    return slim.mapInPandas(run, schema)


def score_or_skip(df: DataFrame, keys: list[str], text: str, scorer: str | Callable[[], Scorer] = "closed_form") -> tuple[DataFrame, DataFrame]:
    """The scored rows, and one row with the number of rows that could not be scored."""
    scored = score(df, keys, text, scorer)
    return scored.filter("score IS NOT NULL"), scored.agg(F.count_if(F.col("score").isNull()).alias("n_skipped"))


def prefix_scores(rollouts: DataFrame, key: list[str], score_of: Callable[[DataFrame], DataFrame], most_steps: int = 32) -> DataFrame:
    """(key, t from 0, p) of the first ``most_steps`` prefixes of each rollout (key, n_steps).

    ``score_of`` gets a row a prefix (key, t) and gives it back with p, null where it can't be scored; those are left out.
    """
    steps = F.least(F.col("n_steps"), F.lit(most_steps))
    prefixes = rollouts.filter("n_steps > 0").select(*key, F.explode(F.sequence(F.lit(0), steps - 1)).alias("t"))
    return score_of(prefixes).filter("p IS NOT NULL").select(*key, "t", "p")


def trajectory_frame(rollouts: DataFrame, key: list[str], score_of: Callable[[DataFrame], DataFrame], most_steps: int = 32, candidates: int = 5) -> DataFrame:
    """One row a scored root rollout: its outcome, its scores in the order of steps, and their aggregates.

    Of each instance the first ``candidates`` root rollouts by index count; longer rollouts by their first prefixes.
    """
    roots = C.cap(rollouts.filter("node_key = 'root'"), "instance_id", candidates)
    scores = prefix_scores(roots, key, score_of, most_steps)
    ordered = scores.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "p"))), lambda x: x["p"]).alias("scores"))  # at most most_steps
    return roots.join(C.rollout_aggregates(scores, key), key).join(ordered, key)


def scripted_rollouts(tasks: DataFrame, correct_rate: float = 0.5, fail_rate: float = 0.1, max_steps: int = 6, seed: int = 42) -> DataFrame:
    """Results of rollouts that nobody ran: each slot (instance_id, node_key, rollout_idx) has its own fixed outcome.

    Native expressions over a hash of the seed and the slot; a failed slot has no row, as with a real executor.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "instance_id", "node_key", F.col("rollout_idx").cast("string")))
    part = lambda at: F.conv(F.substring(key, at, 4), 16, 10).cast("double") / 65536.0
    right = part(5) < correct_rate
    made = tasks.select("instance_id", "node_key", "rollout_idx", part(1).alias("_fail"), right.cast("int").alias("correct"), (F.floor(part(9) * max_steps) + 1).cast("int").alias("n_steps"))
    return made.filter(F.col("_fail") >= fail_rate).select("instance_id", "node_key", "rollout_idx", "correct", F.col("correct").cast("double").alias("reward"), "n_steps", F.lit("Submitted").alias("exit_status"))


def light_message(message: str = "message") -> dict[str, Column]:
    """The parts of a message (JSON text) that a stored trajectory keeps, and interrupt_type, each null where it isn't there."""
    top = {c: F.get_json_object(message, f"$.{c}") for c in ("role", "content", "tool_call_id")}
    extra = {c: F.get_json_object(message, f"$.extra.{c}") for c in (*LIGHT_EXTRA, "interrupt_type")}
    return top | extra


#: What a stored trajectory keeps of a message, and of its extra.
LIGHT_TOP, LIGHT_EXTRA = ("role", "content", "tool_call_id"), ("actions", "raw_output", "returncode", "exit_status", "submission", "exception_info")


def light_trajectory(df: DataFrame, keys: list[str], steps: str) -> DataFrame:
    """(keys, step_index from 1, message_index, LIGHT_TOP, LIGHT_EXTRA): one row a message of ``steps`` (JSON text of [{assistant, tail}]).

    message_index is 0 for the assistant message, then counts the tail.  Text that is encoded twice is decoded; unreadable text has no
    rows.  Values that are no text are given as JSON, null where they aren't there.
    """
    once = F.try_parse_json(steps)
    inner = F.when(F.ltrim(F.col(steps)).startswith('"'), F.try_variant_get(once, "$", "string")).otherwise(F.when(once.isNotNull(), F.col(steps)))
    readable = df.select(*keys, inner.alias("_text")).filter(F.try_parse_json("_text").isNotNull())
    one = readable.select(*keys, F.posexplode(F.from_json("_text", "array<struct<assistant: string, tail: array<string>>>")).alias("_s", "_step"))
    numbered = F.transform(F.coalesce("_step.tail", F.array().cast("array<string>")), lambda m, i: F.struct((i + 1).alias("at"), m.alias("text")))
    messages = one.select(*keys, (F.col("_s") + 1).alias("step_index"), F.explode(F.concat(F.array(F.struct(F.lit(0).alias("at"), F.col("_step.assistant").alias("text"))), numbered)).alias("_m"))
    parts = ", ".join(f"{c}: string" for c in LIGHT_TOP) + ", extra: struct<" + ", ".join(f"{c}: string" for c in LIGHT_EXTRA) + ">"
    read = messages.filter("_m.text IS NOT NULL").select(*keys, "step_index", F.col("_m.at").alias("message_index"), F.from_json("_m.text", f"struct<{parts}>").alias("_m"))
    return read.select(*keys, "step_index", "message_index", *[f"_m.{c}" for c in LIGHT_TOP], *[f"_m.extra.{c}" for c in LIGHT_EXTRA])


def template_hash(*texts: str) -> str:
    """One hash of texts in their order, with a zero byte between them."""
    return hashlib.sha1("\0".join(texts).encode()).hexdigest()
