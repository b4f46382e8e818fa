"""Trajectories as steps: segmentation, prefixes, content keys, canonical messages, prompts.

A trajectory is an ordered array of messages.  All of it is array expressions on the row that holds the
trajectory, so nothing is shuffled; only tables of one row a message or step use explode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that stand for one token where no tokenizer is given.
CHARS_PER_TOKEN = 3.5
UNIT, RECORD = "\u001f", "\u001e"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_exit(messages: str | Column) -> Column:
    """The messages before the first one of role exit."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    at = F.array_position(F.transform(messages, lambda m: F.coalesce(m["role"], F.lit(""))), "exit")
    return F.when(at > 0, F.slice(messages, 1, (at - 1).cast("int"))).otherwise(messages)


def split_steps(messages: str | Column) -> Column:
    """Steps as (assistant, tail): an assistant message and the tool and user messages up to the next one.

    What stands before the first assistant message, system messages and all from the first exit on are left out.
    """
    def cut(kept: Column) -> Column:
        places = F.transform(kept, lambda m, i: F.when(m["role"] == "assistant", i + 1))
        starts = F.coalesce(F.filter(places, lambda i: i.isNotNull()), F.array().cast("array<int>"))

        def step(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(kept) + 1))
            return F.zip_with(starts, F.slice(ends, 1, F.size(starts)), lambda a, b: F.struct(F.element_at(kept, a).alias("assistant"), F.slice(kept, a + 1, b - a - 1).alias("tail")))

        return let(starts, step)

    return let(F.filter(before_exit(messages), lambda m: m["role"].isin("assistant", "tool", "user")), cut)


def step_rows(df: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """One row a message of a step: (key, pos, step_index from 1, role), by a running count of assistant messages."""
    turns = df.select(key, F.posexplode(before_exit(messages)).alias("pos", "m")).filter(F.col("m.role").isin("assistant", "tool", "user"))
    step = F.sum((F.col("m.role") == "assistant").cast("int")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return turns.select(key, "pos", step.cast("int").alias("step_index"), F.col("m.role").alias("role")).filter("step_index > 0")


def prefix_messages(messages: str | Column, k: int) -> Column:
    """The messages before the (k+1)-th assistant message, k <= 0: before the first; exits at the end are dropped, none without assistant."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    index = F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i))
    at = F.element_at(F.concat(F.filter(index, lambda i: i.isNotNull()), F.array_repeat(F.size(messages), max(k, 0) + 1)), max(k, 0) + 1)
    some = F.exists(messages, lambda m: m["role"] == "assistant")
    cut = F.slice(messages, 1, at)
    last = F.array_max(F.transform(cut, lambda m, i: F.when(m["role"] != "exit", i + 1).otherwise(0)))
    return F.when(some & (at > 0), F.slice(cut, 1, F.coalesce(last, F.lit(0)))).otherwise(F.slice(messages, 1, 0))


def extract_exit(messages: str | Column, field: str = "content") -> Column:
    """``field`` of the last exit message, '' where there is none."""
    exits = F.filter(messages, lambda m: m["role"] == "exit")
    return F.coalesce(F.when(F.size(exits) > 0, F.element_at(exits, -1)[field]), F.lit(""))


def head_user(messages: str | Column) -> Column:
    """The content of the last user message of a head; an error where there is none."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    content = F.when(F.size(users) > 0, F.element_at(users, -1)["content"])
    return F.when(content.isNull(), F.raise_error(F.lit("a head needs a user message with text"))).otherwise(content)


def step_text(step: Column) -> Column:
    """A step as text with marks between messages and fields, the same wherever it is computed."""
    one = lambda m: F.concat_ws(UNIT, F.coalesce(m["role"], F.lit("")), F.coalesce(m["content"], F.lit("")), F.coalesce(m["tool_call_id"], F.lit("")))
    return F.array_join(F.concat(F.array(one(step["assistant"])), F.transform(step["tail"], one)), RECORD)


def prefix_keys(steps: Column) -> Column:
    """The content key of every prefix of the steps, the empty one first: root, then n_ and 16 hex digits."""
    hashed = lambda texts: F.transform(texts, lambda _, i: F.concat(F.lit("n_"), F.substring(F.sha1(F.array_join(F.slice(texts, 1, i + 1), "")), 1, 16)))
    return F.concat(F.array(F.lit("root")), let(F.transform(steps, step_text), hashed))


def flattened(steps: Column) -> Column:
    """The messages of the steps, in order."""
    return F.flatten(F.transform(steps, lambda s: F.concat(F.array(s["assistant"]), s["tail"])))


def leaf_chain(df: DataFrame, key: str, n_steps: str) -> DataFrame:
    """(key, step_index, label) of every prefix of a wrong leaf: 1 for all but the last, which is 0."""
    chain = df.filter(F.col(n_steps) > 0).select(key, n_steps, F.explode(F.sequence(F.lit(1), F.col(n_steps))).alias("step_index"))
    return chain.select(key, "step_index", F.when(F.col("step_index") == F.col(n_steps), 0.0).otherwise(1.0).alias("label"))


def canonical(messages: str | Column) -> Column:
    """Assistant, tool and user messages with null content as '', calls without a name dropped and no empty list of calls."""
    def calls(m: Column) -> Column:
        named = F.filter(m["tool_calls"], lambda c: F.coalesce(c["function"]["name"], F.lit("")) != "")
        return F.when(F.size(named) > 0, named)

    kept = F.filter(messages, lambda m: m["role"].isin("assistant", "tool", "user"))
    return F.transform(kept, lambda m: F.struct(
        m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), F.when(m["role"] == "assistant", m["reasoning_content"]).alias("reasoning_content"),
        F.when(m["role"] == "assistant", calls(m)).alias("tool_calls"), F.when(m["role"] == "tool", m["tool_call_id"]).alias("tool_call_id")))


def rendered_text(messages: str | Column) -> Column:
    """One text of all messages: role and content, reasoning, and a line a call."""
    def one(m: Column) -> Column:
        calls = F.transform(F.coalesce(m["tool_calls"], F.filter(m["tool_calls"], lambda _: F.lit(False))), lambda c: F.concat_ws(": ", c["function"]["name"], c["function"]["arguments"]))
        return F.concat_ws("\n", F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit(""))), F.nullif(m["reasoning_content"], F.lit("")), F.when(F.size(calls) > 0, F.array_join(calls, "\n")))

    return F.array_join(F.transform(messages, one), "\n")


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(CHARS_PER_TOKEN), 0).cast("int"))


def prompt(system: str, context: Column, trajectory: Column, instruction: str) -> Column:
    """[system, user context, trajectory, user instruction] as (role, content); the texts are the caller's."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    middle = F.transform(trajectory, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.concat(F.array(said("system", F.lit(system)), said("user", context)), middle, F.array(said("user", F.lit(instruction))))


def first_observations(df: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """Calls with the first tool message of their step that bears their id: (key, step_index, call_id, answered, observation)."""
    steps = df.select(key, F.posexplode(split_steps(messages)).alias("s", "step"))
    found = lambda c: F.get(F.filter(F.col("step.tail"), lambda m: (m["role"] == "tool") & (m["tool_call_id"] == c)), F.lit(0))
    calls = steps.select(key, (F.col("s") + 1).alias("step_index"), F.explode(F.transform(F.col("step.assistant.tool_calls"), lambda c: F.struct(c["id"].alias("id"), found(c["id"]).alias("answer")))).alias("c"))
    return calls.select(key, "step_index", F.col("c.id").alias("call_id"), F.col("c.answer").isNotNull().alias("answered"), F.col("c.answer.content").alias("observation"))


def exit_pair(messages: str | Column) -> Column:
    """(exit_status, submission) in the extra of the last exit message, '' each where there is none."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    last = lambda exits: F.when(F.size(exits) > 0, F.element_at(exits, -1)["extra"])
    return let(last(F.filter(messages, lambda m: m["role"] == "exit")), lambda x: F.struct(*[F.coalesce(x[c], F.lit("")).alias(c) for c in ("exit_status", "submission")]))
