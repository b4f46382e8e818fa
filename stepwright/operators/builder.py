"""The dataset of labelled steps from end to end: samples with their messages, in the window, with a manifest.

Keys and labels are worked out first (``samples``); only the prefixes of nodes that give samples are then
read, and each sample's messages are cut from its node's steps on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.operators import samples as D
from stepwright.operators import steps as S
from stepwright.operators import truncate as T
from stepwright.operators.steps import let

MESSAGE = (
    "struct<role: string, content: string, reasoning_content: string, "
    "tool_calls: array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>, tool_call_id: string>"
)
STEPS = f"array<struct<assistant: {MESSAGE}, tail: array<{MESSAGE}>>>"


def plain_json(text: str | Column) -> Column:
    """JSON text without the quotes of a second encoding; null where it can't be read."""
    text = F.col(text) if isinstance(text, str) else text
    once = F.try_parse_json(text)
    inner = F.when(F.ltrim(text).startswith('"'), F.try_variant_get(once, "$", "string")).otherwise(F.when(once.isNotNull(), text))
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def parsed_steps(prefix_json: str | Column) -> Column:
    """The steps of a stored prefix; null where it can't be read or is no list."""
    text = plain_json(prefix_json)
    return F.when(F.json_array_length(text).isNotNull(), F.from_json(text, STEPS))


def stored_steps(steps: Column) -> Column:
    """Steps as JSON text, which ``parsed_steps`` reads back to the same."""
    return F.to_json(steps)


def sorted_arguments(messages: str | Column) -> Column:
    """Messages with the arguments of their calls as JSON with sorted keys; what isn't JSON stays as it is."""
    sorted_json = lambda a: F.coalesce(F.to_json(F.try_parse_json(a)), a)
    call = lambda c: F.struct(c["id"].alias("id"), c["type"].alias("type"), F.struct(c["function"]["name"].alias("name"), sorted_json(c["function"]["arguments"]).alias("arguments")).alias("function"))
    return F.transform(messages, lambda m: F.struct(*[(F.transform(m[c], call) if c == "tool_calls" else m[c]).alias(c) for c in ("role", "content", "reasoning_content", "tool_calls", "tool_call_id")]))


def head_text(messages_head_json: str) -> Column:
    """The last user message's content of a stored head; null where there is none."""
    users = F.filter(F.from_json(plain_json(messages_head_json), "array<struct<role: string, content: string>>"), lambda m: m["role"] == "user")
    return F.when(F.size(users) > 0, F.element_at(users, -1)["content"])


def build_samples(nodes: DataFrame, rollouts: DataFrame, splits: DataFrame, trees: DataFrame, min_rollouts: int = 3) -> DataFrame:
    """The samples of ``samples.node_samples`` with sample_id, messages (the head's user message and the steps so far) and
    rendered_tokens; trees whose head has no user message give none."""
    keys = D.node_samples(nodes, rollouts, splits, trees, min_rollouts)
    heads = trees.select("instance_id", head_text("messages_head_json").alias("_head")).filter("_head IS NOT NULL").groupBy("instance_id").agg(F.max("_head").alias("_head"))
    prefixes = nodes.select("instance_id", "node_key", "prefix_json", F.xxhash64("prefix_json").alias("prefix_hash")).dropDuplicates(["instance_id", "node_key", "prefix_hash"])
    joined = keys.join(prefixes, ["instance_id", "node_key", "prefix_hash"]).join(heads, "instance_id")
    said = F.struct(F.lit("user").alias("role"), F.col("_head").alias("content"), *[F.lit(None).cast(t).alias(c) for c, t in (("reasoning_content", "string"), ("tool_calls", "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"), ("tool_call_id", "string"))])
    trajectory = S.canonical(S.flattened(F.transform(F.slice(parsed_steps("prefix_json"), 1, F.col("step_index")), lambda s: F.struct(s["assistant"].alias("assistant"), F.coalesce(s["tail"], F.array().cast(f"array<{MESSAGE}>")).alias("tail")))))
    out = joined.withColumn("messages", sorted_arguments(F.concat(F.array(said), trajectory)))
    out = out.withColumn("sample_id", D.sample_id()).withColumn("rendered_tokens", S.approx_tokens(S.rendered_text("messages")))
    return out.drop("prefix_json", "prefix_hash", "_head")


def built(samples: DataFrame) -> DataFrame:
    """One sample a prefix, by the trust of the source; the prefix is told by a hash of its messages."""
    keyed = samples.withColumn("prefix_key", F.sha1(F.to_json("messages")))
    return D.dedupe(keyed, ["instance_id", "prefix_key", "step_index"], ["node_key"])


def fitted(messages: str | Column, limit: int, mark: str = T.MARK, keep: int = 200) -> Column:
    """(outcome, n_dropped, messages) of a sample's messages in ``limit`` characters of rendered text.

    What stands before the first assistant message always stays, and so does the last step.  Whole steps go from
    the front, with a user message in their place that says ``mark``; n_dropped counts their messages.  If the rest is still
    too long, the contents of tools are clipped to ``keep`` characters.  Unfittable ones keep what is left then.
    """
    messages = F.col(messages) if isinstance(messages, str) else messages
    length = lambda m: F.length(S.rendered_text(F.array(m))) + 1
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda n, x: n + x)

    def planned(sized: Column) -> Column:
        sizes = F.transform(sized, lambda x: x["n"])
        starts = F.filter(F.transform(sized, lambda x, i: F.when(x["m"]["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
        head = F.when(F.size(starts) > 0, total(F.slice(sizes, 1, F.get(starts, F.lit(0)) - 1))).otherwise(total(sizes))
        rest = F.transform(starts, lambda s: F.struct(s.alias("at"), total(F.slice(sizes, s, F.size(sizes) - s + 1)).alias("n")))
        return F.struct(sized.alias("sized"), total(sizes).alias("n"), head.alias("head"), rest.alias("rest"))

    def cut(p: Column) -> Column:
        told = len(mark) + len("user: ") + 1
        fits = F.filter(p["rest"], lambda r: p["head"] + told + r["n"] <= limit)
        at = F.when(F.size(fits) > 0, F.get(fits, F.lit(0))["at"]).otherwise(F.element_at(p["rest"], -1)["at"])
        first = F.get(p["rest"], F.lit(0))["at"]
        whole = (p["n"] <= limit) | (F.size(p["rest"]) == 0)
        return F.struct(p["sized"].alias("sized"), p["n"].alias("n"), (p["head"] + told > limit).alias("floor"), (F.size(fits) > 0).alias("enough"), first.alias("first"), F.when(whole, first).otherwise(at).alias("at"))

    def dropped(c: Column) -> Column:
        all_ = F.transform(c["sized"], lambda x: x["m"])
        place = F.array(F.struct(F.lit("user").alias("role"), F.lit(mark).alias("content"), *[F.get(all_, F.lit(-1))[n].alias(n) for n in ("reasoning_content", "tool_calls", "tool_call_id")]))
        kept = F.when(c["at"] > c["first"], F.concat(F.slice(all_, 1, c["first"] - 1), place, F.slice(all_, c["at"], F.size(all_)))).otherwise(all_)
        clip = lambda m: F.struct(m["role"].alias("role"), F.when((m["role"] == "tool") & (F.length(m["content"]) > keep), T.tool_clip(m["content"], keep)).otherwise(m["content"]).alias("content"), *[m[n].alias(n) for n in ("reasoning_content", "tool_calls", "tool_call_id")])
        return F.struct(c.alias("c"), kept.alias("kept"), F.transform(kept, clip).alias("clipped"))

    def outcome(d: Column) -> Column:
        c = d["c"]
        size = total(F.transform(d["clipped"], length))
        name = F.when(c["n"] <= limit, "fits").when(c["floor"], "unfittable").when(c["enough"], "steps_dropped").when(size <= limit, "tools_clipped").otherwise("unfittable")
        text = lambda name: F.when(name.isin("fits", "steps_dropped"), d["kept"]).otherwise(d["clipped"])
        return let(name, lambda name: F.struct(name.alias("outcome"), F.coalesce(c["at"] - c["first"], F.lit(0)).alias("n_dropped"), text(name).alias("messages")))

    return let(let(let(let(F.transform(messages, lambda m: F.struct(m.alias("m"), length(m).alias("n"))), planned), cut), dropped), outcome)


def full_manifest(before: DataFrame, after: DataFrame, skipped: DataFrame, split: str, fingerprints: DataFrame) -> DataFrame:
    """(section, key, value) of a build: counts, labels, sources, dedupe, skipped nodes, weights, lengths and fingerprints of the input.

    ``before`` and ``after`` are the samples around the dedupe, ``skipped`` has (skip_reason, n), ``fingerprints`` (table_name, n, newest).
    """
    long = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    labels = D.label_distribution(after, split, "label", F.col("label") > 0.5)
    dedupe = D.dedupe_stats(before, after)
    weights = D.class_weights(after.filter(F.col(split) == "train").withColumn("_y", (F.col("label") > 0.5).cast("int")), "_y")
    lengths = D.length_stats(after, "rendered_tokens", split)
    parts = [long(labels, name, F.col(split), F.col(c)) for name, c in (("count", "n"), ("pos_rate", "pos_rate"), ("mean_label", "mean_label"))]
    parts += [long(after.groupBy(split, "label_source").agg(F.count(F.lit(1)).alias("n")), "source", F.concat_ws("/", split, "label_source"), F.col("n"))]
    parts += [long(dedupe, f"dedupe_{c}", F.col("label_source"), F.col(c)) for c in ("before", "after", "collisions")]
    parts += [long(skipped.filter("skip_reason IS NOT NULL"), "skipped", F.col("skip_reason"), F.col("n"))]
    parts += [long(weights, "weight", F.lit(c), F.col(c)) for c in ("w_pos", "w_neg")]
    parts += [long(lengths, f"length_{c}", F.col(split), F.col(c)) for c in ("p50", "p95", "max")]
    parts += [long(fingerprints, f"input_{c}", F.col("table_name"), F.col(c)) for c in ("n", "newest")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fingerprint(**tables: tuple[DataFrame, str]) -> DataFrame:
    """(table_name, n, newest) of tables, each given with the column that tells how new a row is."""
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.max(F.col(c).cast("double")).alias("newest")).select(F.lit(name).alias("table_name"), "n", "newest") for name, (df, c) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def checked(samples: DataFrame, before: list, after: list) -> DataFrame:
    """``samples``, or an error if there are none, or if the collected fingerprints of the input around the build differ."""
    if samples.isEmpty():
        raise ValueError("the build has no samples: look at the tables, the splits and the filters")
    if sorted(map(tuple, before)) != sorted(map(tuple, after)):
        raise RuntimeError("the input changed during the build")
    return samples
