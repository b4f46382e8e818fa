"""The best representative of each group of duplicate samples, field by field.

Samples are duplicates if they agree in instance, step and messages, whatever the amount of white
space and whether a blank is written as null.  The survivor is found by truth discovery: the label
sources start with a reliability by their trust; a value is supported by the reliability of all rows
that claim it; each source's reliability becomes the share of its claims that won; and so on until no
reliability moves by more than ``TOLERANCE``.  Nulls claim nothing, so the most complete values win;
ties go to the value of the best row.

The order of trust between known sources is given, so it holds for the reliabilities as well: after
each round a source is raised above those that are trusted less.  The row to keep is the one whose
source came out as the most reliable, of several the one with the most rollouts, then the latest.

Claims are counted per (group, field, value, source) before they move, so a group that holds a third
of all rows costs its distinct claims only, spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.session import cut_lineage

#: Fixed order of trust of the label sources; any other value counts as null.
TRUST = {"node_mc": 2, "leaf_chain": 1}
PRIOR = {"node_mc": 0.9, "leaf_chain": 0.7, "": 0.5}
TOLERANCE, MAX_SOURCES = 1e-3, 1_000
#: After FULL_ROUNDS the k-th further round moves by 1/k of the way only, so that votes that swing to and fro come to rest;
#: where they don't in MAX_ROUNDS, it is an error.
FULL_ROUNDS, MAX_ROUNDS = 10, 300
#: How much more reliable than a less trusted source a source is at least.
MARGIN = 1e-6
#: Weight of the prior, in claims.
PRIOR_CLAIMS = 20.0
FIELDS = ("repo", "split", "node_key", "step_count", "label", "label_binary", "label_soft", "mc_score", "n_rollouts", "visits", "in_pool", "rendered_tokens")


def squeezed(text: Column) -> Column:
    """A text without white space; null if nothing is left."""
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    return F.when(bare != "", bare)


def prefix_key(messages: str) -> Column:
    """A hash of the messages that is equal for those that differ only in white space or in null against blank."""
    call = lambda c: F.struct(squeezed(c["id"]).alias("i"), squeezed(c["type"]).alias("t"),
                              squeezed(c["function"]["name"]).alias("n"), squeezed(c["function"]["arguments"]).alias("a"))
    message = lambda m: F.struct(
        squeezed(m["role"]).alias("r"), squeezed(m["content"]).alias("c"), squeezed(m["reasoning_content"]).alias("g"),
        squeezed(m["tool_call_id"]).alias("i"), F.when(F.size(m["tool_calls"]) > 0, F.transform(m["tool_calls"], call)).alias("t"))
    return F.md5(F.coalesce(F.to_json(F.transform(messages, message)), F.lit("[]")))


def source_of(label_source: str) -> Column:
    """The label source without case and blanks, '' for null and unknown ones."""
    text = F.lower(F.regexp_replace(label_source, r"(?U)\s+", ""))
    return F.when(text.isin(*TRUST), text).otherwise("")


def _rank(source: Column) -> Column:
    rank = F.lit(0)
    for name, trust in TRUST.items():
        rank = F.when(source == name, trust).otherwise(rank)
    return rank


def _field(df: DataFrame, name: str) -> Column:
    """A field's value: splits without case and blanks, other texts trimmed, blank ones and rendered_tokens of 0 null."""
    if df.schema[name].dataType.simpleString() == "string":
        text = F.lower(F.regexp_replace(name, r"(?U)\s+", "")) if name == "split" else F.trim(name)
        return F.when(text != "", text)
    return F.nullif(F.col(name), F.lit(0)) if name == "rendered_tokens" else F.col(name)


def survivors(df: DataFrame, fields: tuple[str, ...] = FIELDS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """One row a group: group_row_id, keep_row_id, n_rows, instance_id, step_index, prefix, label_source and the fields' best values.

    keep_row_id is the row whose label source is the most reliable, then most n_rollouts, then latest built_at
    (nulls last each), then the smallest row_id; label_source is that row's.  Null instances or steps are
    equal to each other; null and empty messages too.  Single rows survive as they are (texts cleaned).
    Fields missing in ``df`` are left out, other columns are not read.
    """
    fields = tuple(f for f in fields if f in df.columns)
    null = F.lit("\u0000")
    place = F.struct(F.coalesce(F.col("n_rollouts").cast("bigint"), F.lit(-(2**62))).alias("n"),
                     F.coalesce(F.unix_micros(F.col("built_at").cast("timestamp")), F.lit(-(2**62))).alias("t"), (-F.col("row_id")).alias("r"))
    group = F.concat_ws("|", F.coalesce("instance_id", null), F.coalesce(F.col("step_index").cast("string"), null), prefix_key("messages"))
    rows = cut_lineage(df.select(
        "row_id", F.unhex(F.md5(group)).alias("_group"), "instance_id", "step_index", source_of("label_source").alias("_source"), place.alias("_place"),
        *[_field(df, f).alias(f"_{f}") for f in fields]))
    ends = [x for f in fields for x in (F.min(f"_{f}").alias(f"_low_{f}"), F.max(f"_{f}").alias(f"_high_{f}"))]
    sources = (*TRUST, "")
    base = rows.groupBy("_group").agg(
        F.min("row_id").alias("group_row_id"), *[F.max(F.when(F.col("_source") == s, F.col("_place"))).alias(f"_of_{s}") for s in sources], F.count(F.lit(1)).alias("n_rows"),
        F.min("instance_id").alias("instance_id"), F.min("step_index").alias("step_index"), *ends)
    # only fields of which a group has several values are voted on
    mask = F.lit(0)
    for i, f in enumerate(fields):
        mask = mask + F.when(F.col(f"_low_{f}") != F.col(f"_high_{f}"), 1 << i).otherwise(0)
    disputed = base.filter("n_rows > 1").select("_group", F.col("group_row_id").alias("_id"), mask.alias("_mask")).filter("_mask > 0")
    values = F.array(*[F.struct(F.lit(i).alias("field"), F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) > 0, F.col(f"_{f}").cast("string")).alias("value")) for i, f in enumerate(fields)])
    claims = rows.join(disputed, "_group").select("_id", "_source", F.struct(_rank(F.col("_source")).alias("trust"), "_place").alias("_order"), F.explode(F.filter(values, lambda v: v["value"].isNotNull())).alias("c"))
    counted = claims.groupBy("_id", "c.field", "c.value", "_source").agg(F.count(F.lit(1)).alias("n"), F.max("_order").alias("best"))
    by_value = cut_lineage(
        counted.groupBy("_id", "field", "value").agg(
            F.map_from_entries(F.collect_list(F.struct("_source", "n"))).alias("by"), F.max("best").alias("best"))
    )  # the map has at most as many entries as there are sources
    reliability = discover(by_value, max_rounds)
    truth = _winners(by_value, reliability).select("_id", "field", F.col("win.value").alias("value"))
    wide = truth.groupBy("_id").agg(F.lit(True).alias("_voted"), *[F.max(F.when(F.col("field") == i, F.col("value"))).alias(f"_vote_{f}") for i, f in enumerate(fields)])
    kinds = dict(df.dtypes)
    joined = base.join(wide.withColumnRenamed("_id", "group_row_id"), "group_row_id", "left")
    kept = F.greatest(*[F.when(F.col(f"_of_{s}").isNotNull(), F.struct(F.lit(reliability[s]).alias("reliability"), F.col(f"_of_{s}").alias("place"), F.lit(s).alias("source"))) for s in sources])
    joined = joined.withColumn("_kept", kept)
    return joined.select(
        "group_row_id", (-F.col("_kept.place.r")).alias("keep_row_id"), "n_rows", "instance_id", "step_index", F.lower(F.hex("_group")).alias("prefix"), F.nullif(F.col("_kept.source"), F.lit("")).alias("label_source"),
        *[F.coalesce(F.col(f"_vote_{f}").cast(kinds[f]), f"_low_{f}").cast(kinds[f]).alias(f) for f in fields])


def ranked(reliability: dict[str, float]) -> dict[str, float]:
    """The reliabilities with each source of TRUST above those that are trusted less, and these above unknown ones."""
    out, least = dict(reliability), 0.0
    for source in ("", *sorted(TRUST, key=TRUST.__getitem__)):
        out[source] = least = max(out.get(source, PRIOR[source]), least)
        least += MARGIN
    return out


def _winners(by_value: DataFrame, reliability: dict[str, float]) -> DataFrame:
    """The best supported value of each (group, field), with its claims."""
    weight = F.create_map(*[F.lit(x) for pair in reliability.items() for x in pair]) if reliability else F.create_map(F.lit(""), F.lit(0.0))
    support = F.aggregate(F.map_entries("by"), F.lit(0.0), lambda s, e: s + e["value"] * weight[e["key"]])
    win = F.max_by(F.struct("value", "by"), F.struct(F.round(support, 9).alias("support"), "best", "value"))
    return by_value.groupBy("_id", "field").agg(win.alias("win"), F.count(F.lit(1)).alias("n_values"))


def discover(by_value: DataFrame, max_rounds: int = MAX_ROUNDS) -> dict[str, float]:
    """The reliability of each source, by turns with the votes it weighs, until it stays.

    ``by_value`` has the disputed fields, which tell sources apart.  Per round one aggregate of a row a source
    reaches the driver; more than MAX_SOURCES sources raise, and so do reliabilities that still move after ``max_rounds``.
    """
    totals = by_value.select(F.explode("by").alias("source", "n")).groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    claimed = {r.source: r.n for r in totals}
    prior = PRIOR | {s: PRIOR.get(s, 0.5) for s in claimed}
    now = ranked(prior)
    for turn in range(max_rounds if claimed else 0):
        won = _winners(by_value, now).select(F.explode("win.by").alias("source", "n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
        wins = {r.source: r.n for r in won}
        told = {s: (wins.get(s, 0) + PRIOR_CLAIMS * prior[s]) / (claimed.get(s, 0) + PRIOR_CLAIMS) for s in now}
        part = 1.0 / max(1, turn - FULL_ROUNDS + 1)
        new = ranked({s: now[s] + part * (told[s] - now[s]) for s in now})
        moved, now = max(abs(new[s] - now[s]) for s in now), new
        if moved <= TOLERANCE:
            return now
    if claimed:
        raise RuntimeError(f"the reliabilities of the sources still move after {max_rounds} rounds")
    return now


def duplicate_groups(df: DataFrame) -> DataFrame:
    """(group_row_id, keep_row_id) of the groups of two rows or more."""
    return survivors(df).filter("n_rows > 1").select("group_row_id", "keep_row_id")
