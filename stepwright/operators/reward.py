"""Rewards of submitted code locations against gold.

A location is (file, class_name, function_name).  Matching is within one submission, so everything is
array expressions on the row: candidates are sorted deep to shallow and taken greedily by a fold that
carries the places already used.  The greedy order is part of the definition; it is not the optimum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwright.operators.steps import let

#: Credit of a match down to the file, the class, the function.
DEPTH_WEIGHTS = (0.2, 0.5, 1.0)
THRESHOLD = 0.6

# Lines of a git patch and of Python code.
HEADER = r"^(\+\+\+|---)\s+(?:[ab]/)?(/dev/null|.+)$"
HUNK = r"^@@[^@\n]*@@\s*(.*)$"
CLASS = r"^\s*class\s+([A-Za-z_]\w*)\s*[:\(]"
DEF = r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\("
#: Lines of which the others say nothing: file headers, heads of hunks, and code that may open a class or function.
TELLING = r"^(?:(?:\+\+\+|---)\s|@@|[-+ ]\s*(?:class|def|async)\s)"
DIFF_MARKS = ("diff --git", "+++ ", "@@ ")

_LOCATION = "array<struct<file:string,class_name:string,function_name:string>>"


def is_diff_like(text: str) -> Column:
    """Whether the first 2000 characters, white space at the start taken off, hold a mark of a patch."""
    head = F.substring(F.regexp_replace(text, r"^(?U)\s+", ""), 1, 2000)
    hit = F.lit(False)
    for mark in DIFF_MARKS:
        hit = hit | F.contains(head, F.lit(mark))
    return F.coalesce(hit, F.lit(False))


def locations(submission: str | Column) -> Column:
    """The locations of a submission, null if it isn't a JSON list of objects with a file that isn't blank
    and, where given, a class and a function that are strings."""
    parsed = F.try_parse_json(submission)
    items = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed.try_cast("array<variant>"))
    kind = lambda e, name: F.coalesce(F.schema_of_variant(F.try_variant_get(e, f"$.{name}", "variant")), F.lit("VOID"))
    text = lambda e, name: F.try_variant_get(e, f"$.{name}", "string")
    fine = lambda e: (
        F.schema_of_variant(e).startswith("OBJECT") & (kind(e, "file") == "STRING") & (F.coalesce(F.trim(text(e, "file")), F.lit("")) != "")
        & kind(e, "class_name").isin("VOID", "STRING") & kind(e, "function_name").isin("VOID", "STRING"))
    place = lambda e: F.struct(F.trim(text(e, "file")).alias("file"), text(e, "class_name").alias("class_name"), text(e, "function_name").alias("function_name"))
    return F.when(F.coalesce(F.forall(items, lambda e: F.coalesce(fine(e), F.lit(False))), F.lit(False)), F.transform(items, place))


def submission_reason(submission: str) -> Column:
    """Why a submission is refused: blank, not_a_list, bad_item, empty, duplicate; null if it is fine."""
    found, parsed = locations(submission), F.try_parse_json(submission)
    return (
        F.when(F.coalesce(F.trim(submission), F.lit("")) == "", "blank").when(~F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False)), "not_a_list")
        .when(found.isNull(), "bad_item").when(F.size(found) == 0, "empty").when(F.size(F.array_distinct(found)) < F.size(found), "duplicate")
    )


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def location_names(places: Column) -> Column:
    """files, modules (file:class, or file:function without class) and entities (file:class.function or file:function)."""
    module = lambda p: F.when(_given(p["class_name"]), F.concat(p["file"], F.lit(":"), p["class_name"])).when(_given(p["function_name"]), F.concat(p["file"], F.lit(":"), p["function_name"]))
    entity = lambda p: F.when(_given(p["function_name"]), F.when(_given(p["class_name"]), F.concat(p["file"], F.lit(":"), p["class_name"], F.lit("."), p["function_name"])).otherwise(F.concat(p["file"], F.lit(":"), p["function_name"])))
    side = lambda f: F.array_sort(F.array_distinct(F.filter(F.transform(places, f), lambda x: x.isNotNull())))
    return F.struct(side(lambda p: p["file"]).alias("files"), side(module).alias("modules"), side(entity).alias("entities"))


def set_f1(said: Column, true: Column, beta: float = 1.0) -> Column:
    """F-beta of two sets; 0 where nothing is true or nothing is right."""
    hit, b = F.size(F.array_intersect(said, true)).cast("double"), beta * beta
    return F.coalesce(F.try_divide((1 + b) * hit, F.size(F.array_distinct(said)) + b * F.size(F.array_distinct(true))), F.lit(0.0))


def three_level(said: Column, gold: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """Weighted sum of the F1 of files, modules and entities."""
    return sum((F.lit(w) * set_f1(said[c], gold[c]) for w, c in zip(weights, ("files", "modules", "entities"), strict=True)), F.lit(0.0))


def gold_triples(gold: Column) -> Column:
    """Gold as locations: entities, then modules that no entity covers (as classes), then files that nothing covers; each sorted."""
    path = lambda x: F.regexp_extract(x, r"(?s)^(.*):([^:]*)$", 1)
    name = lambda x: F.when(F.contains(x, F.lit(":")), F.regexp_extract(x, r"(?s)^(.*):([^:]*)$", 2)).otherwise(x)
    triple = lambda p, c, f: F.struct(p.alias("file"), c.cast("string").alias("class_name"), f.cast("string").alias("function_name"))

    def entity(e: Column) -> Column:
        cls, func = F.regexp_extract(name(e), r"(?s)^([^.]*)\.(.*)$", 1), F.regexp_extract(name(e), r"(?s)^([^.]*)\.(.*)$", 2)
        method = (cls != "") & (func != "")
        return triple(path(e), F.when(method, cls), F.when(method, func).otherwise(name(e)))

    def with_modules(ents: Column) -> Column:
        covered = lambda m: F.exists(ents, lambda x: (x["file"] == path(m)) & (x["class_name"].eqNullSafe(name(m)) | x["function_name"].eqNullSafe(name(m))))
        rest = F.filter(F.array_sort(gold["modules"]), lambda m: ~covered(m))
        return F.concat(ents, F.transform(rest, lambda m: triple(path(m), name(m), F.lit(None))))

    def with_files(both: Column) -> Column:
        rest = F.filter(F.array_sort(gold["files"]), lambda f: ~F.exists(both, lambda x: x["file"] == f))
        return F.concat(both, F.transform(rest, lambda f: triple(f, F.lit(None), F.lit(None))))

    return let(let(F.transform(F.array_sort(gold["entities"]), entity), with_modules), with_files)


def match_depth(p: Column, g: Column) -> Column:
    """How deep a location agrees with a gold one: 0 not at all, 1 file, 2 class, 3 as deep as a function."""
    same = lambda c: p[c].eqNullSafe(g[c])
    return (
        F.when(p["file"] != g["file"], 0)
        .when(_given(g["class_name"]), F.when(~same("class_name"), 1).when(_given(g["function_name"]), F.when(same("function_name"), 3).otherwise(2)).otherwise(2))
        .when(_given(g["function_name"]), F.when(same("function_name"), 3).otherwise(1)).otherwise(1)
    )


def gold_depth(g: Column) -> Column:
    return F.when(_given(g["function_name"]), 3).when(_given(g["class_name"]), 2).otherwise(1)


def _weight(depth: Column, weights: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in weights]), depth)


def matched(preds: Column, golds: Column, weights: tuple[float, ...] = DEPTH_WEIGHTS) -> Column:
    """The greedy one-to-one pairs (depth, pred, gold from 0): by weight, depth, pred and gold."""
    def pairs(p: Column, i: Column) -> Column:
        return F.transform(golds, lambda g, j: F.struct(match_depth(p, g).alias("depth"), i.alias("pred"), j.alias("gold")))

    found = F.filter(F.flatten(F.transform(preds, pairs)), lambda x: x["depth"] > 0)
    order = F.array_sort(F.transform(found, lambda x: F.struct((-_weight(x["depth"], weights)).alias("w"), (-x["depth"]).alias("d"), x["pred"].alias("pred"), x["gold"].alias("gold"), x["depth"].alias("depth"))))
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("preds"), none.alias("golds"), F.array().cast("array<struct<depth:int,pred:int,gold:int>>").alias("pairs"))

    def take(done: Column, x: Column) -> Column:
        used = F.array_contains(done["preds"], x["pred"]) | F.array_contains(done["golds"], x["gold"])
        pair = F.struct(x["depth"].alias("depth"), x["pred"].alias("pred"), x["gold"].alias("gold"))
        more = F.struct(F.array_append(done["preds"], x["pred"]).alias("preds"), F.array_append(done["golds"], x["gold"]).alias("golds"), F.array_append(done["pairs"], pair).alias("pairs"))
        return F.when(used, done).otherwise(more)

    return F.aggregate(order, start, take, lambda done: done["pairs"])


def layered(df: DataFrame, preds: str, golds: str, *, weights: tuple[float, ...] = DEPTH_WEIGHTS, threshold: float = THRESHOLD, strict: bool = True,
            normalised: bool = True, overpromise: float = 0.0, duplicate: float = 0.0) -> DataFrame:
    """``df`` with n_pred, n_gold, credit, exact_hits, penalty, reward = 2 C / (M + N) and correct.

    A match counts its depth's weight, over the weight of the gold's own depth if ``normalised``.
    ``overpromise`` is taken off for each class and function of an unmatched location, ``duplicate`` for one
    whose file or class was matched already.  With two golds or more, ``strict`` asks for half of them exact.
    """
    staged = df.withColumn("_pairs", matched(F.col(preds), F.col(golds), weights))
    at = lambda c, i: F.element_at(F.col(c), i + 1)
    credit = lambda x: _weight(x["depth"], weights) / (_weight(gold_depth(at(golds, x["gold"])), weights) if normalised else F.lit(1.0))
    total = F.aggregate("_pairs", F.lit(0.0), lambda s, x: s + credit(x))
    lonely = F.filter(F.transform(F.col(preds), lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~F.exists("_pairs", lambda y: y["pred"] == x["i"]))
    promised = F.aggregate(lonely, F.lit(0), lambda s, x: s + _given(x["p"]["class_name"]).cast("int") + _given(x["p"]["function_name"]).cast("int"))
    again = F.size(F.filter(lonely, lambda x: F.exists("_pairs", lambda y: at(preds, y["pred"])["file"] == x["p"]["file"])))
    penalty = F.lit(float(overpromise)) * promised + F.lit(float(duplicate)) * again
    m, n = F.size(preds), F.size(golds)
    exact = F.size(F.filter("_pairs", lambda x: x["depth"] == 3))
    out = staged.withColumn("n_pred", m).withColumn("n_gold", n).withColumn("exact_hits", exact).withColumn("penalty", penalty)
    out = out.withColumn("credit", F.greatest(F.lit(0.0), total - F.col("penalty")))
    empty = (F.col("n_pred") == 0) | (F.col("n_gold") == 0)
    out = out.withColumn("reward", F.when(empty, 0.0).otherwise(2 * F.col("credit") / (F.col("n_pred") + F.col("n_gold"))))
    gate = (F.col("n_gold") < 2) | (F.col("exact_hits") >= F.ceil(F.col("n_gold") / 2)) if strict else F.lit(True)
    return out.withColumn("correct", (F.col("reward") >= threshold) & gate).drop("_pairs")


def exit_reward(df: DataFrame, exit_status: str, submission: str, gold: Column, **options) -> DataFrame:
    """The layered reward by how a trajectory ended: 0 with a reason unless it submitted valid locations."""
    found = df.withColumn("_found", locations(submission)).withColumn("_golds", gold_triples(gold))
    none = F.array().cast(_LOCATION)
    ready = found.withColumn("_preds", F.when(F.col(exit_status) == "Submitted", F.coalesce("_found", none)).otherwise(none))
    reason = (
        F.when(~F.col(exit_status).eqNullSafe(F.lit("Submitted")), "not_submitted").when(F.col("_found").isNull(), "invalid_submission")
        .when(F.size("_found") == 0, "empty_locations").when(F.size("_golds") == 0, "empty_gold")
    )
    return layered(ready, "_preds", "_golds", **options).withColumn("reason", reason).drop("_found", "_preds", "_golds")


def unified_reward(df: DataFrame, exit_status: str, submission: str, gold: Column, mode: str = "layered", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``df`` with reward, correct and reason by either way of scoring: layered, or independent (the mean F1 of files, modules and
    entities). What isn't submitted, or has no valid locations, is 0 in both."""
    if mode == "layered":
        return exit_reward(df, exit_status, submission, gold, threshold=threshold, **options)
    if mode != "independent":
        raise ValueError(f"no such mode: {mode}")
    found = df.withColumn("_found", locations(submission))
    reason = F.when(~F.col(exit_status).eqNullSafe(F.lit("Submitted")), "not_submitted").when(F.col("_found").isNull(), "invalid_submission")
    score = three_level(location_names(F.col("_found")), gold, (1 / 3, 1 / 3, 1 / 3))
    out = found.withColumn("reason", reason).withColumn("reward", F.when(F.col("reason").isNull(), score).otherwise(0.0))
    return out.withColumn("correct", F.col("reward") >= threshold).drop("_found")


def patch_names(patch: Column) -> Column:
    """files, modules and entities named by a git patch, as sorted lists.

    The lines that can say something are read into events, and a fold carries the file and the class of the hunk so
    far.  A class given by a hunk's head or a line of it ends with the hunk.
    """
    lines = F.filter(F.split(F.coalesce(patch, F.lit("")), r"\r\n|\r|\n"), lambda x: x.rlike(TELLING))

    def read(x: Column) -> Column:
        hunk = x.rlike(HUNK)
        inside = F.when(x.rlike(r"^[-+ ]."), F.regexp_replace(x, r"^.\s*", ""))
        return F.struct(F.regexp_extract(x, HEADER, 1).alias("mark"), F.trim(F.regexp_extract(x, HEADER, 2)).alias("path"), hunk.alias("hunk"), F.when(hunk, F.regexp_extract(x, HUNK, 1)).otherwise(inside).alias("said"))

    def event(x: Column) -> Column:
        path = F.when((x["mark"] != "") & ~x["path"].isin("/dev/null", ""), x["path"])
        cls = F.coalesce(F.regexp_extract(x["said"], CLASS, 1), F.lit(""))
        func = F.when(cls == "", F.nullif(F.regexp_extract(x["said"], DEF, 1), F.lit("")))
        return F.struct((x["mark"] != "").alias("header"), path.alias("path"), F.when(x["mark"] == "+++", path).alias("start"), x["hunk"].alias("hunk"), cls.alias("cls"), func.alias("func"))

    def step(so_far: Column, x: Column) -> Column:
        live = ~x["header"] & so_far["file"].isNotNull()
        cls = F.when(x["start"].isNotNull(), F.lit(None)).when(live & (x["hunk"] | (x["cls"] != "")), F.nullif(x["cls"], F.lit(""))).otherwise(so_far["cls"])
        named = F.struct(so_far["file"].alias("file"), cls.alias("cls"), x["func"].alias("func"))
        found = F.when(live & x["func"].isNotNull(), F.concat(so_far["found"], F.array(named))).otherwise(so_far["found"])
        return F.struct(F.coalesce(x["start"], so_far["file"]).alias("file"), cls.alias("cls"), found.alias("found"))

    none = F.lit(None).cast("string")
    start = F.struct(none.alias("file"), none.alias("cls"), F.array().cast("array<struct<file:string,cls:string,func:string>>").alias("found"))
    names = lambda c: F.array_sort(F.array_distinct(c))

    def result(events: Column) -> Column:
        told = F.aggregate(events, start, step, lambda s: s["found"])
        return F.struct(
            names(F.filter(F.transform(events, lambda x: x["path"]), lambda x: x.isNotNull())).alias("files"),
            names(F.transform(told, lambda x: F.concat(x["file"], F.lit(":"), F.coalesce(x["cls"], x["func"])))).alias("modules"),
            names(F.transform(told, lambda x: F.concat(x["file"], F.lit(":"), F.concat_ws(".", x["cls"], x["func"])))).alias("entities"))

    return let(F.transform(F.transform(lines, read), event), result)


def diff_names(df: DataFrame, keys: list[str], patch: str) -> DataFrame:
    """(keys, files, modules, entities) of each row's patch; nothing is shuffled."""
    return df.select(*keys, patch_names(F.col(patch)).alias("_names")).select(*keys, "_names.files", "_names.modules", "_names.entities")
