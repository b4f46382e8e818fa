"""Search over rollout trees: which rollout to revise next, what to run, where the first error is.

A round advances all trees at once: each operator here is one plan over the state tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwright.operators import mc as M
from stepwright.operators import store as K
from stepwright.operators.ordered import hex_bucket, sums_before
from stepwright.session import written

ALPHA, BETA, MAX_LENGTH, EXPLORATION = 0.5, 0.9, 6, 0.125


def q_value(mc: Column, length: Column, alpha: float = ALPHA, beta: float = BETA, max_length: int = MAX_LENGTH) -> Column:
    """Prefers low success rates and short continuations."""
    return F.pow(F.lit(alpha), 1 - mc) * F.pow(F.lit(beta), F.coalesce(length, F.lit(0)) / F.lit(float(max(max_length, 1))))


def u_value(total_visits: Column, visits: Column, c: float = EXPLORATION) -> Column:
    """Prefers nodes that were visited less than the pool."""
    return F.lit(c) * F.sqrt(total_visits.cast("double")) / (1 + visits)


def qu_scores(nodes: DataFrame, rollouts: DataFrame, **q) -> DataFrame:
    """Every rollout that may be revised with its score: of a pooled node with a rate between 0 and 1, not consumed, without error."""
    pool = nodes.filter((F.col("node_key") == "root") | (F.col("in_pool") == 1))
    total = pool.groupBy("instance_id").agg(F.sum("visits").alias("total"))
    gated = pool.filter((F.col("mc_score") > 0) & (F.col("mc_score") < 1)).select("instance_id", "node_key", "mc_score", "visits").join(total, "instance_id")
    open_ = rollouts.filter((F.col("is_consumed") == 0) & F.col("exit_status").isNotNull()).select("instance_id", "node_key", "rollout_idx", "n_steps")
    return gated.join(open_, ["instance_id", "node_key"]).select("instance_id", "node_key", "rollout_idx", F.round(q_value(F.col("mc_score"), F.col("n_steps"), **q) + u_value(F.col("total"), F.col("visits")), 9).alias("qu"))


def qu_select(scores: DataFrame) -> DataFrame:
    """The best rollout of each tree; of equal ones the first node by key and the lowest index."""
    best = scores.groupBy("instance_id").agg(F.min(F.struct((-F.col("qu")).alias("q"), "node_key", "rollout_idx")).alias("b"))
    return best.select("instance_id", "b.node_key", "b.rollout_idx", (-F.col("b.q")).alias("qu"))


def missing_slots(nodes: DataFrame, rollouts: DataFrame, n: int) -> DataFrame:
    """(instance_id, node_key, slot) of each of the n slots of a node that has no rollout."""
    wanted = nodes.select("instance_id", "node_key").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    there = rollouts.select("instance_id", "node_key", F.col("rollout_idx").alias("slot")).distinct()
    return wanted.join(there, ["instance_id", "node_key", "slot"], "left_anti")


def slot_array(nodes: DataFrame, rollouts: DataFrame, n: int, value: str) -> DataFrame:
    """Each node's ``value`` by slot as an array of n, null where a slot is empty; of repeated slots the greatest value."""
    there = rollouts.filter(F.col("rollout_idx").between(0, n - 1)).groupBy("instance_id", "node_key", "rollout_idx").agg(F.max(value).alias("v"))
    maps = there.groupBy("instance_id", "node_key").agg(F.map_from_entries(F.collect_list(F.struct("rollout_idx", "v"))).alias("m"))  # at most n entries
    slots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(F.col("m"), i))
    return nodes.select("instance_id", "node_key").distinct().join(maps, ["instance_id", "node_key"], "left").select("instance_id", "node_key", slots.alias("slots"))


def allocate(requests: DataFrame, order: list[str], budget: int | None = None, per_instance: int | None = None) -> DataFrame:
    """How many of the n rollouts that each request asks for may be run: ``budget`` in all and ``per_instance``, in ``order``.

    Instances come in the order of the md5 of their ids; the running sum over their totals is taken in buckets
    of that order, so no task sees all instances.
    """
    own = Window.partitionBy("instance_id").orderBy(*order)
    before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    capped = requests.withColumn("_n", F.greatest(F.lit(0), F.least("n", F.lit(per_instance) - before)) if per_instance else F.col("n"))
    if budget is None:
        return capped.withColumn("allowed", F.col("_n").cast("bigint")).drop("_n")
    totals = capped.groupBy("instance_id").agg(F.sum("_n").alias("_t")).withColumn("_k", F.md5("instance_id"))
    starts = sums_before(totals, hex_bucket(F.col("_k")), ["_k", "instance_id"], {"_start": "_t"}).select("instance_id", "_start")
    used = F.coalesce(F.sum("_n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = capped.withColumn("_used", used).join(starts, "instance_id")
    return out.withColumn("allowed", F.greatest(F.lit(0), F.least("_n", F.lit(budget) - F.col("_start") - F.col("_used"))).cast("bigint")).drop("_n", "_used", "_start")


def task_order(tasks: DataFrame) -> DataFrame:
    """Tasks by priority and then by number, each id once (its first)."""
    first = tasks.groupBy("task_id").agg(F.min(F.struct("priority", "seq")).alias("t"))
    return first.select("task_id", "t.priority", "t.seq").orderBy("priority", "seq")


def start_bisection(sessions: DataFrame) -> DataFrame:
    """Sessions (session, base, length) before their first probe: the span of continuation steps still open."""
    return sessions.select("session", F.col("base").cast("int").alias("confirmed"), F.col("length").cast("int").alias("span"))


def probes(state: DataFrame) -> DataFrame:
    """The prefix length that each open session probes next: what is confirmed and the left half of the span."""
    return state.filter("span >= 2").withColumn("probe", F.col("confirmed") + F.expr("span div 2").cast("int"))


def advance(probed: DataFrame, mc: str = "mc") -> tuple[DataFrame, DataFrame]:
    """(events, next state) of sessions whose probes have a rate: solved ends one, a rate between extends it to the
    right half and expands, 0 is a leaf and goes on in the left half."""
    half = F.expr("span div 2").cast("int")
    events = probed.filter(F.col(mc) < 1).select("session", "probe", F.when(F.col(mc) > 0, "expanded").otherwise("leaf").alias("kind"))
    onward = probed.filter(F.col(mc) < 1).select("session", F.when(F.col(mc) > 0, F.col("probe")).otherwise(F.col("confirmed")).alias("confirmed"),
                                                 F.when(F.col(mc) > 0, F.col("span") - half).otherwise(half).alias("span"))
    return events, onward


def bisect(sessions: DataFrame, rates: DataFrame) -> DataFrame:
    """(session, probe, kind) of every probe that expanded or was a leaf.

    ``rates`` (session, probe, mc) has the rates of the prefixes that can be asked for; where one is missing
    the session waits, that is, ends here.  Each round is one join for all sessions; a span at least falls by one
    in a round, and to its half in all but two of them, so the rounds end.
    """
    state, found = start_bisection(sessions), []
    while True:
        asked = written(probes(state).join(rates, ["session", "probe"]))
        if asked.isEmpty():
            break
        events, state = advance(asked)
        found.append(events)
    out = sessions.sparkSession.createDataFrame([], "session string, probe int, kind string")
    for events in found:
        out = out.unionByName(events.withColumn("session", F.col("session").cast("string")))
    return out


def consume(nodes: DataFrame, rollouts: DataFrame, trees: DataFrame, picked: DataFrame, expanded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The state after the sessions of ``picked`` (instance_id, node_key, rollout_idx; each once): the rollout is consumed, its node
    visited once more, expanded nodes are in the pool, and a round is counted for each session that revised no root."""
    node, slot = ["instance_id", "node_key"], ["instance_id", "node_key", "rollout_idx"]
    chosen = picked.select(*slot).withColumn("_hit", F.lit(1))
    more = chosen.groupBy(*node).agg(F.count(F.lit(1)).cast("int").alias("_more"))
    n = nodes.join(more, node, "left").join(expanded.select(*node).distinct().withColumn("_new", F.lit(1)), node, "left")
    n = n.withColumn("visits", F.col("visits") + F.coalesce("_more", F.lit(0))).withColumn("in_pool", F.coalesce("_new", "in_pool"))
    r = rollouts.join(chosen, slot, "left").withColumn("is_consumed", F.coalesce("_hit", "is_consumed"))
    rounds = picked.filter("node_key <> 'root'").groupBy("instance_id").agg(F.count(F.lit(1)).cast("int").alias("_rounds"))
    t = trees.join(rounds, "instance_id", "left").withColumn("n_rounds", F.col("n_rounds") + F.coalesce("_rounds", F.lit(0)))
    return n.select(*nodes.columns), r.select(*rollouts.columns), t.select(*trees.columns)


def annotate(trees: DataFrame, nodes: DataFrame, rollouts: DataFrame, expand: Callable[[DataFrame], DataFrame], max_rounds: int = 20, most_sessions: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The search loop: per round, every unfinished tree revises its best rollout once.

    ``expand`` gets the picked rollouts and gives the nodes (instance_id, node_key) that their sessions
    expanded, running whatever executor it needs.  Trees at ``max_rounds`` only revise their root.  The state
    is written out after each round, so a lost executor costs that round only.  Each round consumes a rollout of every
    tree that goes on, so it ends; ``most_sessions`` ends it sooner.
    """
    turn = 0
    while most_sessions is None or turn < most_sessions:
        turn += 1
        picked = written(qu_select(_selectable(trees, nodes, rollouts, max_rounds)))
        if picked.isEmpty():
            break
        nodes, rollouts, trees = (written(df) for df in consume(nodes, rollouts, trees, picked, expand(picked)))
    return trees, nodes, rollouts


def resumed(trees: DataFrame, nodes: DataFrame, rollouts: DataFrame) -> DataFrame:
    """The pool of every unfinished tree as it is taken up again: its root and pooled nodes with the rate of their rollouts
    (mc over those with an outcome, 0 without any, null without rollouts), visits, and how many rollouts are consumed and open."""
    live = trees.filter("status NOT IN ('done', 'failed')").select("instance_id").distinct()
    rates = M.mc_valid(rollouts).join(
        rollouts.groupBy(*M.KEYS).agg(F.count_if(F.col("is_consumed") == 1).alias("n_consumed"), F.count_if((F.col("is_consumed") == 0) & F.col("exit_status").isNotNull()).alias("n_open")), M.KEYS)
    pool = nodes.filter((F.col("node_key") == "root") | (F.col("in_pool") == 1)).select(*M.KEYS, "visits").join(live, "instance_id")
    return pool.join(rates, M.KEYS, "left").select(*M.KEYS, "visits", "mc", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_valid", "n_consumed", "n_open")])


def _selectable(trees: DataFrame, nodes: DataFrame, rollouts: DataFrame, max_rounds: int) -> DataFrame:
    """The scored rollouts that unfinished trees may still revise; trees at ``max_rounds`` only those of their root."""
    running = trees.filter("status NOT IN ('done', 'failed')").select("instance_id", F.col("n_rounds").alias("_rounds"))
    live = qu_scores(nodes, rollouts).join(running, "instance_id").filter((F.col("_rounds") < max_rounds) | (F.col("node_key") == "root"))
    return live.drop("_rounds")


def statuses(trees: DataFrame, nodes: DataFrame, rollouts: DataFrame, budget_left: bool, max_rounds: int = 20) -> DataFrame:
    """(instance_id, status, n_rounds, root_mc) of each tree by what its rollouts say; finished trees keep their status."""
    roots = M.mc_valid(rollouts.filter("node_key = 'root'")).select("instance_id", F.col("mc").alias("_mc"), "n_valid")
    work = _selectable(trees, nodes, rollouts, max_rounds).select("instance_id").distinct().withColumn("_work", F.lit(True))
    joined = trees.select("instance_id", "status", "n_rounds").join(roots, "instance_id", "left").join(work, "instance_id", "left")
    valid = F.coalesce("n_valid", F.lit(0)) > 0
    mc = F.when(valid, F.col("_mc"))
    new = tree_transition(mc, valid, F.col("_work").isNotNull(), F.lit(budget_left))
    return joined.select("instance_id", F.when(F.col("status").isin("done", "failed"), F.col("status")).otherwise(new).alias("status"), "n_rounds", mc.alias("root_mc"))


def pipeline(trees: DataFrame, nodes: DataFrame, rollouts: DataFrame, execute: Callable[[DataFrame], DataFrame], expand: Callable[[DataFrame], DataFrame], n_slots: int = 5, budget: int | None = None,
             max_rounds: int = 20, most_sessions: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All trees from where they stand to an end: done, failed, or budget_exhausted, from which another call goes on.

    ``execute`` gets the missing slots (instance_id, node_key, rollout_idx) of the roots, ``budget`` of them at most, and gives rows
    of ``rollouts`` (a slot that fails has none); ``expand`` is that of ``annotate``. Trees are
    (instance_id, status, n_rounds), nodes as in ``qu_scores``. After ``most_sessions`` rounds of sessions, work that is left waits.
    """
    live = trees.filter("status NOT IN ('done', 'failed')").select("instance_id").distinct()
    wanted = missing_slots(nodes.filter("node_key = 'root'").join(live, "instance_id"), rollouts, n_slots).withColumnRenamed("slot", "rollout_idx")
    allowed = allocate(wanted.groupBy(*M.KEYS).agg(F.count(F.lit(1)).alias("n")), ["node_key"], budget)
    place = F.row_number().over(Window.partitionBy(*M.KEYS).orderBy("rollout_idx"))  # n_slots at most
    tasks = wanted.withColumn("_at", place).join(allowed, M.KEYS).filter("_at <= allowed").select(*M.KEYS, "rollout_idx")
    rollouts = written(K.upsert(rollouts, execute(written(tasks))))
    nodes = nodes.drop("mc_score").join(M.mc_valid(rollouts).select(*M.KEYS, F.col("mc").alias("mc_score")), M.KEYS, "left").select(*nodes.columns)
    trees = written(statuses(trees, nodes, rollouts, True, max_rounds))
    done, nodes, rollouts = annotate(trees, written(nodes), rollouts, expand, max_rounds, most_sessions)
    return written(statuses(done, nodes, rollouts, False, max_rounds)), nodes, rollouts


def tree_transition(root_mc: Column, valid_root: Column, open_work: Column, budget_left: Column) -> Column:
    """The status of a tree: failed without a valid root rollout, exhausted if work is open but no budget left, done without work."""
    return F.when(~valid_root, "failed").when(open_work & ~budget_left, "budget_exhausted").when(open_work & root_mc.isNotNull(), "running").otherwise("done")


def resolve_head(trees: DataFrame, rollouts: DataFrame, head: Column) -> DataFrame:
    """The head of each tree: of its first rollout that has one, else the stored one, else none."""
    first = rollouts.withColumn("_h", head).filter("_h IS NOT NULL").groupBy("instance_id").agg(F.min_by("_h", F.struct("rollout_idx", "_h")).alias("_h"))
    return trees.select("instance_id", "messages_head_json").join(first, "instance_id", "left").select("instance_id", F.coalesce("_h", "messages_head_json").alias("head"))
