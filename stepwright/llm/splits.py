"""Splits that keep related records together.

Records are related through what they share: a sample belongs to an instance and to a repository,
however that is written.  The connected components of this graph are found by random-mate
contraction: in each round the vertices toss coins, a vertex with tails collapses into a neighbour
with heads, and edges are rewritten to the survivors until none is left.  Vertices with one edge need
no toss: they collapse into their neighbour at the start of a round, so a hub loses all its leaves at
once.  The merges are then unwound into labels, and whole components are assigned to splits by their
cumulative weight.

All of it is joins and aggregations; of the graph only the number of edges left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwright.session import cut_lineage

SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}
#: Components of at least this share of all rows are placed first, in train as far as it has room.
HEAVY_SHARE = 0.01
#: Components of about this many are in a bucket of the running sum.
_BUCKET_ROWS = 20_000


def clean_split(split: str | Column) -> Column:
    """train, dev or test, read without case and blanks; anything else is null."""
    text = F.lower(F.regexp_replace(split, r"(?U)\s+", ""))
    return F.when(text.isin(*SHARES), text)


def _bits(split: str) -> Column:
    """1 for train, 2 for dev, 4 for test, 0 for anything else."""
    split = clean_split(split)
    return F.when(split == "train", 1).when(split == "dev", 2).when(split == "test", 4).otherwise(0)


def repository(repo: str | Column) -> Column:
    """owner/name in lower case, whatever address, mirror or snapshot it is written as; null if there is none.

    ``mirror/owner__name.commit8`` and ``https://host/owner/name.git`` both name owner/name.
    """
    text = F.lower(F.trim(F.regexp_replace(repo, r"(?U)\s+", " ")))
    text = F.regexp_replace(text, r"^(?:[a-z+]+://)?(?:[^/@]*@)?(?:[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::\d+(?=/))?[:/](?=[^/]+/[^/]))?", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^/+|/+$", ""), r"\.git$", "")
    owner, name = F.regexp_extract(text, r"^([^/]+)/[^/]+", 1), F.regexp_extract(text, r"^[^/]+/([^/]+)", 1)
    name = F.regexp_replace(F.regexp_replace(name, r"\.git$", ""), r"\.[0-9a-f]{8}$", "")
    mirrored = F.regexp_extract(name, r"^(.+?)__(.+)$", 1)
    owner = F.when(mirrored != "", mirrored).otherwise(owner)
    name = F.when(mirrored != "", F.regexp_extract(name, r"^(.+?)__(.+)$", 2)).otherwise(name)
    return F.when((owner != "") & (name != ""), F.concat_ws("/", owner, name))


def components(edges: DataFrame, seed: int = 17, max_rounds: int = 200) -> DataFrame:
    """(vertex, component) of every vertex with an edge in ``edges`` (a, b); the component is one of its vertices.

    Null ends and loops are no edges.  Raises if edges are left after ``max_rounds``.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    left = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    merges: list[DataFrame] = []
    for turn in range(max_rounds):
        degree = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg((F.count(F.lit(1)) == 1).alias("leaf"))
        sided = left.join(degree.withColumnRenamed("leaf", "leaf_a"), "a").join(degree.select(F.col("a").alias("b"), F.col("leaf").alias("leaf_b")), "b")
        sided = cut_lineage(sided.select("a", "b", "leaf_a", "leaf_b"))
        # a leaf collapses into its only neighbour without a toss; of an edge by itself, the smaller end into the greater
        ends = F.when(F.col("leaf_a"), F.struct("a", F.col("b").alias("into"))).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("into")))
        merges.append(sided.filter("leaf_a OR leaf_b").select(ends.alias("e")).select("e.a", "e.into"))
        rest = sided.filter("NOT leaf_a AND NOT leaf_b").select("a", "b")
        if rest.isEmpty():
            return _unwound(merges, edges)
        heads = lambda v: F.xxhash64(F.lit(seed), F.lit(turn), v) >= 0  # noqa: E731, B023
        both = rest.unionAll(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        merged = cut_lineage(both.filter(~heads(F.col("a")) & heads(F.col("b"))).groupBy("a").agg(F.max("b").alias("into")))
        merges.append(merged)
        moved = rest.join(merged.select("a", F.col("into").alias("into_a")), "a", "left").join(
            merged.select(F.col("a").alias("b"), F.col("into").alias("into_b")), "b", "left")
        moved = moved.select(F.coalesce("into_a", "a").alias("a"), F.coalesce("into_b", "b").alias("b")).filter("a <> b")
        left = cut_lineage(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    raise RuntimeError(f"edges are left after {max_rounds} rounds")


def _unwound(merges: list[DataFrame], edges: DataFrame) -> DataFrame:
    """Labels of all vertices, from the merges of the last round back to the first."""
    if not merges:
        return edges.sparkSession.createDataFrame([], "vertex string, component string")
    last = merges[-1].select(F.col("a").alias("vertex"), F.col("into").alias("component"))
    labels = last
    for merged in reversed(merges[:-1]):
        later = labels.select(F.col("vertex").alias("into"), "component")
        labels = labels.unionByName(merged.join(later, "into", "left").select(F.col("a").alias("vertex"), F.coalesce("component", "into").alias("component")))
        labels = cut_lineage(labels)
    roots = labels.select(F.col("component").alias("vertex"), "component").distinct()
    return labels.unionByName(roots)


def related(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct (instance_id, repo) of ``df`` with their repository and rows, and the component of each vertex.

    An instance is the vertex ``i:<instance_id>``, a repository ``r:<owner/name>``.
    """
    pairs = df.groupBy("instance_id", "repo").agg(F.count(F.lit(1)).alias("n_rows"))
    pairs = cut_lineage(pairs.withColumn("repository", repository("repo")))
    vertices = pairs.select("*", F.concat(F.lit("i:"), "instance_id").alias("i"), F.concat(F.lit("r:"), "repository").alias("r"))
    return vertices, components(vertices.select(F.col("i").alias("a"), F.col("r").alias("b")))


def assign_splits(df: DataFrame, row_id: str = "row_id", shares: dict[str, float] = SHARES, heavy_share: float = HEAVY_SHARE, seed: int = 17) -> DataFrame:
    """(row_id, component, assigned) of every row; rows of a component are in one split.

    Rows without instance and repository are components of their own.  Components of ``heavy_share`` or
    more of all rows come first in the order of weight, the others in an order by hash; the cumulative
    weight of all is cut at the shares, so the proportions are met up to one ordinary component, as
    long as heavy components fit into the first share.  Repeated row ids give repeated rows.
    """
    vertices, labels = related(df)
    own = F.coalesce("i", "r")
    labelled = vertices.withColumn("vertex", own).join(labels, "vertex", "left").withColumn("component", F.coalesce("component", own))
    labelled = cut_lineage(labelled.select("instance_id", "repo", "n_rows", "component"))
    single = df.filter("instance_id IS NULL").withColumn("_r", repository("repo")).filter("_r IS NULL")
    weights = labelled.filter("component IS NOT NULL").groupBy("component").agg(F.sum("n_rows").alias("weight"))
    weights = weights.unionByName(single.select(F.concat(F.lit("row:"), F.col(row_id).cast("string")).alias("component"), F.lit(1).cast("bigint").alias("weight")).groupBy("component").agg(F.sum("weight").alias("weight")))
    placed = _placed(cut_lineage(weights), shares, heavy_share, seed)
    by_pair = labelled.filter("component IS NOT NULL").join(placed, "component").select("instance_id", "repo", "component", "assigned")
    rows = df.select(row_id, F.col("instance_id").alias("_i"), F.col("repo").alias("_p"), repository("repo").alias("_r"))
    known = rows.filter("_i IS NOT NULL OR _r IS NOT NULL").join(
        by_pair, F.col("_i").eqNullSafe(F.col("instance_id")) & F.col("_p").eqNullSafe(F.col("repo")))
    alone = rows.filter("_i IS NULL AND _r IS NULL").withColumn("component", F.concat(F.lit("row:"), F.col(row_id).cast("string"))).join(placed, "component")
    return known.select(row_id, "component", "assigned").unionByName(alone.select(row_id, "component", "assigned"))


def _placed(weights: DataFrame, shares: dict[str, float], heavy_share: float, seed: int) -> DataFrame:
    """(component, assigned) by cumulative weight.

    The running sum is taken in two levels: within hash buckets of about ``_BUCKET_ROWS`` components, and over
    the sums of the buckets, so no task sees all components.
    """
    total, n = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = n // _BUCKET_ROWS + 1
    names, heavy = list(shares), F.col("weight") >= F.lit(heavy_share) * F.lit(total)
    # heavy components are at most 1 / heavy_share; their order is by weight
    hashed = F.xxhash64(F.lit(seed), "component")
    heavies = weights.filter(heavy).orderBy(F.desc("weight"), "component").collect()
    room, taken = {n: shares[n] * total for n in names}, dict.fromkeys(names, 0)
    fixed = []
    for row in heavies:
        name = max(names, key=lambda n: (room[n] - taken[n], -names.index(n)))
        taken[name] += row.weight
        fixed.append((row.component, name))
    spark = weights.sparkSession
    placed = spark.createDataFrame(fixed, "component string, assigned string")
    light_total = total - sum(r.weight for r in heavies)
    gaps = [max(0.0, room[n] - taken[n]) for n in names]
    scale = light_total / sum(gaps) if sum(gaps) else 0.0
    light = weights.filter(~heavy).withColumn("_h", hashed).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(buckets)))
    sums = light.groupBy("_b").agg(F.sum("weight").alias("_sum"))
    before = sums.select("_b", (F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_sum")).alias("_before"))
    inside = F.sum("weight").over(Window.partitionBy("_b").orderBy("_h", "component").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("_before") + F.col("_in") - F.col("weight") / 2
    choice, edge = F.lit(names[-1]), [sum(gaps[: i + 1]) * scale for i in range(len(names))]
    for i in range(len(names) - 2, -1, -1):
        choice = F.when(middle < F.lit(edge[i]), F.lit(names[i])).otherwise(choice)
    spread = light.withColumn("_in", inside).join(F.broadcast(before), "_b")  # a row a bucket
    return placed.unionByName(spread.select("component", choice.alias("assigned")))


def spread_over_splits(df: DataFrame) -> DataFrame:
    """Instances whose repository has rows in more than one of train, dev and test (in the column split).

    Here the relation is the repository alone: each way in which it is written is an edge from that text to the
    repository it names, and each instance under such a text one to the text (rows without an instance are the text's own).  An instance that is written under two
    repositories is a vertex in each, so it doesn't link them.  The splits are gathered by component.
    """
    # cut before the repository is read out of the text, or that were done for every row of df
    rows = cut_lineage(df.groupBy("instance_id", "repo").agg(F.bit_or(_bits("split")).alias("splits")))
    rows = rows.withColumn("r", F.concat(F.lit("r:"), repository("repo"))).filter("r IS NOT NULL")
    text = F.concat(F.lit("w:"), "repo")
    own = F.concat(F.lit("i:"), F.length("repo").cast("string"), F.lit(":"), "repo", "instance_id")  # null without an instance
    rows = cut_lineage(rows.select("instance_id", "splits", text.alias("w"), "r", F.coalesce(own, text).alias("vertex")))
    edges = rows.select(F.col("vertex").alias("a"), F.col("w").alias("b")).unionByName(rows.select(F.col("w").alias("a"), F.col("r").alias("b")))
    placed = rows.select("instance_id", "splits", "vertex").join(components(edges), "vertex")
    mixed = placed.groupBy("component").agg(F.bit_or("splits").alias("all_splits")).filter(F.bit_count("all_splits") > 1)
    return placed.join(mixed.select("component"), "component", "left_semi").filter("instance_id IS NOT NULL").select("instance_id").distinct()
