import random

from pyspark.sql import functions as F

from stepwright.llm import splits


def brute(edges):
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        at[root(a)] = root(b)
    groups = {}
    for x in list(at):
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_components_equal_union_find_on_stars_chains_and_random_graphs(spark):
    rnd = random.Random(2)
    edges = [("hub", f"leaf{i}") for i in range(300)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    edges += [(f"r{rnd.randrange(90)}", f"r{rnd.randrange(90)}") for _ in range(60)] + [("p", "q"), ("q", "p"), ("s", "s"), ("p", None), (None, None)]
    got = {}
    for r in splits.components(spark.createDataFrame(edges, "a string, b string")).collect():
        assert r.vertex not in got
        got[r.vertex] = r.component
    groups = {}
    for v, c in got.items():
        groups.setdefault(c, set()).add(v)
    assert {frozenset(g) for g in groups.values()} == brute([(a, b) for a, b in edges if a and b and a != b])
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_repository_however_written(spark):
    written = ["mirrorlab/own__na-me.0df665d8", " MIRRORLAB/OWN__NA-ME.0DF665D8 ", "mirrorlab/own__na-me.0df665d8/", "mirrorlab/own__na-me.0df665d8.git", "mirrorlab/own__na-me",
               "https://code.example.org/own/na-me", "git@code.example.org:own/na-me.git", "Own/Na-Me.git", "own/na-me", "ssh://git@code.example.org:22/own/na-me/"]
    df = spark.createDataFrame([(w,) for w in written], "repo string").select(splits.repository("repo").alias("k"))
    assert {r.k for r in df.collect()} == {"own/na-me"}
    other = spark.createDataFrame([(w,) for w in ("fork/na-me", "", None, "nothing", "/", "a/", "a.b/c")], "repo string").select(splits.repository("repo").alias("k"))
    assert [r.k for r in other.collect()] == ["fork/na-me", None, None, None, None, None, "a.b/c"]


def rows_of(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        repo = "m/big__one" if rnd.random() < 0.33 else f"m/o__r{rnd.randrange(300)}"
        rows.append((i, f"{repo}-{rnd.randrange(8)}", repo + rnd.choice(["", ".git", ".0df665d8"]), rnd.choice(["train", " Dev", None])))
    return rows


def test_related_rows_stay_together_near_the_shares(spark):
    rows = rows_of(6000) + [(9001, None, None, None), (9002, None, "x/y", "train"), (9003, "lonely", None, "test"), (9003, "lonely", None, "test")]
    df = spark.createDataFrame(rows, "row_id bigint, instance_id string, repo string, split string").withColumn("assigned", F.lit(1))
    got = splits.assign_splits(df).collect()
    assert len(got) == len(rows) and all(r.assigned in splits.SHARES for r in got)
    by_row = {r.row_id: r.assigned for r in got}
    seen = {}
    for i, _, repo, _ in rows[:6000]:
        seen.setdefault(repo.split(".")[0], set()).add(by_row[i])
    assert all(len(s) == 1 for s in seen.values())
    share = {s: sum(r.assigned == s for r in got) / len(got) for s in splits.SHARES}
    assert all(abs(share[s] - w) < 0.02 for s, w in splits.SHARES.items())
    assert splits.assign_splits(df.limit(0)).count() == 0


def test_spread_repositories_against_brute_force(spark):
    rows = rows_of(400, 4) + [(801, None, "a/b", "train"), (802, "k", "a/b", " TEST "), (803, "only", "c/d", "train"), (804, "only", "c/d", "other"), (805, "n", None, "train"), (806, "n", None, "dev")]
    df = spark.createDataFrame(rows, "row_id bigint, instance_id string, repo string, split string")
    seen, members = {}, {}
    for _, i, repo, split in rows:
        key = repo and repo.replace("m/", "").replace("__", "/").split(".")[0]
        clean = (split or "").strip().lower()
        if key:
            members.setdefault(key, set()).add(i)
            seen.setdefault(key, set()).update({clean} & set(splits.SHARES))
    want = {i for k, s in seen.items() if len(s) > 1 for i in members[k] if i}
    assert {r.instance_id for r in splits.spread_over_splits(df).collect()} == want
    assert splits.spread_over_splits(df.limit(0)).count() == 0


def test_two_repositories_of_one_instance_are_not_one(spark):
    rows = [(1, "i", "a/b", "train"), (2, "i", "c/d", "dev"), (3, "j", "c/d", "dev")]
    df = spark.createDataFrame(rows, "row_id bigint, instance_id string, repo string, split string")
    assert splits.spread_over_splits(df).count() == 0
    assert len({r.assigned for r in splits.assign_splits(df).collect()}) == 1


def test_spread_comes_from_the_components(spark, monkeypatch):
    rows = [(1, "i", "a/b", "train"), (2, "j", "A/B.git", "dev"), (3, "k", "c/d", "dev")]
    df = spark.createDataFrame(rows, "row_id bigint, instance_id string, repo string, split string")
    assert {r.instance_id for r in splits.spread_over_splits(df).collect()} == {"i", "j"}
    ends = lambda edges: edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    monkeypatch.setattr(splits, "components", ends)  # no vertex is contracted into another
    assert splits.spread_over_splits(df).count() == 0
