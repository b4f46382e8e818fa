"""Quality rules, repository names and statistics of issue instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepwright.operators.ordered import sums_before, value_bucket

REQUIRED = ("instance_id", "repo", "problem_statement", "patch")

# An instance id's characters, and the lines by which a git patch creates or deletes a file.
INSTANCE_ID = r"^[A-Za-z0-9_.-]+$"
CREATED = r"(?md)^new file mode"
DELETED = r"(?md)^deleted file mode"
DEV_NULL = r"(?md)^(---|\+\+\+) /dev/null\b"


def require_columns(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``df``, if it has all of ``columns``; else a ValueError that names the missing ones."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def creates_or_deletes_files(patch: str | Column) -> Column:
    patch = F.coalesce(F.col(patch) if isinstance(patch, str) else patch, F.lit(""))
    return patch.rlike(CREATED) | patch.rlike(DELETED) | patch.rlike(DEV_NULL)


def is_python_path(value: str | Column) -> Column:
    """Whether the part before the first colon is a Python file or lies in something named like one."""
    path = F.lower(F.trim(F.substring_index(value, ":", 1)))
    return path.endswith(".py") | path.endswith(".pyi") | path.contains(".py/")


def parse_repo(repo: str) -> tuple[Column, Column, Column]:
    """(owner, name, commit8) of owner/name.commit8; owner is '' where there is no slash, commit8 null where it isn't given."""
    text = F.trim(F.col(repo))
    text = F.when(text.endswith(".git"), F.expr(f"left(trim({repo}), length(trim({repo})) - 4)")).otherwise(text)
    slash = F.instr(text, "/")
    rest = F.when(slash > 0, F.substring(text, slash + 1, F.length(text))).otherwise(text)
    commit = F.nullif(F.regexp_extract(rest, r"\.([0-9a-fA-F]{8})$", 1), F.lit(""))
    return F.when(slash > 0, F.substring_index(text, "/", 1)).otherwise(F.lit("")), F.when(commit.isNull(), rest).otherwise(F.regexp_replace(rest, r"\.[0-9a-fA-F]{8}$", "")), commit


def repo_url(owner: Column, name: Column, host: str = "https://github.com") -> Column:
    return F.concat(F.lit(f"{host}/"), owner, F.lit("/"), name)


def as_list(text: Column) -> Column:
    """A list of texts from what stands in its place: JSON text of a list, one value, or nothing."""
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (F.trim(text) == ""), none).otherwise(F.coalesce(F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")), F.array(text)))


def gold_struct(gold: str) -> Column:
    """Gold JSON as sorted, distinct lists of files, modules and entities; null JSON is empty."""
    parsed = F.from_json(gold, "files array<string>, modules array<string>, entities array<string>")
    side = lambda c: F.array_sort(F.array_distinct(F.coalesce(parsed[c], as_list(F.get_json_object(gold, f"$.{c}"))))).alias(c)
    return F.struct(side("files"), side("modules"), side("entities"))


def extract_gold(file_changes: str, python_only: bool = True, added_modules: bool = True, added_entities: bool = True) -> Column:
    """Gold of nested file changes: the files, and the edited (and added) modules and entities, as sorted distinct lists."""
    none = F.array().cast("array<string>")
    changes = F.filter(F.coalesce(F.col(file_changes), F.array().cast("array<struct<file:string,changes:struct<edited_modules:array<string>,added_modules:array<string>,edited_entities:array<string>,added_entities:array<string>>>>")), lambda c: c.isNotNull())
    keep = (lambda x: x.isNotNull() & (x != "") & is_python_path(x)) if python_only else (lambda x: x.isNotNull() & (x != ""))

    def side(*keys: str) -> Column:
        lists = F.flatten(F.transform(changes, lambda c: F.concat(*[F.coalesce(c["changes"][k], none) for k in keys])))
        return F.array_sort(F.array_distinct(F.filter(lists, keep)))

    files = F.array_sort(F.array_distinct(F.filter(F.transform(changes, lambda c: c["file"]), keep)))
    return F.struct(
        files.alias("files"), side("edited_modules", *["added_modules"] * added_modules).alias("modules"),
        side("edited_entities", *["added_entities"] * added_entities).alias("entities"))


def is_empty(gold: Column) -> Column:
    return (F.size(gold["files"]) == 0) & (F.size(gold["modules"]) == 0) & (F.size(gold["entities"]) == 0)


def with_drop_reason(df: DataFrame, order: list[str], min_len: int = 1, max_len: int = 20_000) -> DataFrame:
    """``df`` with the first rule a row fails, null for rows that are kept.

    A row is a duplicate if a row before it, in ``order``, has its id and passed the rules before; that is
    decided before the format is checked.  The rows of one id meet in one task.
    """
    text = F.coalesce("problem_statement", F.lit(""))
    owner, _, _ = parse_repo("repo")
    early = (
        F.when(F.regexp_replace(text, r"(?U)\s+", "") == "", "empty_statement").when(F.length(text) < min_len, "statement_too_short").when(F.length(text) > max_len, "statement_too_long")
        .when(creates_or_deletes_files("patch"), "created_or_deleted_files").when(is_empty(gold_struct("gold")), "no_valid_gold")
    )
    staged = df.withColumn("_early", early)
    place = F.row_number().over(Window.partitionBy("instance_id", F.col("_early").isNull()).orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early")).when(place > 1, "duplicate_instance_id")
        .when(~F.contains("repo", F.lit("/")) | (owner == "") | ~F.col("instance_id").rlike(INSTANCE_ID), "invalid_format")
    )
    return staged.withColumn("drop_reason", reason).drop("_early")


def filter_report(reasoned: DataFrame) -> DataFrame:
    """Totals and repositories before and after the rules, in one row."""
    kept = F.col("drop_reason").isNull()
    return reasoned.agg(
        F.count(F.lit(1)).alias("original_total"), F.count_if(kept).alias("kept_total"), F.count_if(~kept).alias("dropped_total"),
        F.countDistinct("repo").alias("n_repos_original"), F.countDistinct(F.when(kept, F.col("repo"))).alias("n_repos_kept"))


def nearest_rank(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """min, max and the element at int(n * share) of the sorted values, and how many there are; from a histogram of the distinct ones."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ranked = sums_before(counts, value_bucket(counts, column), [column], {"before": "n"})
    at = lambda s: F.min(F.when(F.col("before") + F.col("n") > F.floor(F.col("before_total") * F.lit(s)), F.col(column)))
    return ranked.agg(F.min(column).alias("min"), *[at(s).alias(name) for name, s in shares.items()], F.max(column).alias("max"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_values"))


def first_commits(df: DataFrame, order: str) -> DataFrame:
    """Distinct repositories with the first base commit that isn't null, in ``order``."""
    return df.groupBy("repo").agg(F.min_by(F.when(F.col("base_commit").isNotNull(), F.col("base_commit")), F.when(F.col("base_commit").isNotNull(), F.struct(order, "base_commit"))).alias("base_commit"))
