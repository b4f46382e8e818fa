"""State tables as versions: each change is a plan from the old version and a batch to the new one.

Plain files have no update in place; a change is written beside the old version and then takes its place.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER = ("is_consumed", "consumed_iteration")
SLOT = ["instance_id", "node_key", "rollout_idx"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = SLOT, ledger: tuple[str, ...] = LEDGER) -> DataFrame:
    """``old`` with the rows of ``new`` put in: of a key in both, the results are new and the ledger columns stay old.

    Keys are unique on either side.  Doing it again changes nothing.
    """
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("_o"))
    n = new.select(*keys, F.struct(*[c for c in rest if c in new.columns]).alias("_n"))
    value = lambda c: F.when(F.col("_o").isNotNull() & (F.lit(c in ledger or c not in new.columns) | F.col("_n").isNull()), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}") if c in new.columns else F.lit(None).cast(dict(old.dtypes)[c]))
    return o.join(n, keys, "full").select(*keys, *[value(c).alias(c) for c in rest])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it doesn't have, with inserted telling which."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns)
    return old.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)))


def update(old: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``old`` with ``columns`` from ``changes`` where it has the key and a value that isn't null."""
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(new, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in old.columns])


def delete_instances(instances: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of ``instances`` (instance_id)."""
    gone = instances.select("instance_id").distinct()
    return {name: df.join(gone, "instance_id", "left_anti").select(*df.columns) for name, df in tables.items()}


def replace_version(df: DataFrame, path: str, version: int) -> str:
    """``df`` written as a version of a table: a folder that appears whole or not at all."""
    target = f"{path}/v{version:08d}"
    df.write.mode("errorifexists").parquet(target)
    return target


def is_legacy(columns: dict[str, set[str]]) -> bool:
    """Whether the tables of a store have an older layout: annotations kept apart, or rollouts without a ledger."""
    return "annotations" in columns or ("rollouts" in columns and "is_consumed" not in columns["rollouts"])


def keep_aside(path: str) -> str | None:
    """Moves a local store out of the way, to the first free name; None if there is none."""
    old = Path(path)
    if not old.exists():
        return None
    number = 1
    while (aside := old.with_name(f"{old.name}.bak{number}")).exists():
        number += 1
    old.rename(aside)
    return str(aside)
