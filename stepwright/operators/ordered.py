"""Running sums over a whole table without a task that sees the whole table.

Rows are put into buckets that keep the order; the sum before a row is that of the buckets before its own,
of which there are few, plus that of the rows before it in its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of hex digests: the first three digits.
HEX_DIGITS = 3
EDGES = 64


def hex_bucket(digest: Column) -> Column:
    """An order-keeping bucket of a hex digest, one of 4096 of about the same size."""
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("int")


def value_bucket(df: DataFrame, value: str, edges: int = EDGES) -> Column:
    """An order-keeping bucket of a number, by about equal shares of the distinct values; equal values share it.

    The edges, ``edges`` numbers at most, are approximate quantiles of ``df`` that the driver puts into the plan.
    """
    shares = F.array(*[F.lit(k / edges) for k in range(1, edges)])
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, F.lit(1000)).alias("e")).first().e
    cuts = sorted({e for e in found or [] if e == e})
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda e: e < F.col(value))).cast("int")


def sums_before(df: DataFrame, bucket: Column, order: list[Column | str], sums: dict[str, Column | str], by: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over the rows before it (per ``by``), and <name>_total.

    ``order`` orders the rows of a bucket and should be unique there.
    """
    by = by or []
    tagged = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": F.col(c) if isinstance(c, str) else c for n, c in sums.items()})
    parts = tagged.groupBy(*by, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums])
    every = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*by, "_bucket", *[F.coalesce(F.sum(f"_p_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums],
                          *[F.sum(f"_p_{n}").over(every).alias(f"{n}_total") for n in sums])
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # null keys of ``by`` must find their starts too
    starts = starts.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_bucket").alias("_at"), *[c for c in starts.columns if c not in (*by, "_bucket")])
    own = F.col("_bucket") == F.col("_at")
    for b in by:
        own = own & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    placed = tagged.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums}).join(starts, own)
    keep = [c for c in df.columns if c not in sums]
    return placed.select(*keep, *[(F.col(f"_s_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums], *[f"{n}_total" for n in sums])
