"""Ordered carry within a key (as-of values, running integrals), split by time so no key is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_last(df: DataFrame, keys: list[str], time: str, order: list[str], at: dict[str, str], width: float,
               before: dict[str, str] | None = None) -> DataFrame:
    """Last non-null values in (time, *order) order: ``at`` looks up to and including the row, ``before`` excludes it.

    Both map source to output columns. Rows are cut into time buckets of ``width``; the last value of each bucket is
    found by a partial aggregate and carried over the few buckets, so a hot key is many small sorts.
    """
    before = before or {}
    ordering = [time, *order]
    split = df.withColumn("_bucket", F.floor(F.col(time) / F.lit(width)))
    position = [F.col(c) for c in ordering]
    sources = list(dict.fromkeys([*at, *before]))
    lasts = split.groupBy(*keys, "_bucket").agg(*[
        F.max(F.when(F.col(s).isNotNull(), F.struct(*position, F.col(s).alias("_v")))).alias(f"_m_{s}") for s in sources])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*keys, "_bucket", *[
        F.last(F.col(f"_m_{s}._v"), ignorenulls=True).over(earlier).alias(f"_c_{s}") for s in sources])
    window = Window.partitionBy(*keys, "_bucket").orderBy(*ordering)
    found = [F.last(s, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, end)).alias(f"_l_{o}")
             for mapping, end in ((at, 0), (before, -1)) for s, o in mapping.items()]
    joined = split.select("*", *found).join(carry, [*keys, "_bucket"])
    outputs = {o: s for mapping in (at, before) for s, o in mapping.items()}
    return joined.select(*df.columns, *[F.coalesce(F.col(f"_l_{o}"), F.col(f"_c_{s}")).alias(o) for o, s in outputs.items()])


def carry_sum(df: DataFrame, keys: list[str], time: str, order: list[str], value: str, out: str,
              width: float) -> DataFrame:
    """Inclusive running sum of ``value`` in (time, *order) order, split like :func:`carry_last`."""
    split = df.withColumn("_bucket", F.floor(F.col(time) / F.lit(width)))
    totals = split.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_c"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0)
    local = split.withColumn("_l", F.coalesce(F.sum(value).over(inside), F.lit(0.0)))
    return (local.join(carry, [*keys, "_bucket"]).withColumn(out, F.col("_l") + F.col("_c"))
            .drop("_bucket", "_l", "_c"))


def finite(column: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))
