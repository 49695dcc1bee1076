"""Ranks and running totals that never sort one whole group in a single task; key columns must not be null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_by_digest(df: DataFrame, keys: list[str], digest: str, out: str, digits: int = 2) -> DataFrame:
    """0-based position within ``keys`` in ascending order of the text column ``digest``.

    A group is split on the leading hex digits of the digest, so a hot group is sorted by 16**digits tasks; the
    offsets come from per-split counts. ``digest`` must be unique within the group.
    """
    split = df.withColumn("_part", F.substring(F.col(digest), 1, digits))
    counts = split.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_part").orderBy(digest)
    ranked = split.withColumn("_rn", F.row_number().over(inside))
    joined = ranked.join(offsets, [*keys, "_part"])
    return joined.withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("bigint")).drop("_part", "_n", "_rn", "_off")


def cut_points(df: DataFrame, column: str, rows_per_slot: int = 200_000) -> list[float]:
    """Approximate quantiles cutting ``df`` into slots of about ``rows_per_slot`` rows, two at least.

    One pass counts and one finds the points. They only balance the work and never affect results.
    """
    value = F.col(column).cast("double")
    parts = max(2, -(-df.agg(F.count(value)).first()[0] // rows_per_slot))
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(df.select(value.alias("_v")).approxQuantile("_v", shares, 0.5 / parts)))


def slot(column: Column, points: list[float]) -> Column:
    """Number of cut points at or below the value, found by halving."""
    if not points:
        return F.lit(0)
    listed = F.array(*[F.lit(float(p)) for p in points])
    turns = F.sequence(F.lit(1), F.lit(len(points).bit_length()))
    ends = F.struct(F.lit(0).alias("lo"), F.lit(len(points)).alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        below, open_ = F.get(listed, middle) <= column, state["lo"] < state["hi"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(state["lo"]).alias("lo"),
                        F.when(open_ & ~below, middle).otherwise(state["hi"]).alias("hi"))

    return F.aggregate(turns, ends, halve, lambda state: state["lo"])


def running_totals(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], points: list[float],
                   descending: bool = False) -> DataFrame:
    """Inclusive running sums of ``sums`` (source -> output) over ``order`` within ``keys``.

    ``df`` has one row per (keys, order). Rows are cut into ordered slots at ``points``; each slot is a separate window
    and the totals of the slots before it are added, so even one global order runs in parallel.
    """
    row_order = F.col(order).desc() if descending else F.col(order).asc()
    split = df.withColumn("_slot", slot(F.col(order).cast("double"), points))
    totals = split.groupBy(*keys, "_slot").agg(*[F.sum(s).alias(f"_t_{o}") for s, o in sums.items()])
    slot_order = F.col("_slot").desc() if descending else F.col("_slot").asc()
    before = Window.partitionBy(*keys).orderBy(slot_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_slot", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_c_{o}")
                                            for o in sums.values()])
    inside = Window.partitionBy(*keys, "_slot").orderBy(row_order).rowsBetween(Window.unboundedPreceding, 0)
    local = split.select("*", *[F.sum(s).over(inside).alias(f"_l_{o}") for s, o in sums.items()])
    joined = local.join(carry, [*keys, "_slot"])
    for out in sums.values():
        joined = joined.withColumn(out, F.col(f"_l_{out}") + F.col(f"_c_{out}"))
    return joined.drop("_slot", *[f"_l_{o}" for o in sums.values()], *[f"_c_{o}" for o in sums.values()])


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str, weight: str | None = None,
                  points: list[float] | None = None) -> DataFrame:
    """One row per (keys, value) with its tie-averaged rank; ``weight`` counts repeated rows."""
    amount = F.sum(weight) if weight else F.count("*")
    distinct = df.groupBy(*keys, value).agg(amount.cast("double").alias("_w"))
    points = cut_points(df, value) if points is None else points
    total = running_totals(distinct, keys, value, {"_w": "_cum"}, points)
    return total.withColumn(out, F.col("_cum") - (F.col("_w") - 1) / 2).drop("_cum").withColumnRenamed("_w", "ties")

