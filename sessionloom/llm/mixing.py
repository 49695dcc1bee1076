"""Mixing sources to target weights by Pareto order sampling.

A source's target (in words) over its size gives the copies expected of each of its documents. The whole part of that
number is certain; the fraction is an inclusion probability, and documents are taken in ascending order of random odds
divided by inclusion odds until the words still wanted are reached. A document too long for what is still wanted is passed over
and the draw goes on behind it. Ranking a source is split into about sqrt(n) slots of the order key, so a source with a third
of all rows is many small sorts; rows without a draw take no part in it. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage

DEFAULT_WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3


def uniform(key: Column, seed: int) -> Column:
    """Reproducible number in (0, 1): 48 bits of the SHA-256 of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(totals: DataFrame, weights: tuple[float, ...] = DEFAULT_WEIGHTS, most: float = MAX_REPEATS) -> DataFrame:
    """``totals`` (source, source_size) with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight, until none is above: every uncapped source
    then gets level * weight with one level for all. Sources are ranked by the level at which they reach their cap, and
    running sums give that level. One row per source passes through the window, never a row per document.
    """
    ranked = totals.withColumn("_turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.withColumn("_w", F.element_at(listed, (F.col("_turn") % len(weights) + 1).cast("int")))
    capped = weighed.withColumn("_cap", F.col("source_size").cast("double") * most).withColumn("_full", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_full", "_turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_full", "_turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = capped.select("*", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_capped"),
                           (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).alias("_open"),
                           F.sum("source_size").over(whole).cast("double").alias("_total"))
    level = (F.col("_total") - F.col("_capped")) / F.col("_open")
    # Capping the sources in this order raises the level until it no longer reaches the next cap; from there it would fall.
    found = summed.withColumn("_level", F.max(F.when(F.col("_full") >= level, level)).over(whole))
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return found.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column, weights: tuple[float, ...] = DEFAULT_WEIGHTS, most: int = MAX_REPEATS, seed: int = 1,
        key: str = "doc_id", source: str = "source", odds: Column | None = None) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken): how often the mix takes each document.

    ``odds`` (default 1) makes some documents likelier: the expected copies of a document are its source's target over
    size, times ``odds`` over the source's size-weighted mean of it, never above ``most``. The order is taken up to the
    document that would pass the target; of what is left behind it, documents with words that still fit are taken in the same
    order, and so on until none fits. Then one document not taken, the one whose size fits the words still wanted best, is
    added if that comes nearer. So a source misses its target by less than half the shortest document left.

    Null or empty texts have size 0 and copies by the same rule; a null source is a source of its own, sorted last. Rows
    with equal or null keys are drawn side by side, each for itself. An empty table gives an empty mix. Only ``key``,
    ``source`` and the columns in ``size`` and ``odds`` are read.
    """
    weight = F.lit(1.0) if odds is None else F.greatest(F.coalesce(odds.cast("double"), F.lit(0.0)), F.lit(0.0))
    narrow = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(source).alias("source"),
                                     size.cast("bigint").alias("size"), weight.alias("odds")))
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"),
                                          F.sum(F.col("size") * F.col("odds")).alias("_odds"))
    plan = source_targets(totals.select("source", "source_size"), weights, most)
    plan = cut_lineage(plan.join(totals.select(F.col("source").alias("_s"), "_rows", "_odds"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    joined = narrow.withColumnRenamed("source", "_s").join(plan, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    expected = F.when(F.col("_odds") > 0, F.least(F.lit(float(most)), F.col("target") * F.col("odds") / F.col("_odds"))).otherwise(F.lit(0.0))
    certain = F.floor(F.round(expected, 9))
    share = F.greatest(F.lit(0.0), expected - certain)
    chance = uniform(F.col("key"), seed)
    ratio = (chance / (1 - chance)) / (share / (1 - share))
    drawn = joined.select("*", certain.cast("bigint").alias("certain"), share.alias("share")).withColumn(
        "rank_key", F.when(F.col("share") > 1e-9, ratio))
    slots = F.ceil(F.sqrt(F.col("_rows").cast("double")))
    # rank_key / (1 + rank_key) maps the key to (0, 1) in order; ties fall into one slot.
    drawn = drawn.withColumn("slot", F.floor(F.col("rank_key") / (1 + F.col("rank_key")) * slots).cast("bigint"))
    drawn = cut_lineage(drawn.select("row", "key", "source", "size", "source_size", "target", "certain", "rank_key", "slot"))
    sure = drawn.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("certain"))).alias("wanted"))

    state = cut_lineage(sure.withColumn("done", F.lit(0).cast("bigint")))
    fitting = _joined(drawn.where("rank_key is not null").select("row", "key", "source", "size", "rank_key", "slot"), state).where(_fits())
    taken = drawn.where("false").select("row")
    while True:
        fitting = cut_lineage(fitting)
        if not fitting.limit(1).collect():
            break
        fresh = cut_lineage(_within(fitting))
        taken = taken.unionByName(fresh.select("row"))
        gained = fresh.groupBy("source").agg(F.sum("size").alias("gain"))
        state = cut_lineage(_joined(state, gained, "left").select("source", "wanted", (F.col("done") + F.coalesce("gain", F.lit(0))).alias("done")))
        fitting = _joined(fitting.drop("wanted", "done").join(fresh.select("row"), "row", "left_anti"), state).where(_fits())

    short = F.col("wanted") - F.col("done")
    gap = F.abs(short - F.col("size"))
    passed = _joined(drawn.where("rank_key is not null").select("row", "key", "source", "size").join(taken, "row", "left_anti"), state)
    filler = passed.where((short > 0) & (gap < short)).groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "key", "row")).alias("best")).select("best.row")
    extra = taken.unionByName(filler).withColumn("extra", F.lit(1).cast("bigint"))
    copies = F.col("certain") + F.coalesce("extra", F.lit(0).cast("bigint"))
    return drawn.join(extra, "row", "left").select(F.col("key").alias(key), "source", "size", "source_size", "target", copies.alias("copies"),
                                                   (copies * F.col("size")).alias("taken"))


def _joined(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of the row of their source."""
    other = by_source.withColumnRenamed("source", "_s")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def _fits() -> Column:
    """Whether a document with words still fits into what its source wants."""
    return (F.col("size") > 0) & (F.col("size") + F.col("done") <= F.col("wanted"))


def _within(rows: DataFrame) -> DataFrame:
    """(row, source, size) of the documents taken next: in Pareto order up to the first that passes its source's target.

    All ``rows`` fit for themselves, so each source takes the first of them at least.
    """
    sums = rows.groupBy("source", "slot").agg(F.sum("size").alias("words"))
    by_source = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("source").alias("_s"), F.col("slot").alias("_slot"), F.coalesce(F.sum("words").over(by_source), F.lit(0)).alias("before"))
    placed = rows.join(carry, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_slot"))).drop("_s", "_slot")
    inside = Window.partitionBy("source", "slot").orderBy("rank_key", "key", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("done") + F.col("before") + F.sum("size").over(inside)
    return placed.withColumn("upto", upto).where("upto <= wanted").select("row", "source", "size")
