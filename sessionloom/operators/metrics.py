"""Episode accuracy, open-set scores, rejection threshold, correlation with bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_text
from ..functions.ranking import average_ranks, cut_points, rank_by_digest, running_totals
from ..runtime import require_empty
from .matching import EPISODE


def episode_accuracy(predicted: DataFrame, members: DataFrame, group=None) -> DataFrame:
    """Share of right predictions per episode."""
    group = EPISODE if group is None else group
    truth = members.where("role = 'query'").select(*group, F.col("session_id").alias("query_id"), "label")
    joined = predicted.join(truth, [*group, "query_id"])
    return joined.groupBy(*group).agg(
        F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"),
        F.count("*").alias("queries"))


def accuracy_summary(per_episode: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample deviation and standard error over episodes; a single episode has zero spread."""
    spread = F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0))
    return per_episode.groupBy(*keys).agg(
        F.count("*").alias("episodes"), F.avg("accuracy").alias("accuracy"), spread.alias("episode_std"),
        (spread / F.sqrt(F.count("*"))).alias("episode_sem"))


def open_set_metrics(scores: DataFrame, keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """AUROC and false positive rate at the first threshold reaching 95 % recall, per key (C14).

    ``scores`` has known (boolean) and confidence. Equal scores are collapsed first; the running counts over the
    distinct scores are taken in ordered slots, not in one sorted task.
    """
    keys = keys or []
    by_score = scores.groupBy(*keys, "confidence").agg(
        F.sum(F.when(F.col("known"), 1).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(F.col("known"), 0).otherwise(1)).cast("double").alias("neg"))
    totals = scores.groupBy(*keys).agg(
        F.sum(F.when(F.col("known"), 1).otherwise(0)).cast("double").alias("n_pos"),
        F.sum(F.when(F.col("known"), 0).otherwise(1)).cast("double").alias("n_neg"))
    if strict:
        require_empty(totals.where("n_pos = 0 or n_neg = 0"), "both known and unknown queries are required")
        require_empty(scores.where("confidence is null or isnan(confidence)"), "scores must be finite")
    run = running_totals(by_score, keys, "confidence", {"pos": "tp", "neg": "fp"}, cut_points(scores, "confidence"),
                         descending=True)
    joined = run.join(totals, keys) if keys else run.join(F.broadcast(totals))  # totals is one row without keys
    reached = F.col("tp") / F.col("n_pos") >= 0.95
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + 0.5 * F.col("pos") * F.col("neg"))
    return joined.groupBy(*keys).agg(
        (area / F.first(F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
        F.max(F.when(reached, F.struct(F.col("confidence"), (F.col("fp") / F.col("n_neg")).alias("fpr"))))["fpr"]
        .alias("fpr95"),
        F.first("n_pos").cast("bigint").alias("known_count"), F.first("n_neg").cast("bigint").alias("unknown_count"))


def auroc_by_merging(scores: DataFrame) -> DataFrame:
    """One row (auroc, known_count, unknown_count) of (known, confidence), by counting inversions instead of ranks.

    Independent of :func:`open_set_metrics`: equal scores are summed map-side, ranges of scores are sorted apart, and each task merges its run as a
    stream, counting twice the unknown rows below every known one and once those beside it. What lies in lower ranges is added from
    one row a range. Counts are whole numbers, so the result is exact; no pair is formed. Null where one side has no rows.
    """
    summed = scores.where("confidence is not null and not isnan(confidence)").groupBy(F.col("confidence").cast("double").alias("c")).agg(
        F.count_if("known").alias("pos"), F.count_if(~F.col("known")).alias("neg"))
    runs = summed.repartitionByRange("c").sortWithinPartitions("c").mapInArrow(_merge_run, "slot int, pos bigint, neg bigint, twice decimal(38,0)")
    below = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = runs.select("pos", "neg", (F.col("twice") + 2 * F.col("pos").cast("decimal(18,0)") * F.coalesce(F.sum("neg").over(below), F.lit(0)).cast("decimal(18,0)")).alias("twice"))
    total = carried.agg(F.sum("twice").cast("double").alias("w"), F.sum("pos").alias("known_count"), F.sum("neg").alias("unknown_count"))
    pairs = 2.0 * F.col("known_count") * F.col("unknown_count")
    return total.select(F.try_divide("w", pairs).alias("auroc"), "known_count", "unknown_count")


def _merge_run(batches):
    from decimal import Decimal

    import pyarrow as pa
    from pyspark import TaskContext

    pos = neg = twice = 0
    for batch in batches:
        for p, n in zip(batch.column("pos").to_pylist(), batch.column("neg").to_pylist(), strict=True):
            twice += p * (2 * neg + n)
            pos, neg = pos + p, neg + n
    if pos or neg:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pos]), pa.array([neg]),
                                          pa.array([Decimal(twice)], pa.decimal128(38, 0))], names=["slot", "pos", "neg", "twice"])


def reject_threshold(confidences: DataFrame, share: float = 0.05) -> DataFrame:
    """One row: the lower ``share`` quantile of ``confidence`` and the share of rows at or above it."""
    by_score = confidences.groupBy("confidence").agg(F.count("*").alias("n"))
    run = running_totals(by_score, [], "confidence", {"n": "cum"}, cut_points(confidences, "confidence"))
    total = confidences.agg(F.count("*").alias("total"))
    placed = run.join(F.broadcast(total))  # one row
    wanted = F.floor(F.lit(share) * (F.col("total") - 1)) + 1
    found = placed.where(F.col("cum") >= wanted).agg(
        F.min(F.struct(F.col("confidence"), F.col("cum"), F.col("n"), F.col("total"))).alias("m"))
    above = (F.col("m.total") - F.col("m.cum") + F.col("m.n")) / F.col("m.total")
    return found.select(F.col("m.confidence").alias("threshold"), above.alias("empirical_known_tpr"))


def _correlation(ranked: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weighted Pearson correlation of two rank columns and weighted mean absolute error, by centred sums."""
    w = F.col(weight)
    # Mean rank is (n + 1) / 2 for either side, so centring needs no extra pass.
    total = ranked.groupBy(*keys).agg(F.sum(w).alias("_n"))
    centred = ranked.join(total, keys) if keys else ranked.join(F.broadcast(total))  # one row without keys
    dx, dy = F.col("rank_x") - (F.col("_n") + 1) / 2, F.col("rank_y") - (F.col("_n") + 1) / 2
    sums = centred.groupBy(*keys).agg(
        F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"),
        F.sum(w * F.abs(F.col("reference") - F.col("prediction"))).alias("err"), F.sum(w).alias("rows"))
    usable = (F.col("xx") > 0) & (F.col("yy") > 0)
    return sums.select(*keys, F.when(usable, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman"),
                       (F.col("err") / F.col("rows")).alias("mae"), F.col("rows").cast("bigint").alias("pairs"))


def spearman_with_interval(pairs: DataFrame, replicates: int = 2000, seed: int = 20260817) -> DataFrame:
    """Spearman correlation, mean absolute error and identity-bootstrap 95 % intervals.

    ``pairs`` has identity, reference, prediction. A replicate draws identities with replacement; a drawn identity
    contributes its pairs with its multiplicity as a weight, so ranks come from weighted counts of distinct values.
    """
    identities = pairs.select("identity").distinct()
    numbered = identities.withColumn("_h", hash_text(F.col("identity")))
    numbered = rank_by_digest(numbered, [], "_h", "place").drop("_h")
    count = identities.agg(F.count("*").alias("n_ids"))
    number = F.conv(F.substring(hash_text(seed, F.col("replicate"), F.col("draw")), 1, 12), 16, 10).cast("bigint")
    drawn = (pairs.sparkSession.range(replicates).withColumnRenamed("id", "replicate")
             .join(F.broadcast(count))  # one row
             .withColumn("draw", F.explode(F.expr("sequence(0, n_ids - 1)")))
             .withColumn("place", number % F.col("n_ids"))
             .groupBy("replicate", "place").agg(F.count("*").cast("double").alias("weight")))
    weights = drawn.join(numbered, "place").select("replicate", "identity", "weight")
    point_x, point_y = cut_points(pairs, "reference"), cut_points(pairs, "prediction")

    def ranked(rows, keys):
        x = average_ranks(rows, keys, "reference", "rank_x", "weight", point_x).select(*keys, "reference", "rank_x")
        y = average_ranks(rows, keys, "prediction", "rank_y", "weight", point_y).select(*keys, "prediction", "rank_y")
        return rows.join(x, [*keys, "reference"]).join(y, [*keys, "prediction"])

    base = pairs.select("identity", "reference", "prediction")
    # Identities carry the cluster weights; equal pairs of one identity are merged before the replicates multiply them.
    merged = base.groupBy("identity", "reference", "prediction").agg(F.count("*").cast("double").alias("copies"))
    sampled = (merged.join(weights, "identity")
               .select("replicate", "reference", "prediction", (F.col("weight") * F.col("copies")).alias("weight")))
    boot = _correlation(ranked(sampled, ["replicate"]), ["replicate"], "weight").where("spearman is not null")
    bounds = boot.agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in ("spearman", "mae")
                        for n, q in (("low", 0.025), ("high", 0.975))], F.count("*").alias("replicates"))
    whole = _correlation(ranked(merged.withColumnRenamed("copies", "weight"), []), [], "weight")
    renamed = bounds.select(*[F.col(c).alias(f"ci_{c}" if c != "replicates" else c) for c in bounds.columns])
    return whole.join(F.broadcast(renamed))  # two single rows


def verify_accuracy(records: DataFrame, reported: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Reported accuracy against the one recomputed from prediction/target records."""
    per_episode = records.groupBy(*keys, "episode").agg(
        F.avg(F.when(F.col("prediction") == F.col("target"), 1.0).otherwise(0.0)).alias("a"))
    again = per_episode.groupBy(*keys).agg(F.avg("a").alias("recomputed"), F.count("*").alias("found_episodes"))
    passed = ((F.abs(F.col("recomputed") - F.col("accuracy")) < tolerance) &
              (F.col("found_episodes") == F.col("episodes")))
    return reported.join(again, keys, "left").select(*keys, "accuracy", "recomputed",
                                                     F.coalesce(passed, F.lit(False)).alias("passed"))

