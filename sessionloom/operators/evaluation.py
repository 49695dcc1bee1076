"""Closed-set and open-set evaluation as one pipeline each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DataConfig, MatchConfig
from ..runtime import cut_lineage
from .features import fingerprints
from .matching import EPISODE, candidate_scores, episode_pairs, gallery_candidates, predictions, prototype_scores
from .metrics import accuracy_summary, episode_accuracy, open_set_metrics


def score_members(members: DataFrame, prints: DataFrame, config: MatchConfig, query_prints: DataFrame | None = None,
                  max_side: int | None = None) -> DataFrame:
    """Class scores of all episodes; the prototype rule skips the pair matrix."""
    if config.aggregation == "prototype":
        return prototype_scores(members, prints, query_fingerprints=query_prints)
    return candidate_scores(episode_pairs(members, prints, config, query_fingerprints=query_prints, max_side=max_side), config)


def evaluate_closed(members: DataFrame, packets: DataFrame, stats: DataFrame, data: DataConfig, config: MatchConfig,
                    fractions=(1.0,), max_side: int | None = None) -> DataFrame:
    """(fraction, seed, scenario, partition, episode, accuracy, queries) with truncated queries and full supports.

    Sessions are encoded once per fraction, not once per episode, and only those the episodes use.
    """
    if any(not 0 < f <= 1 for f in fractions):
        raise ValueError("query fractions must lie in (0, 1]")
    used = members.select("session_id", "role").distinct()
    full_ids = (used if 1.0 in fractions else used.where("role = 'support'")).select("session_id").distinct()
    full = fingerprints(packets.join(full_ids, "session_id", "left_semi"), stats, data, sessions=full_ids)
    query_ids = used.where("role = 'query'").select("session_id")
    out = None
    for fraction in fractions:
        views = None
        if fraction != 1.0:
            views = fingerprints(packets.join(query_ids, "session_id", "left_semi"), stats, data, until=data.window * fraction, sessions=query_ids)
        accuracy = episode_accuracy(predictions(score_members(members, full, config, views, max_side)), members)
        row = accuracy.select(F.lit(float(fraction)).alias("fraction"), *EPISODE, "accuracy", "queries")
        out = row if out is None else out.unionByName(row)
    return out


def closed_set_report(per_episode: DataFrame) -> DataFrame:
    """(fraction, seed, scenario) means with episode deviation and standard error."""
    return accuracy_summary(per_episode, ["fraction", "seed", "scenario"])


def evaluate_open(partitions: DataFrame, prints: DataFrame, config: MatchConfig) -> tuple[DataFrame, DataFrame]:
    """Per partition AUROC/FPR95, and the per-query records behind them."""
    columns = ["session_id", "z"] + (["v", "r"] if config.alignment != "none" else [])
    queries = partitions.where("role = 'query'").select("partition", "session_id").join(prints.select(*columns), "session_id")
    gallery = partitions.where("role = 'support'").select("partition", "session_id", "label").join(prints.select(*columns), "session_id")
    best = predictions(gallery_candidates(queries, gallery, config, group=["partition"]), ["partition"])
    truth = partitions.where("role = 'query'").select("partition", F.col("session_id").alias("query_id"), "known")
    # Scored once; the metrics read the records several times.
    records = cut_lineage(best.join(truth, ["partition", "query_id"]))
    return open_set_metrics(records, ["partition"]), records
