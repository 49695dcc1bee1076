"""From log folders to an analysed dataset: parse, refuse with reasons, deduplicate, split, fit, cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DataConfig
from ..functions.hashing import session_key
from ..operators import dedup, features, modes, players, sampling
from ..runtime import cut_lineage
from ..sources import discovery, playerlogs, traces


@dataclass
class Prepared:
    """Tables of an analysed dataset."""

    sessions: DataFrame
    packets: DataFrame
    excluded: DataFrame
    inventory: DataFrame
    stats: DataFrame
    modes: dict


def prepare(spark: SparkSession, root: str, kind: str, data: DataConfig | None = None, offsets=(0,), counts=None,
            seed: int = 20260814, minimum: int | None = None, restarts: int = 20) -> Prepared:
    """``kind``: ``line`` for line logs with shaped bandwidth, ``csv`` for capture and application CSV pairs."""
    data = data or DataConfig()
    if kind not in ("line", "csv"):
        raise ValueError(f"unknown log kind {kind}")
    if kind == "line":
        sources = discovery.discover_line_logs(spark, root, offsets)
        packets, facts, refused = traces.read_line_traces(spark, root)
    else:
        sources = discovery.discover_csv_pairs(spark, root)
        packets, facts, refused = traces.read_capture_traces(spark, root)
    packets, broken = features.split_packets(packets)
    broken = broken.groupBy("session_id").agg(F.min("reason").alias("reason"))
    facts = facts.join(broken, "session_id", "left_anti")
    refused = refused.unionByName(broken)
    sources = cut_lineage(sources)
    by_path = sources.withColumnRenamed("traffic_path", "session_id")
    timed = by_path.join(facts, "session_id")
    short = timed.where(F.col("duration") < data.window).select("session_id", F.lit("traffic_too_short").alias("reason"))
    usable = cut_lineage(timed.where(F.col("duration") >= data.window))
    count = int(data.window / 2)
    if kind == "line":
        _, series = playerlogs.read_line_player(spark, root, usable)
        samples, missing = players.sample_steps(playerlogs.bitrate_series(series), usable, {"quality": None}, 2.0, count)
        features_by_session, known, named = players.bitrate_mode_features(samples), usable, None
    else:
        rows, known_ids, missing = playerlogs.read_csv_player(spark, root, usable, data.window)
        initial = {"quality": 0.0, "buffer": 0.0, "stalled": 1.0, "state": 1.0}
        samples, unsampled = players.sample_steps(rows, known_ids, initial, 2.0, count)
        missing = missing.unionByName(unsampled)
        features_by_session, known, named = players.playback_mode_features(samples), usable.drop("identity"), known_ids
    exact = dedup.trace_signature(packets, 1e-6, "exact_signature", data.window)
    near = dedup.trace_signature(packets, 1e-3, "near_signature", data.window)
    rows = known if named is None else known.join(named, "session_id")
    rows = rows.join(features_by_session, "session_id").join(exact, "session_id").join(near, "session_id")
    rows = rows.withColumn("id", session_key(kind, F.col("source_id")))
    marked = cut_lineage(dedup.minimum_sessions(dedup.duplicate_groups(rows, "source_id"), minimum or (11 if kind == "csv" else 1)))
    kept = marked.where("reason is null").drop("reason", "component")
    split = sampling.identity_split(kept, seed, counts)
    kept = cut_lineage(kept.join(split, "identity"))
    training = kept.where("split = 'train'")
    if data.exclude_condition is not None:
        training = training.where(F.col("condition") != data.exclude_condition)
    if not training.limit(1).collect():
        raise ValueError("no training sessions")
    kept_packets = packets.join(kept.select("session_id"), "session_id", "left_semi")
    stats = cut_lineage(features.norm_stats(kept_packets, training, data))
    with_modes, facts_of_modes = modes.fit_modes(kept, training, "bitrate" if kind == "line" else "playback", seed, restarts)
    names = sources.select(F.col("traffic_path").alias("session_id"), "source_id")
    dropped = (refused.join(names, "session_id", "left_semi").unionByName(short).unionByName(missing)
               .unionByName(marked.where("reason is not null").select("session_id", "reason")))
    excluded = dropped.join(names, "session_id").select("source_id", "reason")
    return Prepared(with_modes, kept_packets, excluded, dedup.cohort_inventory(marked), stats, facts_of_modes)
