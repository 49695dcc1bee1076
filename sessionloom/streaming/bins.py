"""Bin features from packets as they arrive: state per session and bin, late packets up to a watermark, restarts from a checkpoint.

A streaming aggregation holds the sums of a session's non-empty bins, one row for all scales, with the time of the bin's last packet and
their number. Every batch writes the bins it touches with the batch's number, so readers take the latest ones and a batch that is repeated
after a failure only replaces itself. A session is forgotten once the watermark has passed its window; packets later than that are
left out, as the watermark says.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DataConfig
from ..operators.features import fill_grid

OUT = "session_id bigint, scales array<int>, bins array<bigint>, c0 double, c1 double, c2 double, c3 double, last double, seen bigint"


def run_available(spark: SparkSession, packets: DataFrame, config: DataConfig, out: str, checkpoint: str, lateness: str) -> None:
    """Takes all packets that have come since the last call into the bins below ``out``.

    ``packets`` is a stream of (session_id, event_time, ends, t, direction, length); ``ends`` is the event time in milliseconds at which the
    session's window is over. ``checkpoint`` and ``out`` belong together and lie in a shared folder; a call after a failure goes on
    from there. The watermark follows the ends of the windows, so it stays ``lateness`` and one window behind the latest of them and no
    packet is left out that is less than ``lateness`` behind the last one.
    """
    delay = f"{lateness} {math.ceil(config.window * 1000)} milliseconds"
    usable = packets.where((F.col("t") >= 0) & (F.col("t") < F.lit(float(config.window))))
    timed = usable.withColumn("closes", F.timestamp_millis("ends")).withWatermark("closes", delay)
    up = F.coalesce(F.col("direction") == 1, F.lit(False))
    length = F.coalesce(F.col("length").cast("double"), F.lit(float("nan")))
    total = lambda test, value: F.sum(F.when(test, value).otherwise(0.0))
    places = F.array(*[F.floor(F.col("t") * 1000 / F.lit(s) + F.lit(1e-9)) for s in config.scales])
    bins = timed.groupBy("session_id", "closes", places.alias("bins")).agg(
        total(~up, length).alias("c0"), total(up, length).alias("c1"), total(~up, F.lit(1.0)).alias("c2"), total(up, F.lit(1.0)).alias("c3"),
        F.max("t").alias("last"), F.count("*").alias("seen")).drop("closes")

    def store(rows: DataFrame, number: int) -> None:
        rows.withColumn("scales", F.array(*[F.lit(int(s)) for s in config.scales])).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = bins.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()


def latest_bins(spark: SparkSession, out: str) -> DataFrame:
    """(session_id, scale, bin, c0..c4) from the last batch of every bin: non-empty bins only."""
    sums = ["c0", "c1", "c2", "c3"]
    rows = spark.read.schema(OUT + ", batch bigint").option("basePath", out).parquet(out).where("session_id is not null")
    last = rows.groupBy("session_id", "scales", "bins").agg(*[F.max_by(c, "batch").alias(c) for c in sums])
    bins = last.select("session_id", F.explode(F.arrays_zip(F.col("scales").alias("scale"), F.col("bins").alias("bin"))).alias("g"), *sums).groupBy("session_id", "g.scale", "g.bin").agg(*[F.sum(c).alias(c) for c in sums])
    # A packet without a length leaves its bin's sum unknown.
    bins = bins.select("session_id", "scale", "bin", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in sums])
    mean = F.when(F.col("c2") > 0, F.col("c0") / F.col("c2")).otherwise(0.0)
    return bins.withColumn("c4", mean)


def dense_bins(bins: DataFrame, config: DataConfig) -> DataFrame:
    """(session_id, scale, bin, c0..c4, mask) with empty bins, of every session that has one; the whole window is observed."""
    known = bins.select("session_id", "scale", "bin", *[F.coalesce(f"c{i}", F.lit(0.0)).alias(f"c{i}") for i in range(5)])
    return fill_grid(known, bins.select("session_id").distinct(), config).withColumn("mask", F.lit(1))


def prefix_bins(bins: DataFrame, config: DataConfig, until: float, start: float = 0.0) -> DataFrame:
    """Bins of the view from ``start`` over ``until`` seconds, counted from its start; both must be borders of bins at every scale."""
    for scale in config.scales:
        if start * 1000 % scale or until * 1000 % scale:
            raise ValueError(f"the view does not end on a bin of {scale} ms")
    shifted = F.col("bin") - F.lit(int(start * 1000)) / F.col("scale")
    moved = bins.withColumn("bin", shifted.cast("bigint"))
    return moved.where((F.col("bin") >= 0) & (F.col("bin") < F.lit(int(until * 1000)) / F.col("scale")))
