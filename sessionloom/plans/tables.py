"""The given parquet tables seen as packets, player series, fingerprints and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DataConfig

BLOCK_SECONDS = 518_400  # six days; events cover five such blocks per user
ORIGIN = "2024-01-01 00:00:00"
EVENT_DATA = DataConfig(window=float(BLOCK_SECONDS), scales=(3_600_000, 21_600_000, 86_400_000), tokens=8)
SLICES, SLICE_DIM = 8, 8  # token layout of the 64-wide embeddings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their session and the time in seconds since the session's block started."""
    # A difference of local times does not depend on the session time zone.
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{ORIGIN}', ts)")
    size = F.lit(BLOCK_SECONDS * 1_000_000)
    return (table(spark, sf_dir, "events").withColumn("_us", micros)
            .withColumn("block", F.floor(F.col("_us") / size).cast("bigint"))
            .select((F.col("user_id").cast("bigint") * (1 << 32) + F.col("block")).alias("session_id"), F.col("user_id").alias("identity"),
                    "block", ((F.col("_us") - F.col("block") * size) / F.lit(1e6)).alias("t"),
                    F.col("event_id").alias("seq"), "event_type", "value"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.col("event_type").isin("click", "purchase", "signup")
    return event_rows(spark, sf_dir).select("session_id", "identity", "block", "seq", "t",
                                            F.when(up, 1).otherwise(0).alias("direction"),
                                            F.col("value").alias("length"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sessions of the events table; condition is the block, mode the block modulo three."""
    return (event_rows(spark, sf_dir).select("session_id", "identity", "block").distinct()
            .withColumn("condition", F.concat(F.lit("bw"), F.col("block").cast("string")))
            .withColumn("mode", F.element_at(F.array(F.lit("L"), F.lit("T"), F.lit("H")),
                                             (F.col("block") % 3 + 1).cast("int"))))


def vector_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session attributes of the embeddings, without the vectors."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS session_id", "cast(label AS bigint) AS identity",
        "concat('bw', cast(shiftleft(1, cast(vec_id % 4 AS int)) AS string)) AS condition",
        "element_at(array('L', 'T', 'H'), cast(vec_id % 3 + 1 AS int)) AS mode")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints from the embeddings: z, eight normalised slices v, reliabilities r and r_holes."""
    z = "transform(embedding, x -> cast(x AS double))"
    piece = f"slice(z, i * {SLICE_DIM} + 1, {SLICE_DIM})"
    length = f"greatest(sqrt(aggregate({piece}, 0D, (s, x) -> s + x * x)), 1e-12D)"
    index = f"sequence(0, {SLICES - 1})"
    return (table(spark, sf_dir, "embeddings")
            .selectExpr("vec_id AS session_id", "cast(label AS bigint) AS identity", f"{z} AS z")
            .selectExpr("session_id", "identity", "z",
                        f"transform({index}, i -> transform(arrays_zip({piece}, array_repeat({length}, {SLICE_DIM})), "
                        "p -> p.`0` / p.`1`)) AS v",
                        f"array_repeat(1D, {SLICES}) AS r",
                        f"transform({index}, i -> if(session_id % {SLICES} = i, 0D, 1D)) AS r_holes"))


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an exact key and a key that ignores case and everything but letters."""
    letters = F.regexp_replace("text", r"[^\p{L}]+", " ")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("session_id"), F.col("source").alias("identity"), F.col("lang").alias("condition"),
        F.sha2("text", 256).alias("exact_signature"), F.sha2(F.lower(letters), 256).alias("near_signature"))


STEP = BLOCK_SECONDS / 30  # thirty samples per session, as in a 60-second window of two-second steps
INITIAL_GAP = BLOCK_SECONDS / 12  # five seconds of sixty, scaled
FRONTIER_TARGETS = [172_800.0 + 43_200.0 * i for i in range(7)]
FRONTIER_GAP = 259_200.0


def player_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a player log: view = quality, purchase = buffer, error/view = stalled, signup/click = state."""
    kind = F.col("event_type")
    return event_rows(spark, sf_dir).select(
        "session_id", "t", "seq", F.when(kind == "view", F.col("value")).alias("quality"),
        F.when(kind == "purchase", F.col("value") / 100).alias("buffer"),
        F.when(kind == "error", 1.0).when(kind == "view", 0.0).alias("stalled"),
        F.when(kind == "signup", 1.0).when(kind == "click", 0.0).alias("state"))


def playback_logs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """State, rate and buffer events: view plays, error waits, a cheap signup is a finished seek."""
    rows = event_rows(spark, sf_dir)
    name = (F.when(F.col("event_type") == "view", "playbackPlaying").when(F.col("event_type") == "error", "playbackWaiting")
            .when((F.col("event_type") == "signup") & (F.col("value") < 3), "playbackSeeked"))
    states = rows.select("session_id", "t", "seq", name.alias("name")).where("name is not null")
    rates = rows.where("event_type = 'click'").select("session_id", "t", "seq", F.expr("cast(pmod(seq, 4) AS double)").alias("value"))
    buffers = rows.where("event_type = 'purchase'").select("session_id", "t", "seq", "value")
    sessions = rows.select("session_id", F.col("block").alias("offset")).distinct()
    return {"sessions": sessions, "states": states, "rates": rates, "buffers": buffers}
