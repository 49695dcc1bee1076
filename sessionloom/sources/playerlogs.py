"""Player logs: event lines and CSV application data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .lines import epoch_seconds, number, read_lines, read_table

# Stream format code -> picture height.
FORMAT_HEIGHT = {
    18: 360, 22: 720, 133: 240, 134: 360, 135: 480, 136: 720, 137: 1080, 138: 2160, 160: 144, 242: 240, 243: 360, 244: 480,
    247: 720, 248: 1080, 264: 1440, 266: 2160, 271: 1440, 272: 2160, 278: 144, 298: 720, 299: 1080, 302: 720, 303: 1080,
    308: 1440, 313: 2160, 315: 2160, 330: 144, 331: 240, 332: 360, 333: 480, 334: 720, 335: 1080, 336: 1440, 337: 2160,
    394: 144, 395: 240, 396: 360, 397: 480, 398: 720, 399: 1080, 400: 1440, 401: 2160}
# State names outside the playback group, kept numeric series, phases that count as starved.
BUFFER_STATES = ("bufferStalled", "bufferLoaded")
SERIES = ("btr", "bitrate", "buf", "pbr")
STARVED = ("stalling", "depletion")


def height_of(code) -> F.Column:
    """Picture height of a format code, null when unknown."""
    table = F.create_map(*[F.lit(v) for pair in FORMAT_HEIGHT.items() for v in pair])
    return F.try_element_at(table, code)


def read_line_player(spark: SparkSession, root: str, origins: DataFrame, horizon: float = 120.0, pattern: str = "*.qoe.log"):
    """(states, series): event lines ``epoch_ms,name[,value]`` relative to each session's origin (A5).

    ``origins`` maps player_path to session_id and origin. Unreadable lines and values are skipped.
    """
    lines = read_lines(spark, root, pattern).withColumn("f", F.split("line", ",", 3)).where("size(f) >= 2")
    rows = lines.join(origins.select(F.col("player_path").alias("path"), "session_id", "origin"), "path").select(
        "session_id", "seq", (number(F.col("f")[0]) / 1000 - F.col("origin")).alias("t"), F.trim(F.col("f")[1]).alias("name"),
        number(F.get("f", F.lit(2))).alias("value")).where(F.col("t").isNotNull() & (F.col("t") <= horizon))
    rows = cut_lineage(rows)  # files are opened once
    states = rows.where(F.col("name").startswith("playback") | F.col("name").isin(*BUFFER_STATES)).select("session_id", "t", "seq", "name")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != F.lit(float("inf")))
    series = rows.where(F.lower("name").isin(*SERIES) & finite).select("session_id", "t", "seq", F.lower("name").alias("name"), "value")
    return states, series


def bitrate_series(series: DataFrame) -> DataFrame:
    """(session_id, t, seq, quality): the btr series where a session has one, otherwise bitrate."""
    picked = series.where("name in ('btr', 'bitrate')")
    has = picked.groupBy("session_id").agg(F.max((F.col("name") == "btr").cast("int")).alias("_btr"))
    return picked.join(has, "session_id").where("(_btr = 1) = (name = 'btr')").select("session_id", "t", "seq", F.col("value").alias("quality"))


def read_csv_player(spark: SparkSession, root: str, origins: DataFrame, window: float = 60.0, name: str = "application_data.csv"):
    """(series, identities, rejected): application rows as quality, buffer, stalled and state columns.

    A log needs exactly one video identity, at least one row inside the window and only known format codes.
    """
    raw = cut_lineage(read_table(spark, root, name, ["timestamp", "fmt", "bh", "videoid", "stalling", "phase"]))
    rows = raw.join(origins.select(F.col("player_path").alias("path"), "session_id", "origin"), "path").select(
        "session_id", "seq", (epoch_seconds("timestamp") - F.col("origin")).alias("t"), number("fmt").cast("int").alias("code"),
        (number("bh") / 1000).alias("buffer"), number("stalling").alias("stalled"), F.trim("videoid").alias("videoid"),
        F.lower(F.coalesce("phase", F.lit(""))).isin(*STARVED).cast("double").alias("state"))
    rows = rows.withColumn("quality", height_of(F.col("code")).cast("double"))
    named = F.when(F.coalesce(F.col("videoid"), F.lit("")) != "", F.col("videoid"))
    facts = rows.groupBy("session_id").agg(
        F.min(named).alias("low"), F.max(named).alias("high"), F.max(((F.col("t") >= 0) & (F.col("t") < window)).cast("int")).alias("inside"),
        F.max(F.col("quality").isNull().cast("int")).alias("unknown"),
        F.max((F.col("t").isNull() | F.col("buffer").isNull() | F.col("stalled").isNull()).cast("int")).alias("unread"))
    reason = (F.when(F.col("low").isNull() | (F.col("low") != F.col("high")), "video_identity_not_unique")
              .when(F.coalesce("inside", F.lit(0)) == 0, "no_player_rows_in_window").when(F.col("unknown") == 1, "unsupported_format_code")
              .when(F.col("unread") == 1, "unreadable_player_row"))
    judged = facts.select("session_id", F.col("low").alias("identity"), reason.alias("reason"))
    good = judged.where("reason is null").select("session_id", "identity")
    series = rows.join(good.select("session_id"), "session_id", "left_semi").select("session_id", "t", "seq", "quality", "buffer", "stalled", "state")
    return series, good, judged.where("reason is not null").select("session_id", "reason")
