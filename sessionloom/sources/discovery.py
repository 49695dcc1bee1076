"""Finding trace, player and condition files and pairing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage, require_empty
from .lines import list_files, read_texts

NAME = r"^(\d{4})-(\d{4})-(\d{4})\.log$"  # identity, offset, repeat


def discover_line_logs(spark: SparkSession, root: str, offsets=(0,), strict: bool = True) -> DataFrame:
    """Sources named VVVV-OOOO-RRRR.log with their .qoe.log and .bw companions.

    A missing companion is an error when ``strict``; otherwise such sources are left out.
    """
    files = cut_lineage(list_files(spark, root))
    traces = (files.withColumn("identity", F.regexp_extract("name", NAME, 1)).where("identity <> ''")
              .withColumn("offset", F.regexp_extract("name", NAME, 2).cast("int"))
              .withColumn("repeat", F.regexp_extract("name", NAME, 3).cast("int"))
              .where(F.col("offset").isin(*offsets)).withColumn("stem", F.regexp_replace("path", r"\.log$", "")))
    players = files.where(F.col("name").endswith(".qoe.log")).select(
        F.regexp_replace("path", r"\.qoe\.log$", "").alias("stem"), F.col("path").alias("player_path"))
    texts = read_texts(spark, root, "*.bw").where(F.trim("text") != "")
    shaping = cut_lineage(texts.select(F.from_json("text", "scale double")["scale"].alias("scale"), F.regexp_replace("path", r"\.bw$", "").alias("stem")))
    if strict:
        require_empty(traces.join(players, "stem", "left_anti").select("path"), "missing player log")
        require_empty(traces.join(shaping, "stem", "left_anti").select("path"), "missing bandwidth file")
    whole = F.col("scale") == F.floor("scale")
    text = F.when(whole, F.col("scale").cast("bigint").cast("string")).otherwise(F.col("scale").cast("string"))
    return traces.join(players, "stem").join(shaping, "stem").select(
        _relative(root).alias("source_id"), F.col("path").alias("traffic_path"), "player_path", "identity", "offset", "repeat",
        F.concat(F.lit("bw"), text).alias("condition"))


def discover_csv_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Folders holding both video_traffic.csv and application_data.csv (A2)."""
    files = list_files(spark, root, "*.csv").withColumn("parent", F.regexp_replace("path", "/[^/]+$", ""))
    traffic = files.where("name = 'video_traffic.csv'").select("parent", F.col("folder").alias("source_id"), F.col("path").alias("traffic_path"))
    player = files.where("name = 'application_data.csv'").select("parent", F.col("path").alias("player_path"))
    return traffic.join(player, "parent").select("source_id", "traffic_path", "player_path", F.lit(None).cast("string").alias("identity"),
                                                 F.lit(None).cast("int").alias("offset"), F.lit(None).cast("int").alias("repeat"),
                                                 F.lit("native").alias("condition"))


def unprocessed(listing: DataFrame, processed: DataFrame, parser_version: str) -> DataFrame:
    """Files whose (path, digest, parser version) is not among the processed ones."""
    return listing.withColumn("parser_version", F.lit(parser_version)).join(
        processed.select("path", "digest", "parser_version"), ["path", "digest", "parser_version"], "left_anti")


def _relative(root: str):
    base = root.rstrip("/")
    return F.regexp_replace(F.substring_index("path", base, -1), "^/", "")
