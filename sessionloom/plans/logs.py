"""The given events written as trace and player logs of every supported format, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage, ensure_checkpoint_dir
from ..sources import discovery, playerlogs, traces
from ..sources.tracefiles import PACKETS, write_named
from . import tables

HORIZON = float(tables.BLOCK_SECONDS)
# Format codes by event, player names by event type.
CODES = (18, 134, 135, 136, 137, 160)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows with whole microseconds and the direction of a packet."""
    rows = tables.event_rows(spark, sf_dir)
    return rows.withColumn("us", F.round(F.col("t") * 1_000_000).cast("bigint")).withColumn("up", F.col("event_type").isin("click", "purchase", "signup"))


def line_log_folder(spark: SparkSession, sf_dir: str) -> str:
    """Sessions as VVVV-0000-RRRR.log with .qoe.log and .bw beside; users from 10,000 on get folders of their own."""
    rows = _events(spark, sf_dir)
    stem = F.concat((F.col("identity") / 10_000).cast("bigint").cast("string"), F.lit("/"), F.lpad((F.col("identity") % 10_000).cast("string"), 4, "0"),
                    F.lit("-0000-"), F.lpad(F.col("block").cast("string"), 4, "0"))
    millis = (F.col("us") / 1000).cast("string")
    traffic = F.concat_ws(",", (F.col("us") * 1000).cast("string"), F.when(F.col("up"), "s").otherwise("R"), F.col("value").cast("string"), millis)
    kind = F.col("event_type")
    name = (F.when(kind == "view", "btr").when(kind == "purchase", "buf").when(kind == "click", "pbr").when(kind == "error", "playbackWaiting").otherwise("playbackPlaying"))
    told = F.when(kind.isin("view", "purchase", "click"), F.concat_ws(",", millis, name, F.col("value").cast("string"))).otherwise(F.concat_ws(",", millis, name))
    both = rows.select("session_id", "us", "seq", F.explode(F.array(F.struct(F.concat(stem, F.lit(".log")).alias("file"), traffic.alias("line")),
                                                                    F.struct(F.concat(stem, F.lit(".qoe.log")).alias("file"), told.alias("line")))).alias("w"))
    shaped = rows.select("session_id", "block", stem.alias("stem")).distinct().select(
        "session_id", F.lit(0).cast("bigint").alias("us"), F.lit(0).cast("bigint").alias("seq"),
        F.struct(F.concat("stem", F.lit(".bw")).alias("file"), F.format_string('{"scale": %d}', F.pow(F.lit(2), F.col("block") % 4).cast("int")).alias("line")).alias("w"))
    root = _folder(spark, "line-logs")
    write_named(both.unionByName(shaped).select("session_id", "us", "seq", "w.file", "w.line"), root, ["session_id"], ["us", "seq"], encoding="utf-8-sig")
    return root


def _line_sources(spark: SparkSession, root: str) -> DataFrame:
    found = discovery.discover_line_logs(spark, root)
    big = F.regexp_extract("traffic_path", r"/(\d+)/[^/]+$", 1).cast("bigint")
    session = (big * 10_000 + F.col("identity").cast("bigint")) * (1 << 32) + F.col("repeat")
    return cut_lineage(found.select(session.alias("session_id"), "traffic_path", "player_path", "condition"))


def line_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, condition, origin, duration, t, direction, length) of the line logs, through discovery and pairing."""
    root = line_log_folder(spark, sf_dir)
    packets, facts, _ = traces.read_line_traces(spark, root, HORIZON)
    known = _line_sources(spark, root).withColumnRenamed("session_id", "session")
    return packets.join(facts, "session_id").join(known, F.col("session_id") == F.col("traffic_path")).select(
        F.col("session").alias("session_id"), "condition", "origin", "duration", "t", "direction", "length")


def line_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, kind, t, name, value) of the player event logs, states and series together."""
    root = line_log_folder(spark, sf_dir)
    sources = _line_sources(spark, root)
    _, facts, _ = traces.read_line_traces(spark, root, HORIZON)
    origins = sources.join(facts.select(F.col("session_id").alias("traffic_path"), "origin"), "traffic_path").select("session_id", "player_path", "origin")
    states, series = playerlogs.read_line_player(spark, root, origins, HORIZON)
    return states.select("session_id", F.lit("state").alias("kind"), "t", "name", F.lit(None).cast("double").alias("value")).unionByName(
        series.select("session_id", F.lit("series").alias("kind"), "t", "name", "value"))


def trace_log_packets(spark: SparkSession, sf_dir: str, before: float, split_bytes: int = 4096) -> DataFrame:
    """(session_id, t, direction, length) before a time, from line logs through the data source in small splits."""
    root = line_log_folder(spark, sf_dir)
    known = _line_sources(spark, root).select(F.col("session_id").alias("session"), F.regexp_replace("traffic_path", "^file:/+", "/").alias("path"))
    rows = spark.read.format("trace_log").option("split_bytes", split_bytes).load(root).where(F.col("t") < before)
    return rows.join(known, F.col("session_id") == F.col("path")).select(F.col("session").alias("session_id"), "t", "direction", "length")


def npz_packets(spark: SparkSession, sf_dir: str, through: str = "reader") -> DataFrame:
    """(session_id, t, direction, length) of NPZ traces, by the binary reader or by the data source."""
    root = _folder(spark, "npz")
    rows = _events(spark, sf_dir).select("session_id", "us", "seq", F.concat(F.col("session_id").cast("string"), F.lit(".npz")).alias("file"),
                                         (F.col("us") / 1_000_000).alias("times"), F.col("up").cast("int").alias("directions"), F.col("value").alias("lengths"))
    write_named(rows, root, ["session_id"], ["us", "seq"])
    packets = (traces.read_npz_traces(spark, root)[0] if through == "reader" else
               spark.read.format("trace_log").schema(PACKETS).option("form", "npz").load(root))
    return packets.select(F.regexp_extract("session_id", r"(\d+)\.npz$", 1).cast("bigint").alias("session_id"), "t", "direction", "length")


def _capture_folder(spark: SparkSession, sf_dir: str) -> str:
    """One folder a session with video_traffic.csv and application_data.csv, both with a header and a byte-order mark."""
    rows = _events(spark, sf_dir)
    home = F.concat(F.lit("192.168."), (F.col("identity") / 250 % 250).cast("int").cast("string"), F.lit("."), (F.col("identity") % 250 + 1).cast("string"))
    away, value, even = F.lit("8.8.4.4"), F.col("value").cast("string"), F.col("seq") % 2 == 0
    seconds = (F.col("us") / 1_000_000).cast("string")
    packet = F.concat_ws(",", seconds, F.when(F.col("up"), home).otherwise(away), F.when(F.col("up"), away).otherwise(home),
                         F.when(even, value).otherwise(""), F.when(even, "0").otherwise(value), F.when(even, "6").otherwise("17"))
    kind = F.col("event_type")
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("seq") % len(CODES) + 1).cast("int"))
    player = F.concat_ws(",", seconds, code.cast("string"), value, F.concat(F.lit("v"), F.col("identity").cast("string")), F.when(kind == "error", "1").otherwise("0"),
                         F.when(kind == "error", "Stalling").when(kind == "purchase", "depletion").otherwise("filling"))
    session = F.col("session_id").cast("string")
    names = {"video_traffic.csv": ("timestamp,ipSrc,ipDst,tcpLen,udpLen,payloadProtocolNumber", packet),
             "application_data.csv": ("timestamp,fmt,bh,videoid,stalling,phase", player)}
    lines = [F.struct(F.concat(session, F.lit(f"/{n}")).alias("file"), line.alias("line")) for n, (_, line) in names.items()]
    heads = [F.struct(F.concat(session, F.lit(f"/{n}")).alias("file"), F.lit(head).alias("line")) for n, (head, _) in names.items()]
    body = rows.select("session_id", "us", "seq", F.explode(F.array(*lines)).alias("w"))
    first = rows.select("session_id").distinct().select("session_id", F.lit(-1).cast("bigint").alias("us"), F.lit(-1).cast("bigint").alias("seq"), F.explode(F.array(*heads)).alias("w"))
    root = _folder(spark, "captures")
    write_named(body.unionByName(first).select("session_id", "us", "seq", "w.file", "w.line"), root, ["session_id"], ["us", "seq"], encoding="utf-8-sig")
    return root


def _named_session(path: str) -> F.Column:
    return F.regexp_extract(path, r"/(\d+)/[^/]+$", 1).cast("bigint")


def capture_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, duration, t, direction, length) of CSV captures that have a player log beside them."""
    root = _capture_folder(spark, sf_dir)
    pairs = discovery.discover_csv_pairs(spark, root).select(F.col("source_id").cast("bigint").alias("session"), "traffic_path")
    packets, facts, _ = traces.read_capture_traces(spark, root, HORIZON)
    return packets.join(facts, "session_id").join(pairs, F.col("session_id") == F.col("traffic_path")).select(
        F.col("session").alias("session_id"), "duration", "t", "direction", "length")


def csv_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, identity, t, quality, buffer, stalled, state) of the CSV application data."""
    root = _capture_folder(spark, sf_dir)
    origins = discovery.discover_csv_pairs(spark, root).select("player_path", F.col("source_id").cast("bigint").alias("session_id"), F.lit(0.0).alias("origin"))
    series, known, _ = playerlogs.read_csv_player(spark, root, origins, HORIZON)
    return series.join(known, "session_id").select("session_id", "identity", "t", "quality", "buffer", "stalled", "state")


def report_folder(spark: SparkSession, sf_dir: str) -> str:
    """A report file for every label below 9 and three seeds: settings in two orders of keys, label 7 cut off in the middle, label 8 without settings.

    The accuracy is the share of the label's vectors whose component of that seed is positive.
    """
    rows = tables.table(spark, sf_dir, "embeddings").where("label < 9").select("label", F.explode(F.array(*[F.struct(
        F.lit(s).alias("seed"), (F.col("embedding")[s] > 0).cast("double").alias("hit")) for s in range(3)])).alias("x"))
    facts = rows.groupBy("label", "x.seed").agg(F.avg("x.hit").alias("accuracy"), F.count("*").alias("n"))
    text = lambda c: F.col(c).cast("string")
    kind = F.when(F.col("label") % 2 == 0, "amp").otherwise("protonet")
    matching = F.concat(F.lit('"matching": {"gamma": 0.'), (F.col("label") + 1).cast("string"), F.lit(', "alignment": "pma"}'))
    model = F.concat(F.lit('"model":{"kind":"'), kind, F.lit('"}'))
    training = F.concat(F.lit('"training": {"epochs": 5, "seed": '), text("seed"), F.lit(', "device": "d'), text("seed"), F.lit('", "rates": [0.5, {"x": null}]}'))
    config = F.when(F.col("seed") == 1, F.concat_ws(",", training, model, matching)).otherwise(F.concat_ws(", ", matching, training, model))
    scored = F.concat(F.lit('"scenario": "mixed", "fraction": 1.0, "accuracy": '), F.format_string("%.6f", "accuracy"))
    body = F.when(F.col("label") == 8, F.concat(F.lit("{"), scored, F.lit("}"))).otherwise(F.concat(F.lit('{"config": {'), config, F.lit("}, "), scored, F.lit("}")))
    line = F.when(F.col("label") == 7, F.substring(body, 1, 60)).otherwise(body)
    root = _folder(spark, "reports")
    named = facts.select("label", "seed", F.concat(F.lit("run-"), text("label"), F.lit("-"), text("seed"), F.lit(".json")).alias("file"), line.alias("line"))
    write_named(named, root, ["label", "seed"], [], encoding="utf-8-sig")
    return root
