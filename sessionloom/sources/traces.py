"""Packet traces from line logs, CSV captures and NPZ files.

Every reader returns (packets, facts, rejected): packets keyed by ``session_id`` (the file path) up to the retained
horizon, one facts row per good trace (origin, duration) and the refused traces with a reason.
"""

from __future__ import annotations

import io
import ipaddress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut_lineage
from .lines import number, open_files, read_lines, read_table

# Direction words of the line log, and the protocol numbers kept from captures.
SENT, RECEIVED = ("s", "sent", "send"), ("r", "received", "recv")
PROTOCOLS = ("6", "17", "6.0", "17.0")
CAPTURE_COLUMNS = ["timestamp", "ipSrc", "ipDst", "tcpLen", "udpLen", "payloadProtocolNumber"]


def read_line_traces(spark: SparkSession, root: str, retain: float = 120.0, pattern: str = "*[0-9].log"):
    """Lines ``rel_ns,direction,length,epoch_ms,...``; time counts from the first line (A3)."""
    lines = read_lines(spark, root, pattern).where("line <> ''").withColumn("f", F.split("line", ",")).where("f[0] <> ''")
    parsed = lines.select(F.col("path").alias("session_id"), "seq", F.size("f").alias("width"), number(F.col("f")[0]).alias("_ns"),
                          F.lower(F.trim(F.get("f", F.lit(1)))).alias("word"), number(F.get("f", F.lit(2))).alias("length"),
                          F.when(F.size("f") > 3, number(F.get("f", F.lit(3))) / 1000).otherwise(0.0).alias("_epoch"))
    parsed = cut_lineage(parsed.withColumn("_t", F.col("_ns") / F.lit(1e9)))  # files are opened once
    start = parsed.groupBy("session_id").agg(
        F.min(F.struct("seq", "_t", "_epoch")).alias("_first"), F.max("_t").alias("_last"),
        F.max((F.col("width") < 3).cast("int")).alias("_short"), F.max(F.col("_t").isNull().cast("int")).alias("_unread"))
    timed = parsed.join(start.select("session_id", F.col("_first._t").alias("_t0")), "session_id").withColumn("t", F.col("_t") - F.col("_t0"))
    kept = timed.where(F.col("t") < retain)
    wrong = kept.groupBy("session_id").agg(
        F.max((~F.coalesce(F.col("word").isin(*SENT, *RECEIVED), F.lit(False))).cast("int")).alias("_word"),
        F.max(F.col("length").isNull().cast("int")).alias("_length"))
    reason = (F.when(F.col("_short") == 1, "malformed_packet_row").when(F.col("_unread") == 1, "unreadable_time")
              .when(F.col("_first._epoch").isNull(), "unreadable_origin").when(F.col("_word") == 1, "unknown_direction")
              .when(F.col("_length") == 1, "unreadable_length"))
    facts = start.join(wrong, "session_id", "left").select(
        "session_id", F.col("_first._epoch").alias("origin"), F.greatest(F.lit(0.0), F.col("_last") - F.col("_first._t")).alias("duration"),
        reason.alias("reason"))
    return _split(kept.select("session_id", "seq", "t", F.when(F.col("word").isin(*SENT), 1).otherwise(0).alias("direction"), "length"), facts)


@F.pandas_udf(T.BooleanType())
def is_client_address(addresses: pd.Series) -> pd.Series:
    """Private but not loopback; null for text that is no address. Called on distinct addresses only."""
    def check(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        return address.is_private and not address.is_loopback

    return addresses.map(check)


def read_capture_traces(spark: SparkSession, root: str, retain: float = 120.0, name: str = "video_traffic.csv"):
    """CSV captures: the client is the most frequent private address, direction is up when it sends (A4)."""
    rows = cut_lineage(read_table(spark, root, name, CAPTURE_COLUMNS).withColumnRenamed("path", "session_id"))
    ends = rows.select("session_id", "seq", F.posexplode(F.array("ipSrc", "ipDst")).alias("end", "address"))
    counts = ends.groupBy("session_id", "address").agg(F.count("*").alias("n"), F.min(F.struct("seq", "end")).alias("seen"))
    kinds = counts.select("address").distinct().withColumn("client", is_client_address("address"))
    typed = counts.join(kinds, "address", "left")
    choice = typed.groupBy("session_id").agg(
        F.min(F.when(F.col("client"), F.struct((-F.col("n")).alias("n"), "seen", "address"))).alias("best"),
        F.max(F.col("client").isNull().cast("int")).alias("odd"))
    client = choice.select("session_id", F.col("best.address").alias("client"), "odd")
    touched = (rows.join(client.where("client is not null"), "session_id")
               .where(F.col("payloadProtocolNumber").isin(*PROTOCOLS) & ((F.col("ipSrc") == F.col("client")) | (F.col("ipDst") == F.col("client")))))
    part = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", 0.0).otherwise(number(c))
    packets = touched.select("session_id", "seq", number("timestamp").alias("_t"), (F.col("ipSrc") == F.col("client")).cast("int").alias("direction"),
                             (part("tcpLen") + part("udpLen")).alias("length"))
    span = packets.groupBy("session_id").agg(F.min("_t").alias("origin"), F.max("_t").alias("_end"),
                                             F.max((F.col("_t").isNull() | F.col("length").isNull()).cast("int")).alias("_unread"))
    reason = (F.when(F.col("odd") == 1, "invalid_address").when(F.col("client").isNull(), "no_client_address")
              .when(F.col("origin").isNull() & F.col("_unread").isNull(), "no_tcp_udp_packets").when(F.col("_unread") == 1, "unreadable_packet"))
    facts = client.join(span, "session_id", "left").select("session_id", "origin", (F.col("_end") - F.col("origin")).alias("duration"), reason.alias("reason"))
    timed = packets.join(span.select("session_id", "origin"), "session_id").withColumn("t", F.col("_t") - F.col("origin"))
    return _split(timed.where(F.col("t") < retain).select("session_id", "seq", "t", "direction", "length"), facts)


def read_npz_traces(spark: SparkSession, root: str, pattern: str = "*.npz", chunk: int = 100_000):
    """NPZ files with aligned times, directions, lengths; time counts from the earliest packet."""
    def load(file, path, start, end):
        try:
            with np.load(io.BytesIO(file.read()), allow_pickle=False) as raw:
                times, directions, lengths = (np.asarray(raw[k], dtype=float) for k in ("times", "directions", "lengths"))
            problem = None if len(times) else "empty_trace"
            if times.ndim != 1 or not len(times) == len(directions) == len(lengths):
                problem = "unaligned_arrays"
        except (ValueError, KeyError, OSError):
            problem = "unreadable_npz"
        if problem:
            yield path, -1, np.nan, -1, np.nan, np.nan, problem
            return
        origin = float(times.min())
        for i in range(0, len(times), chunk):
            part = slice(i, i + chunk)
            for seq, t, way, length in zip(range(i, len(times)), (times[part] - origin).tolist(), directions[part].astype(int).tolist(), lengths[part].tolist(),
                                           strict=False):
                yield path, seq, t, way, length, origin, None

    columns = [("session_id", pa.string()), ("seq", pa.int64()), ("t", pa.float64()), ("direction", pa.int32()), ("length", pa.float64()),
               ("origin", pa.float64()), ("reason", pa.string())]
    rows = cut_lineage(open_files(spark, root, pattern, load, columns, split=False))
    facts = rows.groupBy("session_id").agg(F.max("origin").alias("origin"), F.max("t").alias("duration"), F.max("reason").alias("reason"))
    return _split(rows.where("reason is null").select("session_id", "seq", "t", "direction", "length"), facts)


def _split(packets: DataFrame, facts: DataFrame):
    good = facts.where("reason is null").select("session_id", "origin", "duration")
    return packets.join(good.select("session_id"), "session_id", "left_semi"), good, facts.where("reason is not null").select("session_id", "reason")
