"""Streamed bins against batch bins: restarts, late files, closed sessions."""

import pandas as pd
from pyspark.sql import functions as F

from sessionloom.config import DataConfig
from sessionloom.operators import features
from sessionloom.streaming import bins

CONFIG = DataConfig(window=60.0, scales=(500, 2000), tokens=4)


def packets(spark, rows):
    frame = spark.createDataFrame(rows, "session_id bigint, begun bigint, t double, direction int, length double")
    frame = frame.withColumn("begun", F.col("begun") + 1_000_000)
    micros = ((F.col("begun") + F.col("t")) * 1_000_000).cast("bigint")
    return frame.select("session_id", F.timestamp_micros(micros).alias("event_time"), ((F.col("begun") + 60) * 1000).alias("ends"), "t", "direction", "length")


def arrive(spark, tmp_path, rows, lateness):
    frame = packets(spark, rows)
    frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    bins.run_available(spark, stream, CONFIG, str(tmp_path / "out"), str(tmp_path / "ckpt"), lateness)


def test_every_restart_goes_on_and_late_files_count(spark, tmp_path):
    rows = [(s, s * 10, 0.37 * i, i % 2, 100.0 + i) for s in range(3) for i in range(150)]
    parts = [rows[0::3], rows[2::3], rows[1::3]]
    for part in parts:
        arrive(spark, tmp_path, part, "10 minutes")
    order = ["session_id", "scale", "bin"]
    got = bins.dense_bins(bins.latest_bins(spark, str(tmp_path / "out")), CONFIG).orderBy(*order).toPandas()
    frame = packets(spark, rows)
    want = features.bin_features(frame, CONFIG).orderBy(*order).toPandas()
    assert len(got) == 3 * 150
    pd.testing.assert_frame_equal(got[want.columns].astype(float), want.astype(float))
    seen = bins.prefix_bins(bins.latest_bins(spark, str(tmp_path / "out")), CONFIG, 20.0, 4.0)
    batch = features.sparse_bins(frame, CONFIG, 20.0, 4.0)
    assert seen.count() == batch.count() and seen.join(batch, order).where(seen["c0"] != batch["c0"]).count() == 0


def test_a_closed_session_takes_no_more_packets(spark, tmp_path):
    arrive(spark, tmp_path, [(1, 0, 1.0, 0, 5.0)], "1 second")
    arrive(spark, tmp_path, [(2, 1000, 1.0, 1, 7.0)], "1 second")
    arrive(spark, tmp_path, [(1, 0, 2.0, 0, 9.0), (2, 1000, 3.0, 0, 9.0)], "1 second")
    rows = {(r.session_id, r.scale, r.bin): (r.c0, r.c1) for r in bins.latest_bins(spark, str(tmp_path / "out")).where("scale = 2000").collect()}
    assert rows == {(1, 2000, 0): (5.0, 0.0), (2, 2000, 0): (0.0, 7.0), (2, 2000, 1): (9.0, 0.0)}


def test_state_is_the_sums_of_bins_and_batches_write_what_they_touch(spark, tmp_path):
    """No Python task per session: a batch writes the bins it touches only, a null length makes the sum unknown, late packets count."""
    arrive(spark, tmp_path, [(1, 0, 1.0, 0, 5.0), (1, 0, 30.0, 1, 2.0), (2, 0, 70.0, 0, 1.0)], "10 seconds")
    arrive(spark, tmp_path, [(1, 0, 30.1, 1, 3.0), (1, 0, 1.1, 0, None)], "10 seconds")
    arrive(spark, tmp_path, [(3, 45, 1.0, 0, 1.0)], "10 seconds")
    arrive(spark, tmp_path, [(1, 0, 40.0, 0, 4.0)], "10 seconds")
    written = spark.read.schema(bins.OUT + ", batch bigint").option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    counts = [r["count"] for r in written.groupBy("batch").count().orderBy("batch").collect()]
    assert counts == [2, 2, 1, 1]
    got = {(r.session_id, r.scale, r.bin): (str(r.c0), r.c1, r.c2, r.c3) for r in bins.latest_bins(spark, str(tmp_path / "out")).where("scale = 2000").collect()}
    assert got == {(1, 2000, 0): ("None", 0.0, 2.0, 0.0), (1, 2000, 15): ("0.0", 5.0, 0.0, 2.0), (1, 2000, 20): ("4.0", 0.0, 1.0, 0.0), (3, 2000, 0): ("1.0", 0.0, 1.0, 0.0)}
