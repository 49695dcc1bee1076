"""Log formats, NPZ, manifests, verified tables and the whole preparation on small files."""

import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.config import DataConfig, MatchConfig
from sessionloom.operators import features, matching, players
from sessionloom.plans.prepare import prepare
from sessionloom.runtime import cut_lineage
from sessionloom.sources import discovery, lines, playerlogs, stores, traces
from sessionloom.sources.lines import epoch_seconds, file_digests


def uri(path):
    return f"file://{path}"


def test_line_log_origin_duration_direction(spark, tmp_path):
    trace = [(0, "r", 1200), (500, "s", 80), (2500, "s", 45), (75250, "r", 700)]
    text = "".join(f"{ms * 1_000_000},{way},{size},{250_000 + ms},7,3\n" for ms, way, size in trace)
    (tmp_path / "0001-0000-0000.log").write_text(text)
    (tmp_path / "0001-0000-0001.log").write_text("0,r,400,9000\n8000,q,410,9000\n")
    (tmp_path / "0001-0000-0002.log").write_text("0,r\n")
    packets, facts, rejected = traces.read_line_traces(spark, str(tmp_path))
    rows = packets.orderBy("t").collect()
    assert [(r.t, r.direction, r.length) for r in rows] == [(ms / 1000, int(way == "s"), size) for ms, way, size in trace]
    fact = facts.collect()
    assert len(fact) == 1 and fact[0].origin == 250 and fact[0].duration == 75.25
    assert {r.reason for r in rejected.collect()} == {"unknown_direction", "malformed_packet_row"}


def test_line_player_skips_nan_and_prefers_btr(spark, tmp_path):
    path = tmp_path / "b.qoe.log"
    path.write_text("250000,bitrate,7\n250000,btr,2400\n250050,lat,NaN\n250700,playbackPlaying\n251000,pbr,2\n252000,buf,NaN\n")
    origins = spark.createDataFrame([("s", uri(path), 250.0)], "session_id string, player_path string, origin double")
    states, series = playerlogs.read_line_player(spark, str(tmp_path), origins)
    assert [r.name for r in states.collect()] == ["playbackPlaying"]
    quality = playerlogs.bitrate_series(series)
    assert [r.quality for r in quality.collect()] == [2400.0]
    samples, refused = players.sample_steps(quality, origins, {"quality": None})
    assert samples.where("quality = 2400").count() == 30 and refused.count() == 0
    row = players.bitrate_mode_features(samples).first()
    assert len(row.mode_features) == 37 and np.isfinite(row.mode_features).all()


def test_contents_of_files_are_not_broadcast(spark, tmp_path, monkeypatch):
    """A folder of files below the root: the list of folders is short enough for a broadcast, the lines are not."""
    (tmp_path / "all").mkdir()
    for i in range(40):
        (tmp_path / "all" / f"{i:04d}.qoe.log").write_text("".join(f"{i * 1000 + k},btr,{k}\n" for k in range(500)))
    origins = spark.createDataFrame([(i, uri(tmp_path / "all" / f"{i:04d}.qoe.log"), float(i)) for i in range(40)], "session_id bigint, player_path string, origin double")
    plans = []

    def kept(rows):
        out = cut_lineage(rows)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(playerlogs, "cut_lineage", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")
    try:
        _, series = playerlogs.read_line_player(spark, str(tmp_path), origins)
        assert series.count() == 20_000 and series.where("session_id = 7 and seq = 0 and t = 0 and value = 0").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastExchange" not in plans[0].split("Initial Plan")[0]


def test_capture_client_udp_and_reasons(spark, tmp_path):
    home, away = "192.168.7.4", "1.1.1.1"
    head = "timestamp,ipSrc,ipDst,tcpLen,udpLen,payloadProtocolNumber\n"
    for name, rows in (("full", [(40, home, away, "0", 222, 17), (60, away, home, "", 9, 1), (52, away, home, "0", 1350, 17), (110.5, away, home, "0", 640, 17)]),
                       ("bare", [(40, "127.0.0.1", away, "0", 222, 17)])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "video_traffic.csv").write_text(head + "".join(",".join(map(str, r)) + "\n" for r in rows))
    packets, facts, rejected = traces.read_capture_traces(spark, str(tmp_path))
    assert [(r.direction, r.length) for r in packets.orderBy("t").collect()] == [(1, 222.0), (0, 1350.0), (0, 640.0)]
    assert facts.first().duration == 70.5
    assert [r.reason for r in rejected.collect()] == ["no_client_address"]


def test_csv_player_startup_is_not_backfilled(spark, tmp_path):
    path = tmp_path / "application_data.csv"
    path.write_text("timestamp,fmt,bh,videoid,stalling,phase\n516,247,4000,clip,0,filling\n565,247,9000,clip,0,filling\n")
    frame = lambda origin: spark.createDataFrame([("s", uri(path), origin)], "session_id string, player_path string, origin double")
    series, known, refused = playerlogs.read_csv_player(spark, str(tmp_path), frame(500.0))
    initial = {"quality": 0.0, "buffer": 0.0, "stalled": 1.0, "state": 1.0}
    samples, _ = players.sample_steps(series, known, initial)
    # Samples come every two seconds; the player says nothing before second 16.
    assert [r.quality for r in samples.orderBy("k").collect()] == [0] * 8 + [720] * 22
    assert players.playback_mode_features(samples).first().mode_features[0] == pytest.approx(8 / 30)
    assert refused.count() == 0
    _, _, late = playerlogs.read_csv_player(spark, str(tmp_path), frame(0.0))
    assert late.first().reason == "no_player_rows_in_window"


def test_many_files_are_listed_and_opened_by_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(400):
        home = tmp_path / "part" / f"s{i}"
        home.mkdir(parents=True)
        (home / "a1.log").write_bytes(f"\ufeff{i},s\r\nx{i}\ry{i}\n\nz{i}".encode())
    (tmp_path / "_hidden1.log").write_text("no")
    monkeypatch.setattr(lines, "SPLIT_BYTES", 3)
    read = lines.read_lines(spark, str(tmp_path), "*[0-9].log")
    assert read.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism
    found = {}
    for r in read.orderBy("path", "seq").collect():
        found.setdefault(r.path, []).append(r.line)
    assert found == {uri(tmp_path / "part" / f"s{i}" / "a1.log"): [f"{i},s", f"x{i}", f"y{i}", "", f"z{i}"] for i in range(400)}
    assert lines.list_files(spark, str(tmp_path)).count() == 400


def test_tables_are_read_by_the_header_of_their_own_file(spark, tmp_path, monkeypatch):
    for name, text in (("a", "\ufeffx,y\n1,2\n"), ("b", 'y,z,x\n\n4,9,"3,5"\n6\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.csv").write_text(text)
    monkeypatch.setattr(lines, "SPLIT_BYTES", 4)
    rows = lines.read_table(spark, str(tmp_path), "t.csv", ["x", "y", "w"]).orderBy("path", "seq").collect()
    assert [(r.x, r.y, r.w) for r in rows] == [("1", "2", None), ("3,5", "4", None), (None, "6", None)]


def test_epoch_text_in_any_session_zone(spark):
    rows = spark.createDataFrame([("1970-01-01T00:00:10Z",), ("-3",)], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert [r[0] for r in rows.select(epoch_seconds("t")).collect()] == [10.0, -3.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_epoch_text_ignores_zone(spark):
    rows = spark.createDataFrame([("12.5",), ("1970-01-01T00:00:10+02:00",), ("1970-01-01 00:00:11",), ("x",)], "t string")
    assert [r[0] for r in rows.select(epoch_seconds("t")).collect()] == [12.5, 10.0, 11.0, None]


def test_discovery_pairs_and_missing_companions(spark, tmp_path):
    sub = tmp_path / "x"
    sub.mkdir()
    for name in ("0001-0000-0000", "0001-0005-0000"):
        (sub / f"{name}.log").write_text("0,s,1,0\n")
        (sub / f"{name}.qoe.log").write_text("0,btr,1\n")
        (sub / f"{name}.bw").write_text('{"scale": 4.0}')
    row = discovery.discover_line_logs(spark, str(tmp_path)).collect()
    assert [(r.source_id, r.identity, r.offset, r.repeat, r.condition) for r in row] == [("x/0001-0000-0000.log", "0001", 0, 0, "bw4")]
    (sub / "0002-0000-0001.log").write_text("0,s,1,0\n")
    with pytest.raises(ValueError, match="missing player"):
        discovery.discover_line_logs(spark, str(tmp_path))


def test_incremental_listing(spark, tmp_path):
    (tmp_path / "a.log").write_text("1")
    (tmp_path / "b.log").write_text("2")
    listing = file_digests(spark, str(tmp_path), "*.log")
    done = listing.where(F.col("path").endswith("a.log")).withColumn("parser_version", F.lit("1"))
    assert [r.path[-5:] for r in discovery.unprocessed(listing, done, "1").collect()] == ["b.log"]
    assert discovery.unprocessed(listing, done, "2").count() == 2


def test_verified_tables_detect_tampering(spark, tmp_path):
    root = str(tmp_path / "out")
    stores.save_tables(spark, root, {"t": spark.range(10)}, {"kind": "x"})
    assert stores.load_tables(spark, root, ["t"])["t"].count() == 10
    spark.range(3).write.mode("append").parquet(f"{root}/t")
    with pytest.raises(ValueError, match="digest"):
        stores.load_tables(spark, root, ["t"])


def test_reports_scan_skips_unusable(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"config": {"seed": 1}, "accuracy": 0.5}')
    (tmp_path / "b.json").write_text('{"accuracy": 0.5}')
    (tmp_path / "c.json").write_text("{not json")
    assert [r.accuracy for r in stores.read_reports(spark, str(tmp_path), "config struct<seed:int>, accuracy double").collect()] == [0.5]


def test_npz_enrol_and_recognise(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(6):
        t = np.sort(rng.uniform(0, 60, 80)) + 5
        np.savez(tmp_path / f"s{i}.npz", times=t, directions=rng.integers(0, 2, 80), lengths=rng.integers(50, 1500, 80).astype(float))
        rows.append({"label": f"video{i % 2}", "path": f"s{i}.npz", "format": "npz"})
    np.savez(tmp_path / "empty.npz", times=np.zeros(0), directions=np.zeros(0), lengths=np.zeros(0))
    with open(tmp_path / "manifest.csv", "w", newline="") as stream:
        writer = csv.DictWriter(stream, ["label", "path", "format"])
        writer.writeheader()
        writer.writerows(rows[:4])
    packets, facts, rejected = traces.read_npz_traces(spark, str(tmp_path))
    assert facts.count() == 6 and rejected.first().reason == "empty_trace"
    assert packets.groupBy("session_id").agg(F.min("t").alias("m")).where("m <> 0").count() == 0
    data = DataConfig(tokens=10)
    stats = features.norm_stats(packets, facts, data)
    prints = features.fingerprints(packets, stats, data)
    manifest = stores.read_manifest(spark, str(tmp_path / "manifest.csv")).withColumnRenamed("path", "session_id")
    gallery = matching.enroll(prints, manifest)
    assert gallery.count() == 4 and gallery.select("label").distinct().count() == 2
    out = matching.recognize(prints, gallery, MatchConfig(block_rows=2)).collect()
    assert len(out) == 6 and all(set(r.scores) == {"video0", "video1"} for r in out)
    same = {r.query_id: r.confidence for r in matching.recognize(prints, gallery, MatchConfig(block_rows=64)).collect()}
    assert all(abs(same[r.query_id] - r.confidence) < 1e-9 for r in out)
    assert all(r.label is None for r in matching.recognize(prints, gallery, MatchConfig(), threshold=9.0).collect())


def test_prepare_line_logs_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(5)
    for identity in range(6):
        for repeat in range(3):
            stem = tmp_path / f"{identity:04d}-0000-{repeat:04d}"
            t = np.sort(rng.uniform(0, 70e9, 50)).astype(int)
            t[0], t[-1] = 0, 69_000_000_000
            body = "".join(f"{x},{'s' if i % 3 else 'r'},{rng.integers(50, 1500)},{1000 + x // 1_000_000}\n" for i, x in enumerate(t))
            if (identity, repeat) == (1, 2):
                body = (tmp_path / "0001-0000-0001.log").read_text()
            stem.with_name(stem.name + ".log").write_text(body)
            stem.with_name(stem.name + ".qoe.log").write_text("".join(f"{1000 + 1000 * k},btr,{rng.integers(100, 5000)}\n" for k in range(60)))
            stem.with_name(stem.name + ".bw").write_text('{"scale": 2}')
    (tmp_path / "0009-0000-0000.log").write_text("0,s,60,1000\n")
    (tmp_path / "0009-0000-0000.qoe.log").write_text("1000,btr,1\n")
    (tmp_path / "0009-0000-0000.bw").write_text('{"scale": 2}')
    out = prepare(spark, str(tmp_path), "line", restarts=2)
    reasons = {(r.source_id, r.reason) for r in out.excluded.collect()}
    assert reasons == {("0001-0000-0002.log", "duplicate"), ("0009-0000-0000.log", "traffic_too_short")}
    rows = out.sessions.collect()
    assert len(rows) == 17 and {r.mode for r in rows} <= {"L", "T", "H"} and {r.split for r in rows} == {"train", "validation", "test"}
    assert len({(r.identity, r.split) for r in rows}) == 6 and all(len(r.id) == 24 for r in rows)
    assert out.stats.count() == 15
