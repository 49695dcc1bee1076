"""The trace data source: splits, pushdown, columns, and files that appear whole or not at all."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionloom.sources import tracefiles


def line_log(path, rows=500):
    path.write_text("﻿" + "".join(f"{7_000_000 + i * 1_000_000},{'s' if i % 3 else 'RECV'},{i}.5,{i}\n" + ("\n" if i % 50 == 0 else "") for i in range(rows)))


def test_splits_read_every_line_once(spark, tmp_path):
    tracefiles.register(spark)
    line_log(tmp_path / "a-0.log")
    (tmp_path / "b-1.log").write_text("5,s,1")
    (tmp_path / "empty-2.log").write_text("")
    (tmp_path / "c.qoe.log").write_text("not a trace\n")
    for split in (700, 1001, 10 ** 9):
        rows = spark.read.format("trace_log").option("split_bytes", split).load(str(tmp_path)).orderBy("session_id", "seq").collect()
        assert len(rows) == 501 and rows[-1].t == 0
        assert [(round(r.t * 1000), r.direction, r.length) for r in rows[:500]] == [(i, int(i % 3 > 0), i + 0.5) for i in range(500)]


def test_columns_and_time_filter_reach_the_reader(spark, tmp_path):
    tracefiles.register(spark)
    line_log(tmp_path / "a-0.log")
    (tmp_path / "a-0.log").open("a").write("9,odd,word\n")  # a length that only a reader of lengths would parse
    few = spark.read.format("trace_log").schema("t double, seq bigint").load(str(tmp_path)).where("t < 0.0995 and t >= 0.0495")
    assert few.count() == 50
    reader = tracefiles.TraceReader({"path": str(tmp_path)}, few.schema)
    from pyspark.sql.datasource import GreaterThan, LessThan, LessThanOrEqual
    left = list(reader.pushFilters([LessThan(("t",), 0.2), LessThanOrEqual(("t",), 0.1), GreaterThan(("t",), 0.0), LessThan(("seq",), 5)]))
    assert left == [GreaterThan(("t",), 0.0), LessThan(("seq",), 5)] and (reader.before, reader.upto) == (0.2, 0.1)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 102  # the odd line has t < 0
    assert [b.schema.names for b in reader.read(reader.partitions()[0])][0] == ["t", "seq"]


def test_written_files_and_npz(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 10).alias("k"), "id", F.concat(F.lit("d/"), (F.col("id") % 10).cast("string"), F.lit("-0.log")).alias("file"),
                                    F.concat_ws(",", (F.col("id") * 1000).cast("string"), F.lit("s"), F.col("id").cast("string")).alias("line"))
    tracefiles.write_named(rows, str(tmp_path / "lines"), ["k"], ["id"], encoding="utf-8-sig")
    found = sorted((tmp_path / "lines").rglob("*.log"))
    assert len(found) == 10 and not list((tmp_path / "lines").glob(".staging*"))
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbf") and len(f.read_text().splitlines()) == 100 for f in found)
    arrays = rows.select("k", "id", F.concat((F.col("k")).cast("string"), F.lit(".npz")).alias("file"), (F.col("id") / 4).alias("times"),
                         F.lit(1).alias("directions"), F.col("id").cast("double").alias("lengths"))
    tracefiles.write_named(arrays, str(tmp_path / "npz"), ["k"], ["id"])
    with np.load(next((tmp_path / "npz").rglob("3.npz"))) as raw:
        assert raw["lengths"].tolist() == list(range(3, 1000, 10))
    back = spark.read.format("trace_log").option("form", "npz").load(str(tmp_path / "npz")).where("t <= 100")
    assert back.count() == 410 and back.where("direction <> 1").count() == 0


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    rows = spark.range(100).select(F.concat((F.col("id") % 2).cast("string"), F.lit(".log")).alias("file"), F.col("id").cast("string").alias("line"))
    tracefiles.register(spark)
    root = tmp_path / "out"
    os.makedirs(root)
    with pytest.raises(Exception, match="apart"):  # rows of two files alternate
        rows.coalesce(1).write.format("named_files").mode("append").option("path", str(root)).save()
    assert list(root.rglob("*")) == []


def test_many_small_files_make_few_tasks(spark, tmp_path):
    for i in range(60):
        home = tmp_path / f"d{i % 3}"
        home.mkdir(exist_ok=True)
        (home / f"{i:03d}.log").write_text(f"0,s,{i}\n1000000000,r,{i}\n")
        np.savez(home / f"{i:03d}.npz", times=np.array([1.0, 3.0]), directions=np.array([1, 0]), lengths=np.array([i, i], dtype=float))
    line_log(tmp_path / "long-0.log")
    for form, rows, names in (("line", 620, 61), ("npz", 120, 60)):
        reader = tracefiles.TraceReader({"path": str(tmp_path), "form": form, "split_bytes": "100"}, StructType.fromDDL(tracefiles.PACKETS))
        shares = reader.partitions()
        read = [b for s in shares for b in reader.read(s)]
        assert len(shares) == 1 and len(read) == 1  # one task and one batch of rows
        assert read[0].num_rows == rows and len(set(read[0].column("session_id").to_pylist())) == names
