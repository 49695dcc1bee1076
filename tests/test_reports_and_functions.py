"""VARIANT reports, the alignment table function and the merged AUROC."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import udtf
from sessionloom.operators import metrics
from sessionloom.sources import reports


def test_flatten_and_keys_ignore_order_and_seed(spark, tmp_path):
    texts = {"a": '{"config": {"b": {"y": 1, "x": [true, {}, []]}, "training": {"seed": 1, "device": "cpu", "lr": 0.1}, "k.l": "é"}}',
             "b": '﻿{"config":{"k.l":"é","training":{"lr":0.1,"device":"gpu","seed":2,"threads":4},"b":{"x":[true,{},[]],"y":1}},"accuracy":0.5}',
             "c": '{"config": {"b": {"y": 2}}}', "broken": '{"config": {', "bare": '{"accuracy": 1}', "text": '"config"'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    documents = reports.read_documents(spark, str(tmp_path)).withColumn("name", F.regexp_extract("path", r"([a-z]+)\.json$", 1))
    problems = {r["name"]: r.problem for r in documents.collect()}
    assert problems == {"a": None, "b": None, "c": None, "broken": "broken", "bare": "no_config", "text": "no_config"}
    config = documents.where("name = 'a'").select("name", F.variant_get("report", "$.config", "variant").alias("v"))
    assert {r.at: r.json for r in reports.flatten(config, "name", "v").collect()} == {
        "b.y": "1", "b.x[0]": "true", "b.x[1]": "{}", "b.x[2]": "[]", "training.seed": "1", "training.device": '"cpu"', "training.lr": "0.1", '"k.l"': '"é"'}
    rows = {r.path[-6]: r for r in reports.report_rows(documents.drop("name")).collect()}
    assert rows["a"].config_hash == rows["b"].config_hash != rows["c"].config_hash and (rows["b"].seed, rows["b"].accuracy) == (2, 0.5)


def test_auroc_counts_ties_across_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.random() < 0.4, float(rng.randint(0, 30))) for _ in range(900)] + [(True, 7.0)] * 300 + [(False, float("nan")), (True, None)]
    frame = spark.createDataFrame(rows, "known boolean, confidence double")
    good = [(k, c) for k, c in rows if c is not None and c == c]
    known, unknown = [c for k, c in good if k], [c for k, c in good if not k]
    want = sum((a > b) + 0.5 * (a == b) for a in known for b in unknown) / (len(known) * len(unknown))
    got = metrics.auroc_by_merging(frame).first()
    assert (got.known_count, got.unknown_count) == (len(known), len(unknown)) and got.auroc == pytest.approx(want, abs=1e-15)
    assert metrics.auroc_by_merging(frame.where("known")).first().auroc is None


def test_align_from_sql_passes_columns_and_refuses_bad_tables(spark):
    udtf.register(spark)
    rows = [(k, f"n{i}", 0.25, [[1.0, 0.0], [0.0, 1.0]], [1.0, 1.0], [[1.0, 0.0], [0.6, 0.8]], [1.0, 1.0]) for k in range(3) for i in range(300)]
    frame = spark.createDataFrame(rows, "k int, name string, g double, q_v array<array<double>>, q_r array<double>, s_v array<array<double>>, s_r array<double>")
    frame.createOrReplaceTempView("some_pairs")
    plain = spark.sql("SELECT * FROM align(TABLE(some_pairs) PARTITION BY (k), 'diagonal')")
    assert plain.columns == ["k", "name", "local", "overlap", "score"] and plain.count() == 900
    row = plain.first()
    assert row.local == pytest.approx(0.9) and row.overlap is None and row.score == pytest.approx(0.5 * 0.25 + 0.45)
    assert spark.sql("SELECT score FROM align(TABLE(some_pairs) PARTITION BY (k), alignment => 'none')").first().score == 0.25
    for bad in ("align(TABLE(some_pairs) PARTITION BY (k), 'other')", "align(TABLE(SELECT 1 AS g))", "align(5)"):
        with pytest.raises(Exception, match="align|alignment|g"):
            spark.sql(f"SELECT * FROM {bad}").collect()
