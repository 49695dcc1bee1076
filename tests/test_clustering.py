"""Seeded k-means against a plain version, and silhouettes of several labelings."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import clustering, modes
from sessionloom.runtime import cut_lineage


def plain_kmeans(points, k, seed, restarts, tolerance=1e-4):
    """Best (cost, restart, centres) with the same draws, one row at a time."""
    def luck(*parts):
        return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2 ** 48

    def square(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    width = len(points[0][1])
    means = [sum(x[i] for _, x in points) / len(points) for i in range(width)]
    limit = tolerance * sum(sum((x[i] - means[i]) ** 2 for _, x in points) / len(points) for i in range(width)) / width
    best = None
    for r in range(restarts):
        centres = []
        for step in range(k):
            def time(p, step=step, centres=centres, r=r):
                rate = min((square(p[1], c) for c in centres), default=1.0)
                return (-math.log(luck(seed, r, step, p[0])) / rate if rate > 0 else math.inf), p[0]

            centres.append(min(points, key=time)[1])
        shift = math.inf
        while shift > limit:
            groups = [[] for _ in centres]
            for _, x in points:
                groups[min(range(k), key=lambda c, x=x: (square(x, centres[c]), c))].append(x)
            fresh = [[sum(x[i] for x in g) / len(g) for i in range(width)] if g else c for g, c in zip(groups, centres, strict=True)]
            shift, centres = sum(square(a, b) for a, b in zip(fresh, centres, strict=True)), fresh
        cost = sum(min(square(x, c) for c in centres) for _, x in points)
        if best is None or round(cost, 6) < best[0]:
            best = round(cost, 6), r, centres
    return best


@pytest.mark.parametrize("ks", [[3], [2, 5]])
def test_kmeans_against_plain(spark, ks):
    rng = random.Random(1)
    points = [(f"s{i}", [rng.gauss(3 * (i % 4), 1), rng.gauss(-2 * (i % 3), 1)]) for i in range(120)] + [(f"t{i}", [1.0, 1.0]) for i in range(30)]
    fits = clustering.kmeans(spark.createDataFrame(points, "session_id string, x array<double>").repartition(5), ks, 7, restarts=4)
    for k in ks:
        cost, restart, centres = plain_kmeans(points, k, 7, 4)
        assert fits[k].restart == restart and fits[k].cost == pytest.approx(cost, abs=1e-5)
        for got, want in zip(fits[k].centres, centres, strict=True):
            assert got == pytest.approx(want, abs=1e-9)


def test_kmeans_with_fewer_places_than_clusters(spark):
    points = spark.createDataFrame([(i, [float(i % 2)]) for i in range(10)], "session_id bigint, x array<double>")
    fit = clustering.kmeans(points, [3], 1, restarts=3)[3]
    assert fit.cost == 0 and sorted({c[0] for c in fit.centres}) == [0.0, 1.0]
    assert {r.c for r in points.select(clustering.nearest(F.col("x"), [[0.0], [0.0], [1.0]]).alias("c")).collect()} == {0, 2}
    with pytest.raises(ValueError):
        clustering.kmeans(points.limit(0), [3], 1)


def test_fit_modes_names_every_row(spark):
    rng = random.Random(2)
    kinds = {"S": [0.9, 0.8, 1, 0, 0, 0, 3.0, 0.5], "T": [0.2, 0.2, 2, 0, 0, 0, 4.0, 0.3], "H": [0.0, 0.0, 9, 0, 0, 0, 8.0, 0.0]}
    rows = [(i, k, [v + rng.uniform(-0.02, 0.02) for v in kinds[k]]) for i, k in enumerate("STH" * 40)]
    frame = spark.createDataFrame(rows, "session_id bigint, wanted string, mode_features array<double>")
    training = frame.where("session_id < 60").select("session_id")
    named, facts = modes.fit_modes(frame, training, "playback", restarts=3)
    assert named.where("mode <> wanted").count() == 0 and named.count() == 120
    assert sorted(facts["names"].values()) == ["H", "S", "T"] and named.columns == [*frame.columns, "mode"]
    by_k = modes.silhouette_by_k(frame, training, restarts=3, top_k=5).orderBy("k").collect()
    assert [r.k for r in by_k] == [2, 3, 4, 5]
    assert [r.silhouette for r in by_k if r.best] == [max(r.silhouette for r in by_k)]


def test_silhouettes_agree_with_one_labeling(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random(), rng.random()], i % 3, 0 if i else 1) for i in range(700)]
    points = spark.createDataFrame(rows, "session_id bigint, x array<double>, a int, b int")
    many = {r.labeling: r for r in modes.silhouettes(points, ["a", "b"]).collect()}
    for label in "ab":
        one = modes.silhouette(points.select("session_id", F.col(label).alias("cluster"), "x")).first()
        assert many[label].silhouette == pytest.approx(one.silhouette) and many[label].rows == 700
    assert (many["a"].clusters, many["b"].clusters) == (3, 2)


def test_distance_sums_leave_a_task_once_per_slice(spark, monkeypatch):
    """Many blocks: the same values as pair by pair, near and equal rows far from zero, and few rows shuffled."""
    monkeypatch.setattr(modes, "SUM_ROWS", 40)
    monkeypatch.setattr(modes, "STRIP", 16)
    rng = random.Random(5)
    rows = [(i, [1e6 + rng.random(), rng.random() * 1e-3], i % 3, i % 90) for i in range(800)] + [(800 + i, [1e6, 0.5], i % 2, i) for i in range(4)]
    points = spark.createDataFrame(rows, "session_id bigint, x array<double>, a int, b int")
    packed = modes._cluster_sums(points, ["a", "b"])
    got = {(r.row, r.labeling, r.other): (r.total, r.members) for r in packed.collect()}
    assert len(got) == 804 * 93
    for i in (0, 17, 800, 803):
        for labeling in (0, 1):
            for other in {r[2 + labeling] for r in rows}:
                far = [math.dist(rows[i][1], r[1]) for r in rows if r[2 + labeling] == other]
                assert got[i, labeling, other] == (pytest.approx(sum(far), rel=1e-9, abs=1e-12), len(far))
    monkeypatch.setattr(modes, "HELD_SUMS", 50)
    again = {(r.row, r.labeling, r.other): (r.total, r.members) for r in modes._cluster_sums(points, ["a", "b"]).collect()}
    assert again == {k: (pytest.approx(v[0]), v[1]) for k, v in got.items()}
    monkeypatch.undo()
    plan = packed._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "Generate explode" not in plan


def test_sums_of_a_task_leave_it_once():
    """Many batches, equal centres, rows between two centres and far from zero: the rows of plain assignment, one row per run and cluster."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(500, 2)) + 1e6, np.tile([[1e6, 1e6 + 0.5]], (40, 1))])
    runs = [x[:3].copy(), np.array([[1e6, 1e6], [1e6, 1e6 + 1], [1e6, 1e6]]), x[[5, 5, 6, 7]].copy(), x[-2:].copy()]
    batches = [pa.RecordBatch.from_arrays([pa.array(x[lo:lo + 90].tolist())], names=["x"]) for lo in range(0, len(x), 90)]
    made = list(clustering._assign(2, runs, True)(iter(batches)))
    assert len(made) == 1 and made[0].num_rows == 12
    for row in made[0].to_pylist():
        squares = ((x[:, None] - runs[row["run"]]) ** 2).sum(-1)
        own = squares.argmin(axis=1) == row["cluster"]
        assert row["n"] == own.sum() and row["sums"] == pytest.approx(x[own].sum(axis=0)) and row["cost"] == pytest.approx(squares.min(axis=1)[own].sum())
    odd = pa.RecordBatch.from_arrays([pa.array([[0.0], [float("nan")], [float("inf")], [5.0]])], names=["x"])
    got = next(clustering._assign(1, [np.array([[0.0], [4.0]])], False)(iter([odd]))).to_pylist()
    assert [r["n"] for r in got] == [3, 1] and got[1]["sums"] == [5.0]


@pytest.mark.parametrize("few,wide", [(512, 128), (1, 128), (1, 1)])
def test_block_sums_in_every_way(monkeypatch, few, wide):
    monkeypatch.setattr(modes, "FEW_CELLS", few)
    monkeypatch.setattr(modes, "WIDE", wide)
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(150, 3)), rng.normal(size=(200, 3))
    b[:20] = a[:20]
    labels = np.column_stack([rng.integers(0, 3, 200), rng.integers(0, 80, 200) * 7 - 9])
    for x in (b, np.where(np.arange(200)[:, None] == 30, np.nan, b)):
        far = np.sqrt(((a[:, None] - x) ** 2).sum(-1))
        seen = {(number, label): (sums, rows) for number, label, sums, rows in modes._block_sums(a, x, labels)}
        assert set(seen) == {(number, label) for number in (0, 1) for label in labels[:, number].tolist()}
        for (number, label), (sums, rows) in seen.items():
            own = labels[:, number] == label
            if number == 1 or x is b:
                assert rows == own.sum() and sums == pytest.approx(far[:, own].sum(axis=1), rel=1e-9, abs=1e-12, nan_ok=True)


def test_features_are_computed_once_and_blocks_hold_rows_of_like_labels(spark, monkeypatch):
    made, blocks = spark.sparkContext.accumulator(0), []

    @F.udf("array<double>")
    def features(i):
        made.add(1)
        return [float(i % 4) * 5 + i / 1e4, float(i % 3)]

    frame = spark.range(600).select(F.col("id").alias("session_id"), features("id").alias("mode_features"))

    def kept(rows):
        out = cut_lineage(rows)
        if "ids" in out.columns:
            blocks.extend(out.collect())
        return out

    monkeypatch.setattr(modes, "SUM_ROWS", 50)
    monkeypatch.setattr(modes, "cut_lineage", kept)
    by_k = modes.silhouette_by_k(frame, spark.range(600).select(F.col("id").alias("session_id")), restarts=2, top_k=4).collect()
    assert len(by_k) == 3 and made.value == 600
    assert sorted(i for b in blocks for i in b.ids) == list(range(600)) and max(len(b.ids) for b in blocks) <= 75
    assert len({b.block for b in blocks}) == len(blocks)
    kinds = [len({tuple(b.own[i:i + 3]) for i in range(0, len(b.own), 3)}) for b in blocks]
    assert sum(kinds) <= len(blocks) + len({tuple(b.own[i:i + 3]) for b in blocks for i in range(0, len(b.own), 3)})
