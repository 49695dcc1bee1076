"""Exact pruned search against a full one."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.config import MatchConfig
from sessionloom.operators import search
from sessionloom.operators.alignment import align_pairs, partial_monotone, partial_monotone_local
from sessionloom.operators.blocks import join_blocks

CONFIG = MatchConfig(block_rows=16, gallery_rows=32)


def prints(rng, n, spread, first=0):
    centres = rng.normal(size=(6, 4, 3))
    rows = []
    for i in range(n):
        u = centres[i % 6] + spread * rng.normal(size=(4, 3))
        v = u / np.linalg.norm(u, axis=1, keepdims=True)
        z = u.ravel() / np.linalg.norm(u)
        rows.append((first + i, int(i % 6), z.tolist(), v.tolist(), [1.0] * 4 if i % 5 else [1.0, 0.0, 1.0, 1.0]))
    return rows


def full(queries, gallery):
    q_v, q_r, s_v, s_r = (np.array([r[k] for r in rows]) for rows in (queries, gallery) for k in (3, 4))
    out = {}
    for i, q in enumerate(queries):
        local, _, _ = align_pairs((q_v, q_r, s_v, s_r), i, i + 1, CONFIG)
        score = 0.5 * np.array([np.dot(q[2], s[2]) for s in gallery]) + 0.5 * local
        out[q[0]] = score.max(), min(s[1] for s, x in zip(gallery, score, strict=True) if x >= score.max() - 1e-12)
    return out


@pytest.mark.parametrize("region_rows, spread", [(10_000, 0.3), (20, 0.05), (20, 1.5)])
def test_same_as_full_search(spark, monkeypatch, region_rows, spread):
    monkeypatch.setattr(search, "REGION_ROWS", region_rows)
    rng = np.random.default_rng(4)
    rows = prints(rng, 260, spread)
    gallery, queries = rows[:200] + [(900, 1, *rows[0][2:])], rows[200:]  # one row twice under two labels
    columns = "session_id bigint, label bigint, z array<double>, v array<array<double>>, r array<double>"
    found = search.nearest_class(spark.createDataFrame(queries, columns).drop("label"), spark.createDataFrame(gallery, columns), CONFIG, pivots=8).collect()
    want = full(queries, gallery)
    assert len(found) == len(want)
    for r in found:
        assert (r.confidence, r.label) == (pytest.approx(want[r.query_id][0]), want[r.query_id][1]) and 0 < r.aligned and r.pairs == 201
    if spread < 1:
        assert sum(r.aligned for r in found) * 2 < sum(r.pairs for r in found)


def test_nothing_to_search(spark):
    columns = "session_id bigint, label bigint, z array<double>, v array<array<double>>, r array<double>"
    rows = spark.createDataFrame(prints(np.random.default_rng(1), 3, 0.1), columns)
    assert search.nearest_class(rows.limit(0), rows, CONFIG).count() == 0 and search.nearest_class(rows, rows.limit(0), CONFIG).count() == 0


def test_local_scores_without_logarithms():
    """Same as the logarithmic recurrence; also where sums of products would overflow or a side has no valid token."""
    rng = np.random.default_rng(8)
    for m, n, gamma, gap in ((8, 8, 0.1, 0.1), (3, 5, 0.3, 0.0), (1, 4, 0.1, 2.0), (6, 6, 0.002, 0.1)):
        config = MatchConfig(gamma=gamma, gap=gap)
        sims, valid = rng.uniform(-1, 1, (1100, m, n)), rng.random((1100, m, n)) < 0.8
        sims[:3], valid[3] = 1.0, False
        _, mass = partial_monotone(sims - config.delta, valid, gap, gamma)
        want = (mass * sims).sum((1, 2)) / (mass.sum((1, 2)) + config.epsilon)
        got = partial_monotone_local(sims, valid, config)
        assert np.isfinite(got).all() and np.abs(got - want).max() < 1e-9 and got[3] == 0


def test_pairs_of_a_block_are_aligned_together(monkeypatch):
    """Calls do not grow with the queries of a block, and the best of each query is found."""
    calls = []
    monkeypatch.setattr(search, "_locals", lambda *a, locals_=search._locals: calls.append(len(a[0])) or locals_(*a))
    rows = prints(np.random.default_rng(5), 300, 0.3)
    gallery, queries = rows[:200], rows[200:]

    def side(name, part, beat):
        lists = {"ids": [r[0] for r in part], "labels": [r[1] for r in part], "z": np.ravel([[*r[2], *beat] for r in part]).tolist(),
                 "v": np.ravel([r[3] for r in part]).tolist(), "r": np.ravel([r[4] for r in part]).tolist()}
        return {f"{name}_{k}": pa.array([x]) for k, x in lists.items()}

    columns = {**side("q", queries, [-1e300]), **side("s", gallery, [])}
    found = next(search._block(CONFIG, False)(iter([pa.RecordBatch.from_pydict(columns)]))).to_pylist()
    want = full(queries, gallery)
    assert [(r["query_id"], r["label"]) for r in found] == [(k, x[1]) for k, x in want.items()]
    assert [r["score"] for r in found] == pytest.approx([x[0] for x in want.values()])
    assert len(calls) < 10 and sum(calls) == sum(r["aligned"] for r in found) < 100 * 200


def test_region_of_copies_is_several_keys(spark, monkeypatch):
    """Many copies of one vector under several labels, next to its only other neighbours; ties go to the lowest label."""
    monkeypatch.setattr(search, "KEY_BLOCKS", 1)
    monkeypatch.setattr(search, "REGION_ROWS", 60)
    rows = prints(np.random.default_rng(9), 100, 0.5)
    gallery, queries = rows[:60] + [(500 + i, 9 - i % 4, *rows[7][2:]) for i in range(240)], rows[60:]
    columns = "session_id bigint, label bigint, z array<double>, v array<array<double>>, r array<double>"
    joined = []

    def join(q, s, group):
        joined.append([s.groupBy(*by).count().agg({"count": "max"}).first()[0] for by in (["region"], group)])
        return join_blocks(q, s, group)

    monkeypatch.setattr(search, "join_blocks", join)
    found = search.nearest_class(spark.createDataFrame(queries, columns).drop("label"), spark.createDataFrame(gallery, columns), CONFIG).collect()
    want = full(queries, gallery)
    assert {r.query_id: r.label for r in found} == {k: x[1] for k, x in want.items()}
    assert all(of_region > 4 and of_key == 1 for of_region, of_key in joined) and len(joined) == 2
