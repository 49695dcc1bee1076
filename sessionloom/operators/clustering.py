"""K-means with hash-seeded restarts, all of them and all wanted K in the same passes over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..runtime import cut_lineage, ship_package

#: Squares that a task holds at a time, rows that it assigns at once, and the share of the squared lengths within which two squares may be equal.
CHUNK, STEP, ROUNDING = 1 << 22, 1024, 1e-12


class Fit(NamedTuple):
    """Best model of one K: centres in drawing order, sum of squared distances, number of the restart and its rounds."""

    centres: list[list[float]]
    cost: float
    restart: int
    rounds: int


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(-1)


def _draw(width: int, chosen: np.ndarray | None, text_ids: bool) -> Callable:
    """One step of k-means++ in every restart: each batch offers its winner of the race with the squared distances as rates."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, luck = _vectors(batch.column("x"), width), batch.column("luck").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            ids = batch.column("session_id").to_pylist()
            rank = np.empty(len(ids), dtype=np.int64)
            rank[sorted(range(len(ids)), key=lambda i: ids[i].encode() if text_ids else ids[i])] = np.arange(len(ids))
            restarts, times, rows = range(luck.shape[1]), [], []
            for r in restarts:
                rate = np.ones(len(x)) if chosen is None else _squares(x, chosen[r]).min(axis=1)
                with np.errstate(divide="ignore"):
                    time = np.where(rate > 0, -np.log(luck[:, r]) / np.where(rate > 0, rate, 1), np.inf)
                row = int(np.lexsort((rank, time))[0])
                times.append(float(time[row]))
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(restarts, pa.int32()), pa.array(times), batch.column("session_id").take(pa.array(rows)),
                                              batch.column("x").take(pa.array(rows))], names=["restart", "time", "session_id", "x"])

    return task


def _members(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Whether each centre of each run is the nearest to each row, (runs, K, rows); ``centres`` is (runs, K, width), ties go to the lower number.

    One product gives the expanded squares; where another centre is as near within rounding, the squares are taken by differences.
    """
    runs, k, width = centres.shape
    flat = centres.reshape(-1, width)
    if not (np.isfinite(x).all() and np.isfinite(flat).all()):
        return np.array([_squares(x, run).argmin(axis=1) == np.arange(k)[:, None] for run in centres])
    theirs, mine = (flat ** 2).sum(1), (x ** 2).sum(1)
    squares = (np.column_stack([-2 * flat, theirs]) @ np.column_stack([x, np.ones(len(x))]).T).reshape(runs, k, -1)
    best = squares.min(axis=1) + ROUNDING * (mine + theirs.max())
    near = squares <= best[:, None, :]
    for run in range(runs):
        if np.count_nonzero(near[run]) > len(x):
            rows = np.flatnonzero(near[run].sum(axis=0) > 1)
            near[run][:, rows] = _squares(x[rows], centres[run]).argmin(axis=1) == np.arange(k)[:, None]
    return near


def _assign(width: int, runs: list[np.ndarray], costed: bool) -> Callable:
    """Sums of each run and cluster over a task: rows, squared distances (if ``costed``) and coordinates of the rows nearest to a centre."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [len(centres) for centres in runs]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        alike = {k: [n for n, size in enumerate(sizes) if size == k] for k in dict.fromkeys(sizes)}
        total, costs, rows = np.zeros((ends[-1], width + 1)), np.zeros(ends[-1]), 0
        for batch in batches:
            whole = _vectors(batch.column("x"), width)
            rows += len(whole)
            for k, numbers in alike.items():
                centres = np.stack([runs[n] for n in numbers])
                step = max(1, min(STEP, CHUNK // (len(numbers) * k)))
                for lo in range(0, len(whole), step):
                    x = whole[lo:lo + step]
                    near = _members(x, centres)
                    if np.isfinite(x).all():
                        found = near.reshape(-1, len(x)).astype(float) @ np.column_stack([x, np.ones(len(x))])
                    else:
                        found = np.array([[*x[own].sum(axis=0), own.sum()] for own in near.reshape(-1, len(x))])
                    for i, n in enumerate(numbers):
                        total[starts[n]:ends[n]] += found[i * k:(i + 1) * k]
                        if costed:
                            place = near[i].argmax(axis=0)
                            costs[starts[n]:ends[n]] += np.bincount(place, weights=((x - runs[n][place]) ** 2).sum(axis=1), minlength=k)
        if rows:
            offsets = pa.array(np.arange(ends[-1] + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(runs)), sizes), pa.int32()), pa.array(np.arange(ends[-1]) - np.repeat(starts, sizes), pa.int32()),
                                              pa.array(total[:, width].astype(np.int64)), pa.array(costs),
                                              pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(total[:, :width]).ravel()))],
                                             names=["run", "cluster", "n", "cost", "sums"])

    return task


def _round(points: DataFrame, width: int, runs: list[np.ndarray], costed: bool = False) -> tuple[list[np.ndarray], list[float]]:
    """New centres and, if ``costed``, cost of the old ones for each run; a centre without rows stays. The driver gets one row per centre."""
    sums = points.select("x").mapInArrow(_assign(width, runs, costed), "run int, cluster int, n bigint, cost double, sums array<double>")
    total = sums.groupBy("run", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    fresh, costs = [r.copy() for r in runs], [0.0] * len(runs)
    for row in total.collect():
        costs[row["run"]] += row["cost"]
        if row["n"]:
            fresh[row["run"]][row["cluster"]] = np.array(row["sums"]) / row["n"]
    return fresh, costs


def kmeans(points: DataFrame, ks: Sequence[int], seed: int, restarts: int = 20, max_rounds: int = 300, tolerance: float = 1e-4) -> dict[int, Fit]:
    """Best of ``restarts`` K-means fits of (session_id, x) for every K in ``ks``.

    Restart r draws its centres by k-means++ from hashes of (seed, r, step, session_id): a row wins with a chance in proportion to
    its squared distance from the centres so far, ties go to the smallest id. A smaller K takes the first K of these. Lloyd rounds
    go on until the centres' squared shifts sum to at most ``tolerance`` times the mean variance, or ``max_rounds``. A cluster
    that loses all rows keeps its centre. The cheapest restart wins, costs rounded to six digits, ties by number.

    Every pass serves all restarts and all K: batches are summed inside tasks and combined map-side, and the driver holds the
    centres only, restarts x K x width numbers. Vectors must be of one length; no rows raise.
    """
    ship_package(points.sparkSession)
    points = cut_lineage(points.select("session_id", F.col("x").cast("array<double>").alias("x")))
    first = points.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("clustering needs rows")
    width, most = first["n"], max(ks)
    spread = points.agg(*[F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(width)]).first()
    limit = tolerance * float(np.mean([v for v in spread]))
    kind = points.schema["session_id"].dataType.simpleString()

    chosen: np.ndarray | None = None
    for step in range(most):
        lucky = points.select("session_id", "x", F.array(*[uniform(seed, r, step, F.col("session_id").cast("string")) for r in range(restarts)]).alias("luck"))
        offered = lucky.mapInArrow(_draw(width, chosen, kind == "string"), f"restart int, time double, session_id {kind}, x array<double>")
        won = offered.groupBy("restart").agg(F.min(F.struct("time", "session_id", "x")).alias("w")).select("restart", "w.x").collect()
        drawn = np.array([r["x"] for r in sorted(won, key=lambda r: r["restart"])])[:, None, :]
        chosen = drawn if chosen is None else np.concatenate([chosen, drawn], axis=1)

    runs = {(k, r): chosen[r, :k].copy() for k in ks for r in range(restarts)}
    rounds = dict.fromkeys(runs, 0)
    open_runs = list(runs)
    while open_runs:
        fresh, _ = _round(points, width, [runs[run] for run in open_runs])
        still = []
        for run, centres in zip(open_runs, fresh, strict=True):
            shift = ((centres - runs[run]) ** 2).sum()
            runs[run], rounds[run] = centres, rounds[run] + 1
            if shift > limit and rounds[run] < max_rounds:
                still.append(run)
        open_runs = still
    _, costs = _round(points, width, list(runs.values()), costed=True)
    best: dict[int, Fit] = {}
    for (k, r), cost in zip(runs, costs, strict=True):
        if k not in best or round(cost, 6) < round(best[k].cost, 6):
            best[k] = Fit(runs[k, r].tolist(), cost, r, rounds[k, r])
    return best


def nearest(x: Column, centres: list[list[float]]) -> Column:
    """Number of the nearest centre, the lower one at equal distance."""
    def square(centre: list[float]) -> Column:
        gaps = F.zip_with(x, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b))
        return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v)

    squares = F.array(*[square(c) for c in centres])
    return (F.array_position(squares, F.array_min(squares)) - 1).cast("int")
