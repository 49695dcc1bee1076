"""Session modes by clustering on training rows, and the Euclidean silhouette."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from ..functions.hashing import hash_text
from ..runtime import cut_lineage, ship_package
from .blocks import matrix
from .clustering import kmeans, nearest

# Mode names in the order low, transition/medium, high.
BITRATE_NAMES = ("L", "T", "H")
PLAYBACK_NAMES = ("S", "T", "H")
#: Distance sums: rows of a block, rows of a block measured at once (few, so that they stay in cache), slices that the blocks are streamed in, sums a task keeps.
SUM_ROWS, STRIP, SLICES, HELD_SUMS = 4096, 64, 4, 1 << 23
#: Different rows of labels in a block up to which distances are added up by these, and labels of all labelings that one product serves.
FEW_CELLS, WIDE = 512, 128
#: Squared distances below this share of the squared lengths are not taken from the expanded square.
NEAR = 1e-6


def standardise(rows: DataFrame, training: DataFrame) -> tuple[DataFrame, list[float], list[float]]:
    """``x``: features standardised by training mean and population deviation (below 1e-6 counts as one).

    Mean and deviation are two short arrays, one entry per feature, returned to the driver with the model.
    """
    width = rows.select(F.size("mode_features").alias("n")).first()["n"]
    moments = training.agg(*[F.avg(F.col("mode_features")[i]).alias(f"m{i}") for i in range(width)],
                           *[F.stddev_pop(F.col("mode_features")[i]).alias(f"s{i}") for i in range(width)]).first()
    if moments["m0"] is None:
        raise ValueError("mode clustering needs training sessions")
    mean = [moments[f"m{i}"] for i in range(width)]
    std = [moments[f"s{i}"] if moments[f"s{i}"] >= 1e-6 else 1.0 for i in range(width)]
    centre, scale = (F.array(*[F.lit(float(v)) for v in values]) for values in (mean, std))
    x = F.zip_with(F.zip_with("mode_features", centre, lambda a, m: a - m), scale, lambda a, s: a / s)
    return rows.withColumn("x", x), mean, std


def name_clusters(centres: DataFrame, kind: str) -> DataFrame:
    """(cluster, mode) from (cluster, centre) on the raw scale; three clusters, one row each.

    By bitrate the clusters take the names in order of their mean over the first 30 entries. By playback the cluster with the
    most stalling (entries 0 and 1) is S, and of the others the one with the better delivery (entry 6 plus a fiftieth of
    entry 2 less entry 7) is H. Ties go to the lower cluster number.
    """
    def entry(i: int):
        return F.col("centre")[i]

    def place(value, *first):
        return F.row_number().over(Window.orderBy(*first, value, "cluster"))

    if kind == "bitrate":
        level = F.aggregate(F.slice("centre", 1, 30), F.lit(0.0), lambda s, x: s + x)
        return centres.select("cluster", F.element_at(F.array(*map(F.lit, BITRATE_NAMES)), place(level)).alias("mode"))
    stalled = centres.withColumn("_s", place((entry(0) + entry(1)).desc()))
    delivery = entry(6) + 0.02 * entry(2) - entry(7)
    ranked = stalled.withColumn("_d", place(delivery.desc(), F.col("_s") == 1))
    name = F.when(F.col("_s") == 1, PLAYBACK_NAMES[0]).when(F.col("_d") == 1, PLAYBACK_NAMES[2]).otherwise(PLAYBACK_NAMES[1])
    return ranked.select("cluster", name.alias("mode"))


def fit_modes(rows: DataFrame, training_ids: DataFrame, kind: str, seed: int = 20260814, restarts: int = 20):
    """(rows with ``mode``, model facts): clusters fitted on training rows only, every row predicted."""
    training = rows.join(training_ids.select("session_id"), "session_id", "left_semi")
    scaled, mean, std = standardise(rows, training)
    fit = kmeans(scaled.join(training_ids.select("session_id"), "session_id", "left_semi"), [3], seed, restarts)[3]
    raw = rows.sparkSession.createDataFrame([(k, [v * s + m for v, s, m in zip(c, std, mean, strict=True)]) for k, c in enumerate(fit.centres)],
                                            "cluster int, centre array<double>")
    names = {r["cluster"]: r["mode"] for r in name_clusters(raw, kind).collect()}
    lookup = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    facts = {"mean": mean, "std": std, "centers": fit.centres, "names": names, "cost": fit.cost, "rounds": fit.rounds}
    return scaled.withColumn("mode", lookup[nearest(F.col("x"), fit.centres)]).drop("x"), facts


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of two matrices, by differences."""
    return np.sqrt(sum((a[:, None, i] - b[None, :, i]) ** 2 for i in range(a.shape[1])))


def _strips(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First row and Euclidean distances to ``b`` of every strip of ``a``; the matrix is the same each time.

    One product gives the expanded squares; pairs close enough to lose digits by that are measured again.
    """
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    mine, theirs = (a ** 2).sum(1), (b ** 2).sum(1)
    left = np.column_stack([a, mine, np.ones(len(a))])
    right = np.ascontiguousarray(np.column_stack([-2 * b, np.ones(len(b)), theirs]).T)
    held = np.empty((min(STRIP, len(a)), len(b)))
    for lo in range(0, len(a), STRIP):
        squares = held[:len(a) - lo]
        np.matmul(left[lo:lo + STRIP], right, out=squares)
        limit = NEAR * (mine[lo:lo + STRIP].max() + theirs.max())
        rows, columns = np.divmod(np.flatnonzero(squares.ravel() < limit), len(b))
        near = squares[rows, columns] < NEAR * (mine[lo + rows] + theirs[columns])
        rows, columns = rows[near], columns[near]
        squares[rows, columns] = sum((a[lo + rows, i] - b[columns, i]) ** 2 for i in range(a.shape[1]))
        yield lo, np.sqrt(squares, out=squares)


def _label_sums(distance: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the columns, sums of the distances per row and label, and columns per label."""
    ids, place, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    if len(ids) <= 64:
        return ids, distance @ (place[:, None] == np.arange(len(ids))).astype(float), sizes
    return ids, np.add.reduceat(distance[:, np.argsort(place, kind="stable")], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=1), sizes


def _block_sums(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(labeling, label, sums, rows): distances of every row of ``a`` to the rows of ``b`` of each label in each column of ``labels``.

    With few labels one product per strip serves all labelings, unless the rows of ``b`` make few different rows of labels: then
    distances are added up by these first. Else each labeling adds them up.
    """
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        for number in range(labels.shape[1]):
            parts = [_label_sums(_distances(a[lo:lo + STRIP], b), labels[:, number]) for lo in range(0, len(a), STRIP)]
            ids, _, sizes = parts[0]
            yield from zip([number] * len(ids), ids.tolist(), np.concatenate([sums for _, sums, _ in parts]).T, sizes.tolist(), strict=True)
        return
    order = np.lexsort(labels.T[::-1])
    labels, b = labels[order], b[order]
    cells = np.concatenate([[0], np.flatnonzero((labels[1:] != labels[:-1]).any(axis=1)) + 1])
    kinds = [np.unique(column, return_inverse=True, return_counts=True) for column in labels.T]
    ends = np.cumsum([len(ids) for ids, _, _ in kinds])
    starts = ends - [len(ids) for ids, _, _ in kinds]
    by_cell = len(cells) <= FEW_CELLS
    if by_cell or ends[-1] <= WIDE:
        member = np.zeros((len(b), ends[-1]))
        for (_, place, _), start in zip(kinds, starts, strict=True):
            member[np.arange(len(b)), start + place] = 1
        member = member[cells] if by_cell else member
    sums = np.empty((len(a), ends[-1]))
    for lo, distance in _strips(a, b):
        part = sums[lo:lo + STRIP]
        if by_cell:
            np.matmul(np.add.reduceat(distance, cells, axis=1), member, out=part)
        elif ends[-1] <= WIDE:
            np.matmul(distance, member, out=part)
        else:
            for (ids, place, sizes), start in zip(kinds, starts, strict=True):
                part[:, start:start + len(ids)] = np.add.reduceat(distance[:, np.argsort(place, kind="stable")], np.cumsum(sizes) - sizes, axis=1)
    for number, ((ids, _, sizes), start) in enumerate(zip(kinds, starts, strict=True)):
        yield from zip([number] * len(ids), ids.tolist(), sums.T[start:start + len(ids)], sizes.tolist(), strict=True)


def _packed(kind) -> Callable:
    """Rows of a partition as blocks of about ``SUM_ROWS`` in their order: number, ids, labels and vectors, the last two laid out row by row."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 32, 0, pa.table({"id": pa.array([], kind), "own": pa.array([], pa.list_(pa.int64())),
                                                                               "x": pa.array([], pa.list_(pa.float64()))})

        def cut(rows: int) -> pa.RecordBatch:
            nonlocal made, held
            part, held, made = held.slice(0, rows).combine_chunks(), held.slice(rows), made + 1
            if part["x"].null_count:
                raise ValueError("a row has no vector")
            columns = [pa.concat_arrays(c.chunks) for c in (part["id"], part["own"], part["x"])]
            flat = [columns[0], columns[1].flatten(), columns[2].flatten()]
            return pa.RecordBatch.from_arrays([pa.array([first + made]), *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in flat]],
                                              names=["block", "ids", "own", "x"])

        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(held.schema)])
            while held.num_rows >= 2 * SUM_ROWS:
                yield cut(SUM_ROWS)
        if held.num_rows > SUM_ROWS * 3 // 2:
            yield cut(held.num_rows // 2)
        if held.num_rows:
            yield cut(held.num_rows)

    return task


def _cluster_sums(points: DataFrame, labelings: list[str]) -> DataFrame:
    """(row, labeling, own, other, total, members): distances of every row to every cluster of each labeling, summed, and their number.

    Rows are packed into blocks once, rows of like labels together, so that a block has few different ones. A task streams the blocks of a
    slice past few blocks of its own and keeps their sums, so the blocks are read again from the checkpoint but not shuffled again, and a
    row leaves a task once per slice and cluster. The number of slices is fixed: data shuffled grows with the rows, only the arithmetic
    with their square. More sums than ``HELD_SUMS`` are passed on early.
    """
    ship_package(points.sparkSession)
    kind = points.schema["session_id"].dataType
    if kind.simpleString() != "string":
        points, kind = points.withColumn("session_id", F.col("session_id").cast("bigint")), LongType()
    count, blocks = len(labelings), max(1, -(-points.count() // SUM_ROWS))
    rows = points.select(F.col("session_id").alias("id"), F.array(*[F.col(c).cast("bigint") for c in labelings]).alias("own"), F.col("x").cast("array<double>").alias("x"))
    dealt = rows.repartitionByRange(blocks, "own", F.xxhash64("id")).sortWithinPartitions("own")
    packed = cut_lineage(dealt.mapInArrow(_packed(to_arrow_type(kind)), f"block bigint, ids array<{kind.simpleString()}>, own array<bigint>, x array<double>"))
    left = packed.coalesce(SLICES).select(F.col("own").alias("s_own"), F.col("x").alias("s_x"))
    right = packed.select("block", "ids", F.col("own").alias("q_own"), F.col("x").alias("q_x"))
    schema = pa.schema([("row", to_arrow_type(kind)), ("labeling", pa.int32()), ("own", pa.int64()), ("other", pa.int64()), ("total", pa.float64()),
                        ("members", pa.int64())])

    def passed_on(held):
        for ids, own, sums in held.values():
            for (number, other), (total, members) in sums.items():
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), number, dtype=np.int32)), pa.array(own[:, number]), pa.array(np.full(len(ids), other)),
                                                  pa.array(total), pa.array(np.full(len(ids), members))], schema=schema)
        held.clear()

    def run(batches):
        held, cells = {}, 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                theirs = row["s_own"].values.to_numpy().reshape(-1, count)
                b = matrix(row["s_x"], len(theirs))
                if row["block"].as_py() not in held:
                    held[row["block"].as_py()] = row["ids"].values, row["q_own"].values.to_numpy().reshape(-1, count), {}
                ids, own, sums = held[row["block"].as_py()]
                a = matrix(row["q_x"], len(ids))
                for number, other, total, members in _block_sums(a, b, theirs):
                    if (number, other) not in sums:
                        sums[number, other] = [np.zeros(len(ids)), 0]
                        cells += len(ids)
                    sums[number, other][0] += total
                    sums[number, other][1] += members
                if cells > HELD_SUMS:
                    yield from passed_on(held)
                    cells = 0
        yield from passed_on(held)

    met = left.hint("shuffle_replicate_nl").crossJoin(right)
    return (met.mapInArrow(run, f"row {kind.simpleString()}, labeling int, own bigint, other bigint, total double, members bigint")
            .groupBy("row", "labeling", "own", "other").agg(F.sum("total").alias("total"), F.sum("members").alias("members")))


def _row_values(sums: DataFrame) -> DataFrame:
    """(labeling, own, value): the silhouette of every row under each labeling."""
    mine = F.col("own") == F.col("other")
    per_row = sums.groupBy("row", "labeling", "own").agg(
        F.max(F.when(mine, F.col("members"))).alias("size"), F.max(F.when(mine, F.col("total"))).alias("within"),
        F.min(F.when(~mine, F.col("total") / F.col("members"))).alias("b"))
    a = F.col("within") / (F.col("size") - 1)
    return per_row.select("labeling", "own", F.when(F.col("size") > 1, (F.col("b") - a) / F.greatest(a, F.col("b"))).otherwise(0.0).alias("value"))


def silhouette(points: DataFrame, sample: int | None = None, seed: int = 20260814) -> DataFrame:
    """One row: mean Euclidean silhouette of (session_id, cluster, x) over all rows.

    Only an explicit ``sample`` restricts it to that many seeded rows. Distances are summed per task, row and cluster; no
    pair leaves a task.
    """
    chosen = points.select("session_id", "cluster", "x")
    if sample is not None:
        chosen = chosen.orderBy(hash_text(seed, F.col("session_id"))).limit(sample)
    return _row_values(_cluster_sums(chosen, ["cluster"])).agg(F.avg("value").alias("silhouette"), F.count("*").alias("rows"))


def silhouettes(points: DataFrame, labelings: list[str]) -> DataFrame:
    """(labeling, silhouette, clusters, rows): mean Euclidean silhouette of every integer label column of (session_id, x, ...).

    All labelings share one pass: a pair of blocks is measured once, and its distances are summed per row, labeling and cluster.
    The arithmetic grows with the square of the rows; pass a sample where that is too much.
    """
    named = F.element_at(F.array(*[F.lit(c) for c in labelings]), F.col("labeling") + 1)
    return _row_values(_cluster_sums(points, labelings)).groupBy(named.alias("labeling")).agg(
        F.avg("value").alias("silhouette"), F.countDistinct("own").alias("clusters"), F.count("*").alias("rows"))


def silhouette_by_k(rows: DataFrame, training_ids: DataFrame, seed: int = 20260814, restarts: int = 20, top_k: int = 10) -> DataFrame:
    """(k, silhouette, best) of the training rows for every K from 2 to ``top_k`` below their number whose clusters all have rows.

    All K are fitted in the same passes and scored by one pass of distance blocks; ``best`` marks the highest, ties by lower K.
    """
    training = cut_lineage(rows.join(training_ids.select("session_id"), "session_id", "left_semi").select("session_id", "mode_features"))
    scaled = cut_lineage(standardise(training, training)[0].select("session_id", "x"))
    ks = range(2, min(top_k, scaled.count() - 1) + 1)
    if not ks:
        return rows.sparkSession.createDataFrame([], "k int, silhouette double, best boolean")
    fits = kmeans(scaled, ks, seed, restarts)
    labelled = scaled.select("session_id", "x", *[nearest(F.col("x"), fits[k].centres).alias(str(k)) for k in ks])
    scored = silhouettes(cut_lineage(labelled), [str(k) for k in ks]).withColumn("k", F.col("labeling").cast("int")).where("clusters = k")
    top = Window.orderBy(F.round("silhouette", 9).desc(), "k")  # one row per K
    return scored.select("k", "silhouette", (F.row_number().over(top) == 1).alias("best"))
