"""Hard negatives by exact integer products: anchor tiles times candidate tiles, then heaps of positives and of score windows.

Vectors are scaled and floored to integers. Anchors are cut into blocks, candidates into groups; every (block, group) pair is one
cogroup of bounded size, so a hot label, id or vector changes nothing in the partitioning. A product of two tiles is Strassen's
recursion on int64 with zero padding: additions are exact, and since int64 arithmetic is a ring modulo 2^64, sums that wrap inside
the recursion still end in the true product as long as that fits. Where it might not, the tile is computed with Python integers.

The work is (anchors x rows) products, as the anchors are a stated query set against all rows. The first pass multiplies only rows
of an anchor's own label, the second all rows once the windows are known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage, ship_package

ANCHOR_BLOCK = 1024
GROUP_ROWS = 8192
TILE_ROWS = 2048
#: Below this size in any direction the recursion ends.
LEAF = 8
MOST_PARTITIONS = 10_000

_HEAP = "anchor_row bigint, slot int, id bigint, score bigint"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` by Strassen's seven products; odd sides get a row or column of zeros. Works for int64 and for Python integers."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ b
    if rows % 2 or inner % 2 or columns % 2:
        return strassen(_even(a), _even(b), leaf)[:rows, :columns]
    r, i, c = rows // 2, inner // 2, columns // 2
    a1, a2, a3, a4 = a[:r, :i], a[:r, i:], a[r:, :i], a[r:, i:]
    b1, b2, b3, b4 = b[:i, :c], b[:i, c:], b[i:, :c], b[i:, c:]
    out = np.empty((rows, columns), dtype=a.dtype)
    both = strassen(a1 + a4, b1 + b4, leaf)
    lower = strassen(a3 + a4, b1, leaf)
    right = strassen(a1, b2 - b4, leaf)
    left = strassen(a4, b3 - b1, leaf)
    upper = strassen(a1 + a2, b4, leaf)
    out[:r, :c] = both + left - upper + strassen(a2 - a4, b3 + b4, leaf)
    out[:r, c:] = right + upper
    out[r:, :c] = lower + left
    out[r:, c:] = both - lower + right + strassen(a3 - a1, b1 + b2, leaf)
    return out


def _even(matrix: np.ndarray) -> np.ndarray:
    """The matrix with a zero row or column where a side is odd."""
    out = np.zeros([n + n % 2 for n in matrix.shape], dtype=matrix.dtype)
    out[:matrix.shape[0], :matrix.shape[1]] = matrix
    return out


class Heaps:
    """The best ``size`` (score, candidate) of every row; candidates come in ascending rank, and of equal scores the first stays."""

    def __init__(self, rows: int, size: int, dtype, none: int):
        self.size, self.none = size, none
        self.scores = np.full((rows, size), none, dtype=dtype)
        self.places = np.full((rows, size), -1, dtype=np.int64)

    def add(self, scores: np.ndarray, first: int, rows: np.ndarray | slice = slice(None), places: np.ndarray | None = None) -> None:
        """Takes a tile of scores (``none`` where a pair does not count) of the candidates from ``first`` on, or at ``places``."""
        held = self.scores[rows]
        places = np.arange(first, first + scores.shape[1]) if places is None else places
        # Only rows whose last heap entry is beaten have to be merged.
        better = np.flatnonzero(scores.max(axis=1) > held[:, -1]) if scores.shape[1] else np.zeros(0, dtype=np.int64)
        if not len(better):
            return
        at = np.arange(len(self.scores))[rows][better]
        merged = np.concatenate([self.scores[at], scores[better]], axis=1)
        names = np.concatenate([self.places[at], np.broadcast_to(places, (len(at), len(places)))], axis=1)
        line = np.arange(len(at))
        for k in range(self.size):
            best = merged.argmax(axis=1)
            self.scores[at, k], self.places[at, k] = merged[line, best], names[line, best]
            merged[line, best] = self.none

    def table(self, anchor_rows: np.ndarray, slot: int, ids: list[int | None]) -> Iterator[tuple]:
        for row, k in zip(*np.nonzero(self.scores > self.none), strict=True):
            yield int(anchor_rows[row]), slot, ids[self.places[row, k]], int(self.scores[row, k])


def _matrix(column: pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    """Floors of the scaled components as doubles, shorter vectors filled with zeros."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * out)


def _width(column: pa.ChunkedArray) -> int:
    return int(np.diff(column.combine_chunks().offsets.to_numpy()).max(initial=0))


def _tiles(scale: float, step: Callable[..., list[tuple]]) -> Callable:
    """Cogroup function: brings both sides into integer matrices, candidates in rank order, and packs the rows of ``step``."""
    def task(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if anchors.num_rows and candidates.num_rows:
            ids = candidates.column("id").to_pylist()
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            candidates = candidates.take(pa.array(order))
            ids = [ids[i] for i in order]
            width = max(1, _width(anchors.column("vector")), _width(candidates.column("vector")))
            a, b = (_matrix(t.column("vector"), width, scale) for t in (anchors, candidates))
            # 100 times any score must fit as well; otherwise Python integers take over.
            small = 100.0 * width * max(1.0, np.abs(a).max()) * max(1.0, np.abs(b).max()) < 2.0 ** 62
            dtype, none = (np.int64, -(1 << 62)) if small else (object, -(1 << 2200))
            turn = (lambda m: m.astype(np.int64)) if small else np.vectorize(int, otypes=[object])
            names, codes = np.unique(np.array(anchors.column("label").to_pylist() + candidates.column("label").to_pylist(), dtype=object).astype(str),
                                     return_inverse=True)
            rows = step(anchors, turn(a), codes[:len(a)], turn(b), codes[len(a):], ids, dtype, none)
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["anchor_row", "slot", "id", "score"])

    return task


def _positive_step(size: int) -> Callable:
    def step(anchors, a, a_labels, b, b_labels, ids, dtype, none):
        heaps = Heaps(len(a), size, dtype, none)
        for label in np.unique(a_labels):
            mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(b_labels == label)
            for lo in range(0, len(theirs), TILE_ROWS):
                part = theirs[lo:lo + TILE_ROWS]
                heaps.add(strassen(a[mine], np.ascontiguousarray(b[part].T)), 0, mine, part)
        return list(heaps.table(anchors.column("anchor_row").to_numpy(), 0, ids))

    return step


def _negative_step(size: int, low: tuple[int, int], high: tuple[int, int]) -> Callable:
    def step(anchors, a, a_labels, b, b_labels, ids, dtype, none):
        wanted = anchors.column("positive_scores").to_pylist()
        slots = max(map(len, wanted))
        given = np.array([len(w) for w in wanted])
        scores_of = np.zeros((len(a), slots), dtype=dtype)
        for i, w in enumerate(wanted):
            scores_of[i, :len(w)] = w
        heaps = [Heaps(len(a), size, dtype, none) for _ in range(slots)]
        for lo in range(0, len(b), TILE_ROWS):
            scores = strassen(a, np.ascontiguousarray(b[lo:lo + TILE_ROWS].T))
            scores[a_labels[:, None] == b_labels[None, lo:lo + TILE_ROWS]] = none
            for slot, heap in enumerate(heaps):
                # low0 * p <= low1 * s and high1 * s <= high0 * p, as bounds on s: division rounds up below and down above.
                p = scores_of[:, slot]
                least, most = -((-low[0] * p) // low[1]), (high[0] * p) // high[1]
                inside = (scores >= least[:, None]) & (scores <= most[:, None]) & (scores > none) & (given > slot)[:, None]
                heap.add(np.where(inside, scores, none), lo)
        rows = anchors.column("anchor_row").to_numpy()
        return [r for slot, heap in enumerate(heaps) for r in heap.table(rows, slot, ids)]

    return step


def _first(heaps: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Merges the heaps of all groups: the first ``size`` rows of each key, limited before the shuffle, with their ``place`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return heaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def mine(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, positives: int = 5,
         negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of every row for which ``anchor`` holds.

    Scores are inner products of the vectors after ``floor(scale * x)``; higher ones come first, ties by smaller ``key``, a null key
    last. An anchor's positives are its first ``positives`` other rows of the same label. Each gets the first ``negatives`` rows of
    another label with low[0] * positive <= low[1] * negative and high[1] * negative <= high[0] * positive.

    Rows with a null label, a null vector, or a component that is null or not finite (also after scaling) take no part. Shorter
    vectors count as if filled with zeros. Repeated rows are rows of their own: each may be a positive or a negative of the others,
    and each repeated anchor returns its own rows. Anchors without positives, or positives without negatives, have no rows; an
    empty table gives none. A score beyond 64 bits ends the job with an error. Other columns are not read.
    """
    ship_package(rows.sparkSession)
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall(
        "vector", lambda x: F.coalesce(F.abs(x * F.lit(float(scale))) < F.lit(float("inf")), F.lit(False)))
    kept = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"),
                       F.coalesce(anchor, F.lit(False)).alias("is_anchor")).where(usable)
    counts = kept.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
    blocks, groups = max(1, -(-counts.a // ANCHOR_BLOCK)), max(1, -(-counts.n // GROUP_ROWS))
    tasks = min(blocks * groups, MOST_PARTITIONS)

    # Anchors are stored, so that their numbers are the same in both passes.
    anchors = cut_lineage(kept.where("is_anchor").select(F.monotonically_increasing_id().alias("anchor_row"), "id", "label", "vector"))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor_row"), F.lit(blocks)).cast("int"))
    spread = kept.select("id", "label", "vector", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("grp"))
    spread = spread.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "grp", "id", "label", "vector")
    candidates = spread.repartition(tasks, "block", "grp").groupBy("block", "grp")

    def product(side: DataFrame, step: Callable) -> DataFrame:
        dealt = side.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")).repartition(tasks, "block", "grp")
        return dealt.groupBy("block", "grp").cogroup(candidates).applyInArrow(_tiles(scale, step), _HEAP)

    # The anchor itself stands among the first positives + 1 of its label or is not needed; one row like it is taken out.
    own = F.aggregate(F.transform("vector", lambda x: F.floor(x * F.lit(float(scale)))), F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    nearest = _first(product(anchors.select("anchor_row", "block", "label", "vector"), _positive_step(positives + 1)), ["anchor_row"], positives + 1)
    listed = nearest.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("near"))
    named = listed.join(anchors.select("anchor_row", F.col("id").alias("anchor_id"), own.alias("own")), "anchor_row")
    itself = F.array_position(F.transform("near", lambda n: n["id"].eqNullSafe(F.col("anchor_id")) & (n["score"] == F.col("own"))), True)
    others = F.slice(F.filter("near", lambda n: n["place"] != F.col("itself")), 1, positives)
    found = cut_lineage(named.withColumn("itself", itself).select("anchor_row", "anchor_id", others.alias("near")).where(F.size("near") > 0))

    windows = anchors.join(found.select("anchor_row", F.col("near.score").alias("positive_scores")), "anchor_row")
    hard = _first(product(windows.select("anchor_row", "block", "label", "vector", "positive_scores"), _negative_step(negatives, low, high)),
                  ["anchor_row", "slot"], negatives)
    pairs = found.select("anchor_row", "anchor_id", F.posexplode("near").alias("slot", "p"))
    return pairs.join(hard, ["anchor_row", "slot"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
