"""Exact nearest class in a large gallery with few alignments: pivots cut regions, bounds cut pairs.

A pair scores lambda * g + (1 - lambda) * local, where g is a product of global vectors and local, an average of token similarities,
is at most their largest one and never above 1 (tokens have length 1). What cannot reach a score already found is not aligned:

* gallery rows lie in the region of their nearest pivot; with its radius, q.s <= q.p + |q| * radius bounds g for a whole region,
  and a query never meets the blocks of a region that is cut;
* in a block, pairs are cut by their own g, then by their largest token similarity, and the rest is aligned best bound first.

A first pass aligns, per query, the pairs of best bound in each block of its most promising regions, which gives the score to beat.
What bounds cannot cut grows with queries x rows (64 random dimensions leave pivots nothing to cut): such a pair costs its share of one
matrix product, few of them token similarities and very few an alignment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.hashing import hash_text
from ..runtime import cut_lineage, ship_package
from .alignment import align_stack, partial_monotone_local
from .blocks import join_blocks, matrix, pack

#: Pairs of a query aligned in the first round, best bound first.
STEP = 16
#: Pairs whose token similarities are held at once.
CHUNK = 4096
#: The first pass looks at so many regions and aligns one of so many rows of a block at most.
FIRST_REGIONS = 8
FIRST_SHARE = 128
#: Gallery blocks of a region that one key holds; larger regions are several keys.
KEY_BLOCKS = 4
#: A pivot stands for so many gallery rows at least; smaller regions would hide their best pairs from each other.
REGION_ROWS = 512
SLACK = 1e-9
#: More than single precision can lose in a product of two tokens.
SINGLE_SLACK = 1e-5


def _regions(pivots: np.ndarray):
    def task(batches):
        for batch in batches:
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            squares = ((z[:, None, :] - pivots[None]) ** 2).sum(-1)
            nearest = squares.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(np.sqrt(squares[np.arange(len(z)), nearest]))],
                                             names=[*batch.schema.names, "region", "gap"])

    return task


def _bounds(pivots: np.ndarray, numbers: np.ndarray, radii: np.ndarray):
    def task(batches):
        for batch in batches:
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bound = z @ pivots[numbers].T + np.sqrt((z ** 2).sum(1))[:, None] * radii
            best = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_REGIONS]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                     for x in (numbers[best].astype(np.int32), bound)]
            yield pa.RecordBatch.from_arrays([batch.column("session_id"), *lists], names=["session_id", "regions", "bounds"])

    return task


def _tokens(row, side: str, rows: int):
    r = matrix(row[f"{side}_r"], rows)
    return matrix(row[f"{side}_v"], rows).reshape(rows, r.shape[1], -1), r


def _largest(q_v: np.ndarray, s_v: np.ndarray) -> np.ndarray:
    """Bound of the largest token similarity of one query's tokens (m, k) with those of each row (n, m, k), both in single precision."""
    out = np.empty(len(s_v), dtype=np.float32)
    for lo in range(0, len(s_v), CHUNK):
        part = s_v[lo:lo + CHUNK]
        out[lo:lo + CHUNK] = (part.reshape(-1, part.shape[2]) @ q_v.T).reshape(len(part), -1).max(axis=1)
    return out + SINGLE_SLACK


def _locals(q_v, q_r, s_v, s_r, config: MatchConfig) -> np.ndarray:
    """Local scores of pairs given row by row."""
    similarity = np.matmul(q_v, s_v.swapaxes(1, 2))
    if config.alignment == "pma":
        return partial_monotone_local(similarity, (q_r > 0)[:, :, None] & (s_r > 0)[:, None, :], config)
    return align_stack(similarity, q_r, s_r, config)[0]


def _block(config: MatchConfig, first: bool):
    """Per query of a block pair: best score with its label, pairs aligned and pairs met. Queries carry the score to beat behind z.

    Pairs that no bound cuts are aligned for all queries of the block at once, in rounds of twice as many each, best bounds first.
    """
    lam = config.lambda_z

    def open_pairs(g, q_v, s_v, best):
        """(rows, bounds) of what a query has to align, best bound first."""
        some = max(1, len(g) // FIRST_SHARE)
        rest = np.argsort(-g, kind="stable")[:8 * some] if first else np.flatnonzero(lam * g + (1 - lam) >= best - SLACK)
        bound = lam * g[rest] + (1 - lam) * np.maximum(_largest(q_v, s_v[rest]), 0.0)
        if first:
            keep = np.argsort(-bound, kind="stable")[:some]
        else:
            keep = np.flatnonzero(bound >= best - SLACK)
            keep = keep[np.argsort(-bound[keep], kind="stable")]
        return rest[keep], bound[keep]

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                nq, ns = len(row["q_ids"].values), len(row["s_ids"].values)
                held, s_z = matrix(row["q_z"], nq), matrix(row["s_z"], ns)
                labels = row["s_labels"].values.to_numpy(zero_copy_only=False)
                (q_v, q_r), (s_v, s_r) = _tokens(row, "q", nq), _tokens(row, "s", ns)
                q_z, best = np.ascontiguousarray(held[:, :-1]), held[:, -1].copy()
                g = q_z @ s_z.T
                names, aligned = np.full(nq, -1, dtype=np.int64), np.zeros(nq, dtype=np.int64)
                q_short, s_short = q_v.astype(np.float32), s_v.astype(np.float32)
                found = [open_pairs(g[q], q_short[q], s_short, best[q]) for q in range(nq)]
                count = np.array([len(rows) for rows, _ in found])
                q_of, s_of = np.repeat(np.arange(nq), count), np.concatenate([rows for rows, _ in found])
                bound, place = np.concatenate([b for _, b in found]), np.arange(len(q_of)) - np.repeat(np.cumsum(count) - count, count)
                upto = step = STEP
                while len(q_of):
                    now = place < upto
                    for lo in range(0, int(now.sum()), CHUNK):
                        qs, ss = q_of[now][lo:lo + CHUNK], s_of[now][lo:lo + CHUNK]
                        score = lam * (q_z[qs] * s_z[ss]).sum(axis=1) + (1 - lam) * _locals(q_v[qs], q_r[qs], s_v[ss], s_r[ss], config)
                        # Of a query's pairs the best comes first, of equal ones that with the lowest label.
                        order = np.lexsort((labels[ss], -score, qs))
                        top = order[np.flatnonzero(np.diff(qs[order], prepend=-1))]
                        q, value, label = qs[top], score[top], labels[ss[top]]
                        wins = (value > best[q]) | (value == best[q]) & ((names[q] < 0) | (label < names[q]))
                        best[q[wins]], names[q[wins]] = value[wins], label[wins]
                        aligned += np.bincount(qs, minlength=nq)
                    left = ~now & (bound >= best[q_of] - SLACK)
                    q_of, s_of, bound, place = q_of[left], s_of[left], bound[left], place[left]
                    step *= 2
                    upto += step
                hit = names >= 0
                yield pa.RecordBatch.from_arrays([row["q_ids"].values, pa.array(best, mask=~hit), pa.array(names, mask=~hit), pa.array(aligned),
                                                  pa.array(np.full(nq, ns))], names=["query_id", "score", "label", "aligned", "met"])

    return task


def nearest_class(queries: DataFrame, gallery: DataFrame, config: MatchConfig, pivots: int = 64) -> DataFrame:
    """(query_id, label, confidence, aligned, pairs): class of the gallery row with the highest score for every query, exactly.

    ``queries`` has session_id, z, v, r, ``gallery`` label (an integer) as well; token vectors have length one. Equal scores go to the lowest
    label. ``aligned`` of all ``pairs`` with the gallery were aligned. At most ``pivots`` gallery rows, drawn by hash, serve as pivots and
    are held by the driver; everything else meets block by block. An empty gallery or no queries give no rows.
    """
    spark = queries.sparkSession
    ship_package(spark)
    wanted = min(pivots, -(-gallery.count() // REGION_ROWS))
    drawn = gallery.orderBy(hash_text("pivot", F.col("session_id").cast("string"))).limit(wanted).select("z").collect()
    kind = queries.schema["session_id"].dataType.simpleString()
    if not drawn:
        return spark.createDataFrame([], f"query_id {kind}, label bigint, confidence double, aligned bigint, pairs bigint")
    points = np.array([r["z"] for r in drawn], dtype=float)
    columns = gallery.select("session_id", F.col("label").cast("bigint").alias("label"), F.col("z").cast("array<double>").alias("z"), "v", "r")
    dealt = cut_lineage(columns.mapInArrow(_regions(points), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema) + ", region int, gap double"))
    heads = sorted(map(tuple, dealt.groupBy("region").agg(F.max("gap"), F.count("*")).collect()))
    numbers, radii, total = np.array([h[0] for h in heads]), np.array([h[1] for h in heads]), sum(h[2] for h in heads)
    shares = F.create_map(*[F.lit(int(x)) for h in heads for x in (h[0], -(-h[2] // (config.gallery_rows * KEY_BLOCKS)))])[F.col("region")]
    blocks = cut_lineage(pack(dealt.drop("gap"), ["region"], "session_id", config.gallery_rows, "s", label="label").withColumn("share", F.col("s_block") % shares))

    asked = queries.select("session_id", F.col("z").cast("array<double>").alias("z"), "v", "r")
    bounds = cut_lineage(asked.select("session_id", "z").mapInArrow(_bounds(points, numbers, radii), f"session_id {kind}, regions array<int>, bounds array<double>"))
    columns_of = ["q_ids", "q_z", "q_v", "q_r", "s_ids", "s_labels", "s_z", "s_v", "s_r"]
    schema = f"query_id {kind}, score double, label bigint, aligned bigint, met bigint"

    def met(side: DataFrame, first: bool) -> DataFrame:
        packed = pack(side.withColumn("z", F.array_append("z", F.col("beat"))).drop("beat"), ["region"], "session_id", config.block_rows, "q")
        packed = packed.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
        return join_blocks(packed, blocks, ["region", "share"]).select(*columns_of).mapInArrow(_block(config, first), schema)

    low = F.lit(-1e300)
    seeds = met(asked.join(bounds.select("session_id", F.explode("regions").alias("region")), "session_id").withColumn("beat", low), True)
    seeds = cut_lineage(seeds.groupBy("query_id").agg(F.max("score").alias("beat"), F.sum("aligned").alias("aligned")))
    known = bounds.drop("regions").join(seeds.withColumnRenamed("query_id", "session_id"), "session_id")
    named = F.arrays_zip(F.array(*[F.lit(int(n)) for n in numbers]).alias("region"), F.col("bounds").alias("bound"))
    open_regions = known.select("session_id", "beat", F.explode(named).alias("x")).where(
        F.lit(config.lambda_z) * F.col("x.bound") + F.lit(1 - config.lambda_z + SLACK) >= F.col("beat")).select("session_id", "beat", F.col("x.region").alias("region"))
    # The score to beat is found again by its own pair, so it starts a little lower.
    found = met(asked.join(open_regions.withColumn("beat", F.col("beat") - SLACK), "session_id"), False)
    best = found.groupBy("query_id").agg(F.max(F.when(F.col("label").isNotNull(), F.struct("score", (-F.col("label")).alias("minus")))).alias("b"), F.sum("aligned").alias("later"))
    return best.join(seeds, "query_id").select("query_id", (-F.col("b.minus")).alias("label"), F.col("b.score").alias("confidence"),
                                               (F.col("later") + F.col("aligned")).alias("aligned"), F.lit(total).cast("bigint").alias("pairs"))
