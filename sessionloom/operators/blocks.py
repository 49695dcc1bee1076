"""Fingerprints packed into bounded blocks, and block-by-block pair scoring over Arrow.

Two packed sides meet in an equi-join on their group; each joined row holds at most ``block_rows`` fingerprints per
side, so a group of any size is many rows and NumPy works on whole matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..runtime import ship_package
from .alignment import align_pairs


def pack(fingerprints: DataFrame, group: list[str], id_col: str, block_rows: int, side: str,
         label: str | None = None, expected: int | None = None, tokens: bool = True) -> DataFrame:
    """One row per (group, block) with parallel arrays of ids, labels, flattened z, v and r.

    ``expected`` is a known bound on the group size (episodes have one); without it the groups are counted and spread
    over enough hash blocks. ``tokens=False`` drops v and r before the shuffle.
    """
    if expected is not None:
        blocks = max(1, -(-expected // block_rows))
        numbered = fingerprints.withColumn("_blocks", F.lit(blocks))
    elif group:
        sizes = fingerprints.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block_rows)).alias("_blocks"))
        numbered = fingerprints.join(sizes, group)
    else:
        blocks = max(1, -(-fingerprints.count() // block_rows))
        numbered = fingerprints.withColumn("_blocks", F.lit(blocks))
    # Hash blocks of large groups vary around the target; small known groups stay in one block.
    numbered = numbered.withColumn(f"{side}_block", F.pmod(F.xxhash64(F.col(id_col)), F.col("_blocks")).cast("int"))
    label_col = F.col(label).cast("bigint") if label else F.lit(None).cast("bigint")
    item = [F.col(id_col).cast("bigint").alias("id") if dict(fingerprints.dtypes)[id_col] != "string"
            else F.col(id_col).alias("id"), label_col.alias("label"), F.col("z").alias("z")]
    if tokens:
        item += [F.flatten("v").alias("v"), F.col("r").alias("r")]
    packed = numbered.groupBy(*group, f"{side}_block").agg(F.collect_list(F.struct(*item)).alias("_items"))
    columns = [F.transform("_items", lambda x: x["id"]).alias(f"{side}_ids"),
               F.transform("_items", lambda x: x["label"]).alias(f"{side}_labels"),
               F.flatten(F.transform("_items", lambda x: x["z"])).alias(f"{side}_z")]
    if tokens:
        columns += [F.flatten(F.transform("_items", lambda x: x["v"])).alias(f"{side}_v"),
                    F.flatten(F.transform("_items", lambda x: x["r"])).alias(f"{side}_r")]
    return packed.select(*group, f"{side}_block", *columns)


def matrix(values, rows: int) -> np.ndarray:
    """A list scalar of doubles as a (rows, width) array without copying element by element."""
    flat = np.asarray(values.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(rows, -1)


def join_blocks(queries: DataFrame, supports: DataFrame, group: list[str]) -> DataFrame:
    """Every query block next to every support block of its group.

    Catalyst picks a broadcast only while the packed supports are below the broadcast threshold. With no group the
    query blocks are spread over the support blocks by an explicit block number, so both sides still shuffle on a key.
    """
    if group:
        return queries.join(supports, group)
    count = supports.agg(F.max("s_block").alias("_top"))
    # One row holding the highest block number.
    spread = (queries.join(F.broadcast(count)).withColumn("s_block", F.explode(F.expr("sequence(0, _top)")))
              .drop("_top"))
    return spread.join(supports, "s_block")


def score_pairs(joined: DataFrame, group: list[str], config: MatchConfig, keep_mass: bool = False,
                gammas: list[float] | None = None) -> DataFrame:
    """Pairs (group, query_id, support_id, label, global, local, overlap, score[, mass]) of the joined blocks.

    With ``gammas`` a soft-DTW run is repeated per smoothing value in the same pass, adding a ``gamma`` column.
    """
    fields = _group_fields(joined, group)
    fields += [("query_id", _id_type(joined, "q_ids")), ("support_id", _id_type(joined, "s_ids")),
               ("label", pa.int64()), ("global", pa.float64()), ("local", pa.float64()), ("overlap", pa.float64()),
               ("score", pa.float64())]
    if keep_mass:
        fields.append(("mass", pa.list_(pa.float64())))
    if gammas:
        fields.append(("gamma", pa.float64()))
    schema = pa.schema(fields)

    def write(row, piece):
        ns, count = piece["supports"], len(piece["score"])
        within = pa.array(np.tile(np.arange(ns), count // ns))
        out = _group_values(row, group, schema, count)
        out["query_id"] = row["q_ids"].values.take(pa.array(np.repeat(np.arange(piece["start"], piece["stop"]), ns)))
        out["support_id"], out["label"] = row["s_ids"].values.take(within), row["s_labels"].values.take(within)
        for name in ("global", "local", "overlap", "score"):
            out[name] = pa.array(piece[name])
        if keep_mass:
            out["mass"] = pa.array(list(piece["mass"].reshape(count, -1)), pa.list_(pa.float64()))
        if gammas:
            out["gamma"] = pa.array(np.full(count, piece["gamma"]))
        return out

    return _map_blocks(joined, group, config, schema, write, keep_mass, gammas)


def score_partials(joined: DataFrame, group: list[str], config: MatchConfig, rule: str) -> DataFrame:
    """Per (group, query_id, label, block) partial class scores: pairs are reduced before anything is shuffled.

    ``top_c``/``sum_c`` and ``top_b``/``sum_b`` are shifted log-sum-exp parts with and without the pair score,
    ``total``, ``rows`` and ``best`` serve the mean and maximum rules.
    """
    numbers = ("top_c", "sum_c", "top_b", "sum_b", "total", "best")
    fields = _group_fields(joined, group)
    fields += [("query_id", _id_type(joined, "q_ids")), ("label", pa.int64()), ("rows", pa.int64())]
    fields += [(n, pa.float64()) for n in numbers]
    schema = pa.schema(fields)

    def write(row, piece):
        ns, nq = piece["supports"], piece["stop"] - piece["start"]
        labels = np.asarray(row["s_labels"].values.to_numpy(zero_copy_only=False), dtype=np.int64)
        order = np.argsort(labels, kind="stable")
        classes, first, sizes = np.unique(labels[order], return_index=True, return_counts=True)
        grid = {k: piece[k].reshape(nq, ns)[:, order] for k in ("score", "local", "overlap")}
        evidence = np.zeros((nq, ns))
        if rule in ("compatibility", "similarity"):
            evidence += config.beta_similarity * grid["local"]
        if rule in ("compatibility", "overlap") and config.alignment == "pma":
            evidence += config.beta_overlap * grid["overlap"]
        parts = {"total": np.add.reduceat(grid["score"], first, axis=1),
                 "best": np.maximum.reduceat(grid["score"], first, axis=1)}
        for suffix, exponent in (("c", evidence / config.tau_c),
                                 ("b", evidence / config.tau_c + grid["score"] / config.tau_s)):
            top = np.maximum.reduceat(exponent, first, axis=1)
            parts[f"top_{suffix}"] = top
            parts[f"sum_{suffix}"] = np.add.reduceat(np.exp(exponent - np.repeat(top, sizes, axis=1)), first, axis=1)
        count = nq * len(classes)
        out = _group_values(row, group, schema, count)
        picked = np.repeat(np.arange(piece["start"], piece["stop"]), len(classes))
        out["query_id"] = row["q_ids"].values.take(pa.array(picked))
        out["label"], out["rows"] = pa.array(np.tile(classes, nq)), pa.array(np.tile(sizes, nq).astype(np.int64))
        for name in numbers:
            out[name] = pa.array(parts[name].reshape(-1))
        return out

    return _map_blocks(joined, group, config, schema, write)


def _map_blocks(joined, group, config, schema, write, keep_mass=False, gammas=None):
    columns = group + ["q_ids", "q_z", "s_ids", "s_labels", "s_z"]
    if config.alignment != "none":
        columns += ["q_v", "q_r", "s_v", "s_r"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in columns}
                for piece in _pieces(row, config, keep_mass, gammas):
                    out = write(row, piece)
                    yield pa.RecordBatch.from_arrays([out[f.name] for f in schema], schema=schema)

    ddl = ", ".join(f"`{f.name}` {_ddl_type(f.type)}" for f in schema)
    ship_package(joined.sparkSession)
    return joined.select(*columns).mapInArrow(run, ddl)


def _pieces(row, config, keep_mass, gammas):
    """Scores of a few queries at a time against all supports of the block, so alignment tables stay small."""
    nq, ns = len(row["q_ids"].values), len(row["s_ids"].values)
    global_similarity = matrix(row["q_z"], nq) @ matrix(row["s_z"], ns).T
    tokens = None
    if config.alignment != "none":
        q_r, s_r = matrix(row["q_r"], nq), matrix(row["s_r"], ns)
        tokens = (matrix(row["q_v"], nq).reshape(nq, q_r.shape[1], -1), q_r,
                  matrix(row["s_v"], ns).reshape(ns, s_r.shape[1], -1), s_r)
    step = max(1, 4096 // ns)
    for start in range(0, nq, step):
        stop = min(nq, start + step)
        g = global_similarity[start:stop].reshape(-1)
        for gamma in gammas or [None]:
            local, overlap, mass = align_pairs(tokens, start, stop, config, gamma, keep_mass)
            zeros = np.zeros(len(g))
            yield {"start": start, "stop": stop, "supports": ns, "gamma": gamma, "mass": mass, "global": g,
                   "local": zeros if local is None else local, "overlap": zeros if overlap is None else overlap,
                   "score": g if local is None else config.lambda_z * g + (1 - config.lambda_z) * local}


def _group_fields(joined, group):
    return [(g, _arrow_type(joined.schema[g].dataType.simpleString())) for g in group]


def _group_values(row, group, schema, count):
    return {g: pa.array([row[g].as_py()] * count, schema.field(g).type) for g in group}


def _id_type(joined, column):
    return pa.string() if joined.schema[column].dataType.simpleString() == "array<string>" else pa.int64()


def _arrow_type(name: str):
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[name]


def _ddl_type(arrow_type) -> str:
    if pa.types.is_list(arrow_type):
        return "array<double>"
    return {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double"}[arrow_type]
