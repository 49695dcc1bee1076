"""Digest trees of files: blocks hashed apart, folded to one root, compared block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tracefiles

#: Children of a node: as many digests meet in one row.
FAN = 256


def block_digests(spark: SparkSession, root: str, pattern: str = ".", block_bytes: int = 8 << 20) -> DataFrame:
    """(file, path, block, bytes, digest) of every block of the files below ``root`` whose name fits the regular expression."""
    tracefiles.register(spark)
    return spark.read.format("file_blocks").option("pattern", pattern).option("block_bytes", block_bytes).load(root)


def tree_digests(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """(path, digest, bytes): root of each file's tree.

    A node is the SHA-256 of its children's digests in order, ``fan`` of them at most; a level is one grouped aggregation, and
    a file has its root when one node is left. A single block is a tree of one node above its digest.
    """
    totals = blocks.groupBy("path").agg(F.sum("bytes").alias("bytes"))
    level = blocks.select("path", "block", "digest")
    most = blocks.agg(F.max("block")).first()[0] or 0
    while True:
        children = level.groupBy("path", F.floor(F.col("block") / fan).alias("block")).agg(F.sort_array(F.collect_list(F.struct("block", "digest"))).alias("c"))
        level = children.select("path", "block", F.sha2(F.array_join("c.digest", ""), 256).alias("digest"))
        most //= fan
        if not most:
            return level.select("path", "digest").join(totals, "path")


def damaged_blocks(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(file, block, problem) of the blocks in which two listings of a folder differ: changed, missing or added. Files go by name."""
    before, after = (d.select("file", "block", F.col("digest").alias(n)) for d, n in ((stored, "before"), (current, "after")))
    problem = F.when(F.col("after").isNull(), "missing").when(F.col("before").isNull(), "added").otherwise("changed")
    return before.join(after, ["file", "block"], "full").where("not (before <=> after)").select("file", "block", problem.alias("problem"))
