"""Trace signatures, duplicate groups and the cohort filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage


def trace_signature(packets: DataFrame, quantum: float, out: str, window: float = 60.0, slices: int = 1024) -> DataFrame:
    """(session_id, out): digest of the ordered (rounded time, direction, rounded length) rows before ``window``.

    A trace is digested in time slices and the slice digests are digested in turn, so a long trace is many small
    groups. Slices follow the rounded time; traces equal after rounding are therefore cut alike.
    """
    per_slice = max(1, int(round(window / quantum)) // slices)
    kept = packets.where((F.col("t") < window)).select(
        "session_id", "t", "seq", F.rint(F.col("t") / F.lit(quantum)).cast("bigint").alias("tick"),
        "direction", F.rint("length").cast("bigint").alias("size"))
    text = F.concat_ws(",", "tick", "direction", "size")
    part = kept.groupBy("session_id", F.floor(F.col("tick") / F.lit(per_slice)).alias("slice")).agg(
        F.sort_array(F.collect_list(F.struct("t", "seq", text.alias("text")))).alias("rows"))
    digests = part.select("session_id", "slice", F.sha2(F.expr("array_join(transform(rows, r -> r.text), ';')"), 256).alias("digest"))
    whole = digests.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("slice", "digest"))).alias("parts"))
    return whole.select("session_id", F.sha2(F.expr("array_join(transform(parts, p -> concat(p.slice, ':', p.digest)), ';')"), 256).alias(out))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): smallest node of each component, for nodes with an edge.

    ``edges`` has columns a, b. Alternates large-star and small-star steps; each is one minimum per node (combined
    map-side) and a join, and the rounds grow with the logarithm of the longest chain.
    """
    current = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if not _unsettled(current):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small_low = down.groupBy("a").agg(F.min("b").alias("low"))
        neighbours = down.join(small_low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = neighbours.unionByName(small_low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        current = cut_lineage(small)
    else:
        raise RuntimeError("component search did not settle")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _unsettled(edges: DataFrame) -> bool:
    """Whether edges (a above b) are not yet stars: some node has two parents, or a parent itself.

    Stars whose centre is below all leaves are exactly the components with their smallest nodes.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("child")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("child")))).alias("e"))
    per_node = ends.groupBy("e.node").agg(F.sum("e.child").alias("up"), F.min("e.child").alias("centre"))
    return bool(per_node.where("up > 1 or (up = 1 and centre = 0)").limit(1).collect())


def duplicate_groups(sessions: DataFrame, order: str = "session_id") -> DataFrame:
    """Sessions with ``component`` and ``reason`` (null = kept, duplicate or conflicting_duplicate).

    Sessions sharing an exact or a near signature belong together, transitively. Equal signature pairs are collapsed
    before the graph is built and group facts are computed per exact signature, so a signature shared by a third of
    all sessions costs one graph edge and one aggregate row. The kept row is the first in ``order``. Pass only the
    columns needed afterwards: the rows are materialised.
    """
    # Digests come from a pass over all packets or texts; the narrow rows are stored once and read several times.
    sessions = cut_lineage(sessions)
    return _marked(sessions, connected_components(_links(sessions)), _facts(sessions, order), order)


def _exact() -> Column:
    return F.concat(F.lit("e:"), "exact_signature")


def _links(sessions: DataFrame) -> DataFrame:
    return sessions.select(_exact().alias("a"), F.concat(F.lit("n:"), "near_signature").alias("b"))


def _facts(sessions: DataFrame, order: str) -> DataFrame:
    return sessions.groupBy(_exact().alias("exact_node")).agg(
        F.min("identity").alias("low"), F.max("identity").alias("high"), F.min(order).alias("first"))


def _marked(sessions: DataFrame, roots: DataFrame, facts: DataFrame, order: str) -> DataFrame:
    rooted = facts.join(roots.withColumnRenamed("node", "exact_node"), "exact_node")
    groups = rooted.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("component"))
    verdict = cut_lineage(rooted.select("exact_node", "root").join(groups, "root").select(
        "exact_node", "component", (F.col("low") != F.col("high")).alias("conflict")))
    marked = sessions.withColumn("exact_node", _exact()).join(verdict, "exact_node").drop("exact_node")
    reason = F.when(F.col("conflict"), "conflicting_duplicate").when(F.col(order) != F.col("component"), "duplicate")
    return marked.withColumn("reason", reason).drop("conflict")


def merge_components(stars: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of the graph of ``stars`` (node, root) with ``edges`` (a, b) added, without searching the old graph again.

    Ends that are known are replaced by their roots; only what is left of the new edges is searched, and only nodes whose root has
    moved are written anew. Roots stay the smallest nodes, as a component's smallest node is the smallest of its parts' roots.
    """
    fresh = edges.select("a", "b").where("a <> b").distinct()
    ends = fresh.select(F.col("a").alias("node")).unionByName(fresh.select(F.col("b").alias("node"))).distinct()
    known = cut_lineage(ends.join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("top"), F.col("root").isNull().alias("new")))
    top = lambda side: known.select(F.col("node").alias(side), F.col("top").alias(f"top_{side}"))
    contracted = fresh.join(top("a"), "a").join(top("b"), "b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))
    moved = connected_components(contracted).where("node <> root").withColumnRenamed("root", "to")
    old = stars.join(moved.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    added = known.where("new").select("node").join(moved, "node", "left").select("node", F.coalesce("to", "node").alias("root"))
    return old.unionByName(added)


def add_batch(spark: SparkSession, sessions: DataFrame, folder: str, version: int, order: str = "session_id") -> None:
    """Takes a batch of sessions into the duplicate index below ``folder``: version ``version`` is written from the one before it.

    A version holds the stars of the signature graph and the facts of every exact signature. An interrupted call leaves the version
    before it as it was; calling again writes the version anew.
    """
    batch = cut_lineage(sessions.select("exact_signature", "near_signature", "identity", order))
    stars, facts = connected_components(_links(batch)), _facts(batch, order)
    if version:
        before = f"{folder}/{version - 1}"
        stars = merge_components(spark.read.parquet(f"{before}/stars"), _links(batch))
        facts = spark.read.parquet(f"{before}/facts").unionByName(facts).groupBy("exact_node").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"))
    stars.write.mode("overwrite").parquet(f"{folder}/{version}/stars")
    facts.write.mode("overwrite").parquet(f"{folder}/{version}/facts")


def indexed_groups(spark: SparkSession, sessions: DataFrame, folder: str, version: int, order: str = "session_id") -> DataFrame:
    """:func:`duplicate_groups` of ``sessions``, all of them in the index, by one of its versions."""
    at = f"{folder}/{version}"
    return _marked(sessions, spark.read.parquet(f"{at}/stars"), spark.read.parquet(f"{at}/facts"), order)


def minimum_sessions(marked: DataFrame, minimum: int) -> DataFrame:
    """Adds the reason identity_below_minimum_sessions to kept rows of identities with too few of them."""
    counts = marked.where("reason is null").groupBy("identity").agg(F.count("*").alias("_kept"))
    joined = marked.join(counts, "identity", "left")
    below = F.col("reason").isNull() & (F.col("_kept") < minimum)
    return joined.withColumn("reason", F.when(below, "identity_below_minimum_sessions").otherwise(F.col("reason"))).drop("_kept")


def cohort_inventory(marked: DataFrame) -> DataFrame:
    """(kind, key, sessions): kept rows by identity and condition, dropped rows by reason, in one grouping-sets pass."""
    rows = marked.select(F.when(F.col("reason").isNull(), F.col("identity").cast("string")).alias("identity"),
                         F.when(F.col("reason").isNull(), F.col("condition")).alias("condition"), "reason")
    sets = rows.groupingSets([["identity"], ["condition"], ["reason"], []], "identity", "condition", "reason").agg(
        F.grouping_id().alias("g"), F.count("*").alias("sessions"))
    kind = F.when(F.col("g") == 3, "identity").when(F.col("g") == 5, "condition").when(F.col("g") == 6, "reason").otherwise("total")
    key = F.coalesce("identity", "condition", "reason", F.when(F.col("g") == 7, "discovered"))
    return sets.select(kind.alias("kind"), key.alias("key"), "sessions").where("key is not null")
