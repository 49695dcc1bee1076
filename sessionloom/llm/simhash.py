"""Near duplicates by SimHash: fingerprints of word shingles, linked by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints at most ``distance`` bits apart agree closely in some segment: with ``m``
segments, r = distance // m and a = distance - m * r, either one of the first a + 1 differs in at most r bits or one of the others in
at most r - 1 (else the whole would differ in more than ``distance``). Each segment has a table of its exact values; every
fingerprint asks it for all values of that small Hamming ball, and what it finds is verified over all bits. Nothing is lost and
no bucket is cut off.

Equal fingerprints are one node, so groups of copies cost one row each. Probes and tables meet in a plain equi-join, in which
adaptive execution can split a crowded value. Of the verified links only a spanning forest of each batch goes on to the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import connected_components
from ..runtime import cut_lineage, ship_package
from .text import free_name

BITS = 64
SEED = 42
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16
#: A fingerprint of at least this share of all rows is joined by broadcast; there are at most as many as the number says.
HOT_SHARE = 1000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, width: int = 4) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: a bit is set if it is in more than half the XXH64 values of its shingles."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(width, len(words)) - 1:].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, CHUNK):
        hashes = np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[lo:lo + CHUNK], ends[lo:lo + CHUNK], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprints(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = [fingerprint(t, width) if t else 0 for t in (texts[i].as_py() for i in range(len(texts)))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.int64())], names=["key", "fp"])

    return task


def segments_of(count: int, distance: int = 4) -> int:
    """Number of segments with the fewest rows asked for and found by ``count`` fingerprints: few long ones where there are many."""
    def cost(m: int) -> float:
        return sum(ball * (1 + count / 2.0 ** width) for _, width, radius in layout(m, distance) for ball in [_ball_size(width, radius)])

    return min((3, 2), key=cost)


def layout(segments: int, distance: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of the segments that are searched."""
    if segments < 2:
        raise ValueError("a fingerprint needs two segments at least")
    radius, rest = divmod(distance, segments)
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    places = [sum(widths[:i]) for i in range(segments)]
    return [(place, width, reach) for i, (place, width) in enumerate(zip(places, widths, strict=True))
            if (reach := radius if i <= rest else radius - 1) >= 0]


def _ball_size(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def links(nodes: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """(a, b): pairs a < b of the distinct 64-bit ``fp`` that differ in at most ``distance`` bits, from each segment that finds them."""
    parts = layout(segments or segments_of(nodes.count(), distance), distance)

    def value(n: int, place: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", place).bitwiseAND((1 << width) - 1).bitwiseOR(n << 48)

    def ball(n: int, place: int, width: int, radius: int) -> Column:
        centre = value(n, place, width)
        return F.transform(F.array(*[F.lit(m).cast("bigint") for m in _ball(width, radius)]), lambda m: centre.bitwiseXOR(m))

    table = F.array(*[value(n, place, width) for n, (place, width, _) in enumerate(parts)])
    asked = F.concat(*[ball(n, *part) for n, part in enumerate(parts)])
    tables = nodes.select(F.explode(table).alias("value"), F.col("fp").alias("b"))
    probes = nodes.select(F.explode(asked).alias("value"), F.col("fp").alias("a"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(tables, (probes["value"] == tables["value"]) & near).select("a", "b")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links of each batch only those that join two trees: the same components from fewer rows than nodes."""
    for batch in batches:
        root: dict[int, int] = {}

        def top(x, root=root):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        keep = []
        for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            a, b = top(a), top(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, distance: int = 4, segments: int | None = None) -> DataFrame:
    """(key, fingerprint, component_id): fingerprint in 16 hex digits and smallest key of its component, for every row of ``docs``.

    A-Z are lower-cased; shingles of ``width`` words count as often as they occur, a text of fewer words is one shingle, and a null
    text or one without words has fingerprint zero, which links like any other. Rows link when their fingerprints differ in at
    most ``distance`` bits. A row with a null key gets the component of its fingerprint, null where no row of it has a key; repeated
    keys are rows of their own. An empty table gives no rows; other columns are not read. ``segments`` changes the cost only.
    """
    ship_package(docs.sparkSession)
    marked = cut_lineage(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(_fingerprints(width), "key bigint, fp bigint"))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n")))
    found = links(nodes.select("fp"), distance, segments).mapInArrow(_forest, "a bigint, b bigint")
    roots = connected_components(found).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut_lineage(placed.join(lowest, "root").select("fp", "n", "component_id"))
    # A fingerprint with a large share of all rows would be one task of the join; of those there are at most HOT_SHARE.
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = named.where(F.col("n") * HOT_SHARE >= F.lit(total)).drop("n")
    rest = named.where(F.col("n") * HOT_SHARE < F.lit(total)).drop("n")
    rows = marked.join(F.broadcast(hot), "fp").unionByName(marked.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(rest, "fp"))
    return rows.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias(free_name(docs.select(key), "fingerprint")), "component_id")
