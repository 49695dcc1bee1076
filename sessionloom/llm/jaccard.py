"""Exact n-gram Jaccard join as a metric-space join: pivots, Voronoi regions, triangle-inequality windows, recursion.

The Jaccard distance is a metric, but nearly all pairs of texts lie at distance 1, where document pivots tell nothing apart.
So the first pivots are single shingles. Linked documents must share one of the first n - ceil(t n) + 1 shingles of each in
any common order; that prefix is the window of shingle regions into which a document is replicated, and rare shingles come
first. Every shingle region then takes its smallest document as pivot, regions with the same pivot become one, and from there
on distances are measured: the ball around a pivot is linked, and of the rest only documents within the threshold of an
unlinked one go on to the next pivot. Small regions do this inside one task; large ones measure their pivot's ball first and
go on with the members that are not yet connected to it, block by block.

Passes over the texts prepare this without moving them. A first one adds up a count-min sketch of document frequencies, of fixed
size; shingles that it calls hot are hot for every task, get a class by their estimate and are listed with their documents only.
Then tasks send each other shingle once per batch to its bucket, where frequencies are counted exactly; a document with fewer
than ceil(t n) shingles known elsewhere cannot have a link and is done. Shingles common within one batch are announced, not
listed. So no bucket grows with a hot passage, whether it is dense in one place or thin everywhere. Equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import connected_components
from ..runtime import cut_lineage, ship_package
from .text import ascii_lower, spare_memory, sparing, word_slices, words

#: A shingle this frequent in one batch counts as hot everywhere; the order treats all hot shingles alike.
HOT = 64
#: Counters of the sketch, and rows: a shingle's estimate is the least of its counters, never below its frequency.
SKETCH_BITS, SKETCH_ROWS = 18, 2
#: Hot by the sketch: an estimate of so many documents, and of so many times the mean counter.
SKETCH_LEAST, SKETCH_MEANS = 1024, 8
#: A set of at least this share of all documents is joined by broadcast; there are at most as many as the number says.
HOT_SHARE = 1000
#: Documents per bucket on average: a bucket holds about as many shingles as these.
DOCS_PER_BUCKET = 4000
#: Words handled at once in the first stage; bounds the memory of a task.
SLICE_WORDS = 1_000_000
#: Shingles looked up at once; rows of packed shingles leave a task in batches of about so many bytes.
PART, SENT_BYTES = 1 << 17, 1 << 21
#: Regions up to this many sets and bytes are joined inside one task; parts of larger ones come in blocks of so many bytes.
REGION_ROWS = 1000
BLOCK_BYTES = 16_000_000

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_PACKED = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary, docs array<bigint>"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()),
                           ("d", pa.binary()), ("e", pa.binary()), ("docs", pa.list_(pa.int64()))])
_POSTINGS, _HEADS, _FACTS = 0, 1, 2


def required(n: int, percent: int) -> int:
    """Shingles that a document of ``n`` shares with any document linked to it, at least."""
    return -(-percent * n // 100)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document, from the hashes of its words.

    A document with fewer than ``width`` words has its whole sequence as one shingle; one without words has none.
    """
    flat = flat.view(np.uint64)
    n = len(flat)
    mult = _MULT[:width] if width <= len(_MULT) else np.resize(_MULT, width) * np.arange(1, 2 * width, 2, dtype=np.uint64)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for j in range(width if n >= width else 0):
        rolled += flat[j:n - width + 1 + j] * mult[j]
    rolled = _scatter(rolled)
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if hi - lo >= width:
            hashes = np.sort(rolled[lo:hi - width + 1])
            out.append(hashes[_first(hashes)])
        elif hi > lo:
            one = (flat[lo:hi] * mult[:hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo)
            out.append(_scatter(one))
        else:
            out.append(flat[:0])
    return out


def _scatter(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _first(ordered: np.ndarray) -> np.ndarray:
    """Mask of the first of each run of equal values."""
    mask = np.ones(len(ordered), dtype=bool)
    mask[1:] = ordered[1:] != ordered[:-1]
    return mask


def _bounds(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    return np.append(np.flatnonzero(_first(ordered)), len(ordered))


def _row(bucket: int, kind: int, a=None, b=None, c=None, d=None, e=None, docs=None) -> tuple:
    return (bucket, kind, *[None if x is None else x.tobytes() for x in (a, b, c, d, e)], docs)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PACKED_ARROW)], schema=_PACKED_ARROW)


def _places(tokens: np.ndarray, row: int) -> np.ndarray:
    """Counter of each shingle in a row of the sketch."""
    return (_scatter(tokens + np.uint64(row + 1)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(width: int):
    """Per task: documents of each counter, counted in sets without repeats; only counters above zero leave it, packed."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), dtype=np.int64)
        for batch in (part for whole in batches for part in word_slices(whole, SLICE_WORDS // 5)):
            lists = batch.column("w")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
            sets = shingle_sets(flat, offsets - offsets[0], width)
            tokens = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            for row in range(SKETCH_ROWS):
                counts[row] += np.bincount(_places(tokens, row), minlength=1 << SKETCH_BITS)
        size = 1 << 12
        parts = counts.reshape(-1, size)
        used = np.flatnonzero(parts.any(axis=1))
        ends = pa.array(np.arange(len(used) + 1, dtype=np.int32) * size)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(parts[used].ravel()))], names=["part", "counts"])

    return task


def _add_up(part: pa.Table) -> pa.Table:
    counts = part.column("counts").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1).sum(axis=0)
    return pa.table({"part": part.column("part")[:1], "counts": pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts))})


def frequency_sketch(hashed: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch of the documents of every shingle: ``SKETCH_ROWS`` x 2^``SKETCH_BITS`` counters, 4 MB at any size of the input."""
    kinds = "part int, counts array<bigint>"
    parts = hashed.select("w").mapInArrow(sparing(_sketch(width)), kinds).groupBy("part").applyInArrow(_add_up, kinds)
    counts = np.zeros((SKETCH_ROWS << SKETCH_BITS >> 12, 1 << 12), dtype=np.int64)
    for row in parts.toLocalIterator():
        counts[row["part"]] = row["counts"]
    return counts.reshape(SKETCH_ROWS, -1)


def hot_classes(sketch: np.ndarray) -> np.ndarray:
    """Sketch with counters turned into classes: 0 where a shingle is not hot, else from ``HOT`` + 1 on by powers of two."""
    least = max(SKETCH_LEAST, SKETCH_MEANS * int(sketch.sum()) // sketch.size)
    return np.where(sketch >= least, HOT + 1 + np.log2(np.maximum(sketch, 1)).astype(np.int64), 0).astype(np.uint8)


def _class_of(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    out = np.empty(len(tokens), dtype=classes.dtype)
    for lo in range(0, len(tokens), PART):
        part = tokens[lo:lo + PART]
        out[lo:lo + PART] = np.min([classes[row][_places(part, row)] for row in range(len(classes))], axis=0)
    return out


def _send(width: int, buckets: int, shared):
    """Stage 1: from documents to postings, heads (document, set, size) and facts (set, size, its hot shingles with classes).

    A slice sends a row to each bucket that one of its shingles or sets belongs to, whatever the number of buckets.
    """
    def bucket_of(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), dtype=np.min_scalar_type(buckets))
        for lo in range(0, len(x), PART):
            out[lo:lo + PART] = (x[lo:lo + PART] >> np.uint64(20)) % np.uint64(buckets)
        return out

    def postings(tokens: np.ndarray, owner: np.ndarray, announced: np.ndarray, owner_ids: np.ndarray) -> Iterator[tuple]:
        """Owners and their shingles, cut by the shingles' buckets."""
        at = bucket_of(tokens)
        by = np.argsort(at, kind="stable")
        at = at[by]
        announced_at = bucket_of(announced)
        known_by = np.argsort(announced_at, kind="stable")
        announced_at = announced_at[known_by]
        present = np.union1d(at[_first(at)], announced_at)
        cuts, known_cuts = (np.stack([np.searchsorted(x, present, side) for side in ("left", "right")], axis=1).tolist() for x in (at, announced_at))
        del at
        for k, (lo, hi), (known_lo, known_hi) in zip(present.tolist(), cuts, known_cuts, strict=True):
            mine = by[lo:hi]
            own = owner[mine]
            runs_of = _bounds(own) if len(own) else np.zeros(1, dtype=np.int64)
            yield _row(k, _POSTINGS, owner_ids[own[runs_of[:-1]]], np.diff(runs_of).astype(np.uint32), tokens[mine], announced[known_by[known_lo:known_hi]])

    def facts(tokens: np.ndarray, owner: np.ndarray, classes: np.ndarray, owner_ids: np.ndarray, owner_sizes: np.ndarray) -> Iterator[tuple]:
        """Sets with their sizes and hot shingles, by the set's bucket."""
        at = bucket_of(owner_ids)
        runs = np.bincount(owner, minlength=len(owner_ids))
        starts = np.concatenate([[0], np.cumsum(runs)])
        by = np.argsort(at, kind="stable")
        cuts = _bounds(at[by])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            mine = by[lo:hi]
            spans = [slice(starts[i], starts[i + 1]) for i in mine.tolist()]
            yield _row(int(at[mine[0]]), _FACTS, owner_ids[mine], owner_sizes[mine], runs[mine].astype(np.uint32),
                       np.concatenate([tokens[s] for s in spans]), e=np.concatenate([classes[s] for s in spans]))

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        # What a step needs no more is let go before the next one: two of these tasks share an executor with its heap.
        import xxhash

        lists = batch.column("w")
        offsets = lists.offsets.to_numpy()
        sets = shingle_sets(lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0], width)
        ids = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], dtype=np.uint64)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        yield _row(int(np.bitwise_xor.reduce(ids) % np.uint64(buckets)), _HEADS, ids, sizes, docs=batch.column("key").to_pylist())
        # One copy of each set goes on.
        order = np.argsort(ids, kind="stable")
        chosen = [i for i in order[_first(ids[order])].tolist() if sizes[i]]
        if not chosen:
            return
        tokens = np.concatenate([sets[i] for i in chosen])
        del sets, lists, batch
        owner = np.repeat(np.arange(len(chosen), dtype=np.int32), sizes[chosen])
        owner_ids, owner_sizes = ids[chosen], sizes[chosen]
        by = np.argsort(tokens, kind="stable")
        starts = _bounds(tokens[by])
        runs = np.diff(starts)
        once = tokens[by[starts[:-1]]]
        del starts
        known = _class_of(once, shared.value)
        announced = once[(runs >= HOT) & (known == 0)]
        classes = np.empty(len(tokens), dtype=np.uint8)
        classes[by] = np.repeat(np.where(runs >= HOT, np.maximum(known, HOT), known), runs)
        del by, once, runs, known
        hot = classes > 0
        hot_parts = tokens[hot], owner[hot], classes[hot]
        tokens, owner = tokens[~hot], owner[~hot]
        del hot, classes
        yield from postings(tokens, owner, announced, owner_ids)
        del tokens, owner
        yield from facts(*hot_parts, owner_ids, owner_sizes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in word_slices(whole, SLICE_WORDS):
                held, size = [], 0
                for row in rows_of(part):
                    held.append(row)
                    size += sum(len(x) for x in row[2:7] if x is not None)
                    if size >= SENT_BYTES:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)
                part = held = row = None
                spare_memory()

    return task


def _sparing(work):
    """``work`` on a group of rows; what a large group leaves free goes back to the system, as workers outlive their tasks."""
    def group(table: pa.Table) -> pa.Table:
        out = work(table)
        if table.nbytes > SENT_BYTES:
            spare_memory()
        return out

    return group


def _read(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype=kind) for v in column]


def _count(buckets: int):
    """Stage 2, per bucket of shingles: those found in two sets or more go back to their sets with a frequency class."""
    def group(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        passed = table.filter(pa.array(kinds != _POSTINGS)).select(_PACKED_ARROW.names)
        table = table.filter(pa.array(kinds == _POSTINGS))
        if not table.num_rows:
            return passed.cast(_PACKED_ARROW)
        tokens = np.concatenate(_read(table.column("c"), np.uint64))
        known = np.concatenate(_read(table.column("d"), np.uint64))
        owners = np.repeat(np.concatenate(_read(table.column("a"), np.uint64)), np.concatenate(_read(table.column("b"), np.uint32)))
        del table
        by = np.lexsort((owners, tokens))
        tokens, owners = tokens[by], owners[by]
        del by
        fresh = _first(tokens) | _first(owners)
        tokens, owners = tokens[fresh], owners[fresh]
        del fresh
        starts = _bounds(tokens)
        runs = np.diff(starts)
        rank = np.minimum(runs, HOT).astype(np.uint8)
        rank[np.isin(tokens[starts[:-1]], known)] = HOT
        rank = np.repeat(rank, runs)
        shared = rank > 1
        tokens, owners, rank = tokens[shared], owners[shared], rank[shared]
        at = ((owners >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((owners, at))
        tokens, owners, rank, at = tokens[by], owners[by], rank[by], at[by]
        del by, shared
        rows = []
        cuts = _bounds(at) if len(at) else np.zeros(1, dtype=np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            runs = _bounds(owners[lo:hi])
            rows.append(_row(int(at[lo]), _POSTINGS, owners[lo:hi][runs[:-1]], np.diff(runs).astype(np.uint32), tokens[lo:hi], rank[lo:hi]))
        return pa.concat_tables([passed.cast(_PACKED_ARROW), pa.Table.from_batches([_batch(rows)], _PACKED_ARROW)])

    return group


_CORES = "sid bigint, n bigint, core binary, prefix array<bigint>"
_CORES_ARROW = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("core", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _prefixes(percent: int):
    """Stage 3, per bucket of sets: sets that can have a link, with their shared shingles and their prefix, rare ones first."""
    def group(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        facts, posts = table.filter(pa.array(kinds == _FACTS)), table.filter(pa.array(kinds == _POSTINGS))
        sids = np.concatenate(_read(facts.column("a"), np.uint64))
        sizes = np.concatenate(_read(facts.column("b"), np.int64))
        hot_owner = np.repeat(sids, np.concatenate(_read(facts.column("c"), np.uint32)))
        hot = np.concatenate(_read(facts.column("d"), np.uint64))
        owners, tokens, ranks = [hot_owner], [hot], [np.concatenate(_read(facts.column("e"), np.uint8))]
        if posts.num_rows:
            owners.append(np.repeat(np.concatenate(_read(posts.column("a"), np.uint64)), np.concatenate(_read(posts.column("b"), np.uint32))))
            tokens.append(np.concatenate(_read(posts.column("c"), np.uint64)))
            ranks.append(np.concatenate(_read(posts.column("d"), np.uint8)))
        owner, token, rank = np.concatenate(owners), np.concatenate(tokens), np.concatenate(ranks)
        by = np.argsort(sids, kind="stable")
        once = _first(sids[by])
        sids, sizes = sids[by][once], sizes[by][once]
        by = np.lexsort((rank, token, owner))
        owner, token, rank = owner[by], token[by], rank[by]
        # The same shingle can come from a batch's list and from its bucket: the highest class counts.
        last = np.ones(len(owner), dtype=bool)
        last[:-1] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
        owner, token, rank = owner[last], token[last], rank[last]
        lo, hi = np.searchsorted(owner, sids, "left"), np.searchsorted(owner, sids, "right")
        out = []
        for i in np.flatnonzero(hi - lo >= -(-percent * sizes // 100)).tolist():
            n, core, classes = int(sizes[i]), token[lo[i]:hi[i]], rank[lo[i]:hi[i]]
            take = n - required(n, percent) + 1 - (n - len(core))
            first = core[np.lexsort((core, classes))[:take]]
            out.append((sids[i].view(np.int64), n, core.tobytes(), first.view(np.int64)))
        return pa.Table.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(_CORES_ARROW)], schema=_CORES_ARROW)

    return group


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1 if len(b) else 0
    return int((b[at] == a).sum()) if len(b) else 0


def join_region(sets: list[np.ndarray], sizes: np.ndarray, percent: int, classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of one region, enough to connect what is connected: pivot after pivot, each with window and recursion.

    All pairs at or above the threshold end in the same component; pairs known to be connected (equal ``classes``, or linked
    on the way) are not measured. The smallest class gives the next pivot, and a region ends when only one class is left.
    """
    limit = 1 - percent / 100 + 1e-9
    if classes is None:
        classes = np.arange(len(sets))
    _, first, place = np.unique(classes, return_index=True, return_inverse=True)
    root = first[place].tolist()

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    links, group = [], np.arange(len(sets))
    while len(group) > 1:
        # The smallest class goes first: once it is settled or joined, often only one class is left.
        tops = np.array([top(i) for i in group.tolist()])
        held = np.bincount(tops, minlength=len(sets))[tops]
        if held[0] == len(group):
            break
        group = group[np.argsort(held, kind="stable")]
        pivot, rest = int(group[0]), group[1:]
        common = np.zeros(len(sets), dtype=np.int64)
        for lo in range(0, len(tokens), PART):
            part = tokens[lo:lo + PART]
            at = np.searchsorted(sets[pivot], part)
            at[at == len(sets[pivot])] = 0
            common += np.bincount(owner[lo:lo + PART][sets[pivot][at] == part], minlength=len(sets))
        common = common[rest]
        union = sizes[rest] + sizes[pivot] - common
        near = 100 * common >= percent * union
        for other in rest[near].tolist():
            if top(other) != top(pivot):
                root[top(other)] = top(pivot)
                links.append((pivot, other))
        if near.all():
            break
        distance = 1 - common / union
        # Beyond the ball, and those in it that a document beyond it may reach.
        goes_on = ~near | (distance >= distance[~near].min() - limit)
        group = rest[goes_on]
    return links


def _finish(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def group(table: pa.Table) -> pa.Table:
        sids = table.column("sid").to_numpy()
        links = join_region(_read(table.column("core"), np.uint64), table.column("n").to_numpy(), percent, table.column("class").to_numpy())
        return pa.table({"a": pa.array([sids[i] for i, _ in links], pa.int64()), "b": pa.array([sids[j] for _, j in links], pa.int64())}, schema=schema)

    return group


def _measure(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, pivots = _read(batch.column("core"), np.uint64), _read(batch.column("pivot_core"), np.uint64)
            common = np.array([overlap(a, b) for a, b in zip(mine, pivots, strict=True)], dtype=np.int64)
            near = 100 * common >= percent * (batch.column("n").to_numpy() + batch.column("pivot_n").to_numpy() - common)
            linked = batch.filter(pa.array(near))
            yield pa.RecordBatch.from_arrays([linked.column("pivot"), linked.column("sid")], names=["a", "b"])

    return task


def linked_sets(cores: DataFrame, percent: int, region_rows: int = REGION_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b) links that connect every two sets whose similarity reaches ``percent``; ``cores`` has sid, n, core, prefix.

    Regions of at most ``region_rows`` sets and ``block_bytes`` bytes are joined in one task each. In larger ones every member
    is measured against the pivot; what that and the small regions leave unconnected to the pivot's component (usually little)
    is cut into blocks, and each block meets the region block by block, so no task holds more than two blocks.
    """
    sets = cores.select("sid", "n", "core")
    placed = cores.select("sid", F.explode("prefix").alias("token"))
    pivots = placed.groupBy("token").agg(F.min("sid").alias("region"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    members = cut_lineage(placed.join(pivots, "token").select("region", "sid").distinct())
    totals = members.join(cores.select("sid", "n"), "sid").groupBy("region").agg(F.count("*").alias("_c"), (F.sum("n") * 8).alias("_b"))
    sized = members.join(totals, "region")
    fits = (F.col("_c") <= region_rows) & (F.col("_b") <= block_bytes)
    small = sized.where(fits & (F.col("_c") > 1)).select("region", "sid", F.col("sid").alias("class")).join(sets, "sid")
    links = cut_lineage(small.groupBy("region").applyInArrow(_sparing(_finish(percent)), "a bigint, b bigint"))
    large = cut_lineage(sized.where(~fits).select("region", "sid"))
    if not large.limit(1).collect():
        return links
    heads = large.select(F.col("region").alias("pivot")).distinct().join(
        sets.select(F.col("sid").alias("pivot"), F.col("n").alias("pivot_n"), F.col("core").alias("pivot_core")), "pivot")
    pairs = large.where("sid <> region").withColumnRenamed("region", "pivot").join(sets, "sid").join(heads, "pivot")
    star = pairs.select("pivot", "sid", "n", "pivot_n", "core", "pivot_core").mapInArrow(sparing(_measure(percent)), "a bigint, b bigint")
    links = cut_lineage(links.unionByName(star))

    roots = connected_components(links).select(F.col("node").alias("sid"), F.col("root").alias("class"))
    classed = large.join(roots, "sid", "left").join(sets.select("sid", "n"), "sid").select(
        "region", "sid", "n", F.coalesce("class", "sid").alias("class"))
    mains = classed.where("sid = region").select("region", F.col("class").alias("main"))
    marked = cut_lineage(classed.join(mains, "region").withColumn("outside", F.col("class") != F.col("main")))
    blocks = marked.groupBy("region").agg(F.sum(F.when(F.col("outside"), F.col("n"))).alias("out_n"), F.sum("n").alias("all_n")).where("out_n > 0")
    blocks = blocks.select("region", *[F.ceil(F.col(c) * 8 / block_bytes).cast("int").alias(k) for c, k in (("out_n", "outs"), ("all_n", "alls"))])
    spread = marked.join(blocks, "region")

    def block(count: str) -> F.Column:
        return F.pmod(F.xxhash64("sid", F.lit(count)), F.col(count)).cast("int")

    def every(count: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    outside = spread.where("outside").select("region", "sid", "class", block("outs").alias("o"), every("alls").alias("b"))
    whole = spread.select("region", "sid", "class", every("outs").alias("o"), block("alls").alias("b"))
    met = outside.unionByName(whole).distinct().join(sets, "sid")
    rest = met.groupBy("region", "o", "b").applyInArrow(_sparing(_finish(percent)), "a bigint, b bigint")
    return cut_lineage(links.unionByName(rest))


def join_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
                   region_rows: int = REGION_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_shingles, component_id): size of each document's set and the smallest key reachable by links.

    Texts are lower-cased (A-Z) and cut into words; a set holds the distinct ``width``-word shingles, or the whole sequence
    of a shorter text; two documents link when 100 * intersection >= ``percent`` * union. Null and empty texts have no
    shingles, link with nothing and are their own component; so is a row whose key is null unless it has links. Repeated
    rows stay separate rows of one component; an empty table gives no rows. Keys are integers. Shingles and sets are
    compared by 64-bit hashes. Only ``key`` and ``text`` are read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    buckets = max(1, -(-docs.count() // DOCS_PER_BUCKET))
    hashed = docs.select(F.col(key).cast("bigint").alias("key"), F.transform(words(ascii_lower(F.col(text))), lambda w: F.xxhash64(w)).alias("w"))
    shared = spark.sparkContext.broadcast(hot_classes(frequency_sketch(hashed, width)))
    packed = hashed.mapInArrow(sparing(_send(width, buckets, shared)), _PACKED).groupBy("bucket").applyInArrow(_sparing(_count(buckets)), _PACKED)
    packed = cut_lineage(packed)
    heads = packed.where(F.col("kind") == _HEADS).mapInArrow(sparing(_unpack_heads), "key bigint, sid bigint, n_shingles bigint")
    cores = cut_lineage(packed.where(F.col("kind") != _HEADS).groupBy("bucket").applyInArrow(_sparing(_prefixes(percent)), _CORES))
    roots = connected_components(linked_sets(cores, percent, region_rows, block_bytes))
    first = heads.where("n_shingles > 0").groupBy("sid").agg(F.min("key").alias("first"), F.count("*").alias("_n"))
    named = cut_lineage(first.join(roots.withColumnRenamed("node", "sid"), "sid", "left"))
    lowest = named.where("root is not null").groupBy("root").agg(F.min("first").alias("lowest"))
    classes = named.join(lowest, "root", "left").select("sid", F.coalesce("lowest", "first").alias("component"), "_n")
    # A set with a large share of all documents would be one task of the join; of those there are at most HOT_SHARE.
    total = F.lit(named.agg(F.sum("_n")).first()[0] or 0)
    hot = F.broadcast(classes.where(F.col("_n") * HOT_SHARE >= total).drop("_n"))
    rest = classes.where(F.col("_n") * HOT_SHARE < total).drop("_n")
    out = heads.join(hot, "sid").unionByName(heads.join(hot.select("sid"), "sid", "left_anti").join(rest, "sid", "left"))
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"))


def _unpack_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            sids = np.frombuffer(batch.column("a")[i].as_buffer(), dtype=np.int64)
            sizes = np.frombuffer(batch.column("b")[i].as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("docs")[i].values, pa.array(sids), pa.array(sizes)], names=["key", "sid", "n_shingles"])
