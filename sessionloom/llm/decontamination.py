"""Benchmark decontamination: CGK embedding of item-sized word windows, bit-sampling LSH, exact edit verification.

The CGK random walk copies a sequence to three times its length and repeats symbols at random, so that an edit shifts both
walks back into step: few edits leave few differing positions. Windows and items that agree on sampled positions of some
repetition are candidates, and a candidate counts when some stretch of the text is within the edit bound of the item.

Documents never move: every task scans its own texts against the items, which come in blocks of bounded size. Only windows
holding enough pairs of neighbouring benchmark words to be within the bound at all are embedded; that test loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship_package
from .text import sparing, word_slices

#: Word edits allowed per item word.
EDIT_RATE = 0.2
RECALL = 0.99
#: Sampled positions per key, and keys drawn from one random walk.
POSITIONS, KEYS_PER_WALK = 3, 8
#: Items compared in one pass over the documents.
ITEM_BLOCK = 20_000
#: Embedded symbols held at once.
CELLS = 2_000_000
#: Words of documents that meet an index at once; bounds the memory of a task.
SLICE_WORDS = 250_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text) -> F.Column:
    """Hashes of the lower-cased runs of letters and digits of a text; a null text has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def allowed(length: np.ndarray | int, rate: float = EDIT_RATE):
    """Edits within which a stretch still counts as an item of ``length`` words."""
    return np.floor(np.asarray(length) * rate + 1e-9).astype(np.int64)


def walks(symbols: np.ndarray, lengths: np.ndarray, salt: int) -> np.ndarray:
    """CGK embeddings (rows) of padded sequences; symbol 0 pads. The random bits come from hashing step, symbol and salt."""
    rows, width = symbols.shape
    out = np.zeros((rows, 3 * width), dtype=np.int32)
    at = np.zeros(rows, dtype=np.int64)
    padded = np.concatenate([symbols, np.zeros((rows, 1), dtype=symbols.dtype)], axis=1)
    steps = 3 * lengths
    index = np.arange(rows)
    for j in range(3 * width):
        inside = (at < lengths) & (j < steps)
        here = np.where(inside, padded[index, np.minimum(at, width)], 0)
        out[:, j] = here
        bit = ((here.astype(np.uint64) + np.uint64(1)) * _PRIME + np.uint64((j * 0x2545F4914F6CDD1D + salt * 0xD6E8FEB86659FD93) % (1 << 64)))
        bit = (bit ^ (bit >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at += ((bit >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    return out


def keys_of(embedded: np.ndarray, lengths: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Bit-sampling keys: for each row of ``shares`` (places as parts of the embedded length) the symbols there and the length."""
    out = np.empty((len(embedded), len(shares)), dtype=np.uint64)
    index = np.arange(len(embedded))
    for t, places in enumerate(shares):
        key = lengths.astype(np.uint64)
        for share in places:
            key = (key ^ embedded[index, (share * 3 * lengths).astype(np.int64)].astype(np.uint64)) * _PRIME
            key ^= key >> np.uint64(32)
        out[:, t] = key
    return out


class Index(NamedTuple):
    """Items of one block: vocabulary of word hashes (symbol = place + 1), pairs of neighbours, the items of
    each (back to back, and starts), padded symbols, lengths,    different pairs per item, and the keys per walk."""

    items: np.ndarray
    vocabulary: np.ndarray
    pairs: np.ndarray
    pair_items: tuple[np.ndarray, np.ndarray]
    symbols: np.ndarray
    lengths: np.ndarray
    distinct: np.ndarray
    rate: float
    shares: np.ndarray
    keys: list[list[tuple[np.ndarray, np.ndarray]]]


def build_index(items: list[tuple[int, np.ndarray]], rate: float = EDIT_RATE, recall: float = RECALL, seed: int = 7) -> Index | None:
    """Index of (item id, word hashes); as many keys as a leak at the edit bound needs to be found with ``recall``.

    The chance that a sampled place agrees is measured by editing each item at the bound and embedding both.
    """
    items = [(i, w) for i, w in items if len(w)]
    if not items:
        return None
    ids = np.array([i for i, _ in items], dtype=np.int64)
    lengths = np.array([len(w) for _, w in items], dtype=np.int64)
    vocabulary = np.sort(np.concatenate([w for _, w in items]))
    vocabulary = vocabulary[np.concatenate([[True], vocabulary[1:] != vocabulary[:-1]])]
    symbols = np.zeros((len(items), lengths.max()), dtype=np.int32)
    for row, (_, w) in enumerate(items):
        symbols[row, :len(w)] = np.searchsorted(vocabulary, w) + 1
    couples = symbols[:, :-1].astype(np.int64) * (len(vocabulary) + 1) + symbols[:, 1:]
    listed = sorted({(c, r) for r, row in enumerate(couples.tolist()) for c in row[:lengths[r] - 1]})
    holders = np.array([r for _, r in listed], dtype=np.int64)
    couples = np.array([c for c, _ in listed], dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], couples[1:] != couples[:-1]])) if len(couples) else np.zeros(0, dtype=np.int64)
    couples, pair_items = couples[starts], (holders, np.append(starts, len(holders)))
    distinct = np.array([len(set(zip(row[:n], row[1:n], strict=False))) for row, n in zip(symbols.tolist(), lengths.tolist(), strict=True)])
    rng = np.random.default_rng(seed)
    chance = _agreement(symbols, lengths, rate, rng) ** POSITIONS
    count = 1 if chance >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-max(chance, 0.02))))
    turns = -(-count // KEYS_PER_WALK)
    shares = rng.random((turns, KEYS_PER_WALK, POSITIONS))
    keys = []
    for turn in range(turns):
        found = keys_of(walks(symbols, lengths, turn), lengths, shares[turn])
        orders = [np.argsort(found[:, t], kind="stable") for t in range(KEYS_PER_WALK)]
        keys.append([(found[o, t], o) for t, o in enumerate(orders)])
    return Index(ids, vocabulary, couples, pair_items, symbols, lengths, distinct, rate, shares, keys)


def _agreement(symbols: np.ndarray, lengths: np.ndarray, rate: float, rng: np.random.Generator, rows: int = 400) -> float:
    """Lower decile of the share of equal places between items and versions with as many edits as are allowed.

    Items are drawn for this estimate only; all are indexed.
    """
    chosen = rng.integers(0, len(symbols), rows)
    width = symbols.shape[1]
    edited = np.zeros((rows, width), dtype=np.int32)
    for row, i in enumerate(chosen.tolist()):
        w = symbols[i, :lengths[i]].tolist()
        for _ in range(int(allowed(lengths[i], rate))):
            kind, at = int(rng.integers(0, 3)), int(rng.integers(0, max(1, len(w))))
            w[at:at + (kind != 0)] = [] if kind == 1 else [0]
        edited[row, :min(len(w), lengths[i])] = w[:lengths[i]]
    a, b = walks(symbols[chosen], lengths[chosen], 0), walks(edited, lengths[chosen], 0)
    inside = np.arange(3 * width)[None, :] < 3 * lengths[chosen][:, None]
    return float(np.quantile(((a == b) & inside).sum(axis=1) / inside.sum(axis=1), 0.1))


def candidate_windows(index: Index, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths) of the windows of every item length that can be within the bound of some item, and the places of
    every item's pairs (back to back, and where each item's begin).

    An edit spoils at most two pairs of neighbouring words, so a window within e edits of an item with p different pairs keeps
    p - 2e of them; items with too few for that are looked up by their words.
    """
    known = text > 0
    both = np.flatnonzero(known[:-1] & known[1:])
    pairs = text[both].astype(np.int64) * (len(index.vocabulary) + 1) + text[both + 1]
    at = np.searchsorted(index.pairs, pairs)
    at[at == len(index.pairs)] = 0
    code = np.full(len(text) + 2, -1, dtype=np.int64)
    if len(index.pairs):
        found = index.pairs[at] == pairs
        code[both[found] + 2] = pairs[found]
    # Only different pairs count: one seen one or two places earlier adds nothing unless that place lies before the window.
    paired = (code[2:] >= 0) & (code[2:] != code[1:-1]) & (code[2:] != code[:-2])
    # Places of every item's pairs, item by item.
    which = np.searchsorted(index.pairs, code[2:][paired])
    lists = index.pair_items
    count = lists[1][which + 1] - lists[1][which] if len(which) else np.zeros(0, dtype=np.int64)
    begin = np.repeat(lists[1][which] - np.cumsum(count) + count, count) if len(which) else count
    items = lists[0][begin + np.arange(count.sum())]
    place = np.repeat(np.flatnonzero(paired), count)
    by = np.argsort(items, kind="stable")
    place, cuts = place[by], np.searchsorted(items[by], np.arange(len(index.items) + 1))
    words, couples = (np.concatenate([[0], np.cumsum(x, dtype=np.int32)]) for x in (known, paired))
    starts, sizes = [], []
    for length in sorted(set(index.lengths.tolist())):
        if length > len(text):
            break
        edits = int(allowed(length, index.rate))
        rows = np.flatnonzero(index.lengths == length)
        needs = index.distinct[rows] - 2 * edits - 2
        if needs.min() >= 1:
            found = np.flatnonzero(couples[length - 1:] - couples[:len(couples) - length + 1] >= needs.min())
            found = found[found <= len(text) - length]
            own = np.zeros(len(found), dtype=bool)
            for row, need in zip(rows.tolist(), needs.tolist(), strict=True):
                mine = place[cuts[row]:cuts[row + 1]]
                own |= np.searchsorted(mine, found + length - 1) - np.searchsorted(mine, found) >= need
            found = found[own]
        else:
            found = np.flatnonzero(words[length:] - words[:-length] >= max(1, length - edits))
        starts.append(found)
        sizes.append(np.full(len(found), length, dtype=np.int64))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(starts), np.concatenate(sizes), place, cuts) if starts else (none, none, place, cuts)


def candidates(index: Index, text: np.ndarray) -> np.ndarray:
    """Distinct (start, item row) pairs whose window and item share a key; ``text`` holds symbols, 0 for other words."""
    starts, sizes, place, cuts = candidate_windows(index, text)
    width = index.symbols.shape[1]
    padded = np.concatenate([text, np.zeros(width, dtype=text.dtype)])
    step = max(1, CELLS // (3 * width))
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    for lo in range(0, len(starts), step):
        begin, size = starts[lo:lo + step], sizes[lo:lo + step]
        rows = padded[begin[:, None] + np.arange(width)]
        rows[np.arange(width) >= size[:, None]] = 0
        for turn, tables in enumerate(index.keys):
            mine = keys_of(walks(rows, size, turn), size, index.shares[turn])
            for t, (keys, order) in enumerate(tables):
                first, last = np.searchsorted(keys, mine[:, t], "left"), np.searchsorted(keys, mine[:, t], "right")
                hit = np.flatnonzero(last > first)
                for n in range(int((last - first)[hit].max(initial=0))):
                    more = hit[first[hit] + n < last[hit]]
                    pairs.append(np.stack([begin[more], order[first[more] + n]], axis=1))
    found = np.concatenate(pairs)
    by = np.lexsort((found[:, 0], found[:, 1]))
    found = found[by]
    # The count that let the window through must be this item's own.
    keep = np.ones(len(found), dtype=bool)
    bounds = np.searchsorted(found[:, 1], np.arange(len(index.items) + 1))
    for row in np.flatnonzero(np.diff(bounds)).tolist():
        lo, hi, length = bounds[row], bounds[row + 1], int(index.lengths[row])
        need = int(index.distinct[row]) - 2 * int(allowed(length, index.rate)) - 2
        if need >= 1:
            mine, at = place[cuts[row]:cuts[row + 1]], found[lo:hi, 0]
            keep[lo:hi] = np.searchsorted(mine, at + length - 1) - np.searchsorted(mine, at) >= need
    found = found[keep]
    return found[np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)])] if len(found) else found


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``text`` nearest to ``item``: fewest edits, then first end, then latest start."""
    n = len(text)
    cost, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, symbol in enumerate(item.tolist(), 1):
        through = np.concatenate([[i], cost[:-1] + (text != symbol)])
        skip = cost + 1
        new_start = np.where(through <= skip, np.concatenate([[0], start[:-1]]), start)
        new = np.minimum(through, skip)
        # Inserting text words: the best earlier column plus the distance to it.
        reach = np.minimum.accumulate(new - steps)
        came = np.maximum.accumulate(np.where(new - steps == reach, steps, 0))
        cost, start = reach + steps, new_start[came]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def _search(blocks: list):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in word_slices(whole, SLICE_WORDS)):
            lists = batch.column("w")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[offsets[0]:offsets[-1]]
            offsets = (offsets - offsets[0]).astype(np.int64)
            keys = batch.column("key")
            for broadcast in blocks:
                rows = leaks(broadcast.value, flat, offsets)
                doc = pa.array([r[0] for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(doc), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 6)]],
                    names=["key", "item_id", "start_word", "end_word", "edits", "item_words"])

    return task


def leaks(index: Index, flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item id, start word, end word, edits, item words) of the best stretch of each leaked item per document."""
    at = np.searchsorted(index.vocabulary, flat)
    at[at == len(index.vocabulary)] = 0
    symbols = np.where(index.vocabulary[at] == flat, at + 1, 0).astype(np.int32)
    gap = index.symbols.shape[1]
    lengths = np.diff(offsets)
    # Documents side by side with a gap of unknown words as wide as the longest item, also in front.
    begins = offsets[:-1] + gap * np.arange(1, len(lengths) + 1)
    text = np.zeros(int(offsets[-1]) + gap * (len(lengths) + 1), dtype=np.int32)
    text[np.repeat(begins - offsets[:-1], lengths) + np.arange(len(flat))] = symbols
    found = candidates(index, text)
    if not len(found):
        return []
    bound = allowed(index.lengths, index.rate)
    spare, size = bound[found[:, 1]], index.lengths[found[:, 1]]
    middle = found[:, 0] + size // 2
    doc = np.clip(np.searchsorted(begins, middle, "right") - 1, 0, len(lengths) - 1)
    # A window that hangs over the end of one document can also reach into the next; the gap keeps them apart.
    lo = np.maximum(found[:, 0] - spare, begins[doc])
    hi = np.minimum(found[:, 0] + size + spare, begins[doc] + lengths[doc])
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    i = 0
    while i < len(found):
        row, d, a, b = int(found[i, 1]), int(doc[i]), int(lo[i]), int(hi[i])
        i += 1
        # Overlapping candidates of one item are one stretch.
        while i < len(found) and found[i, 1] == row and doc[i] == d and lo[i] <= b and b - a < 8 * gap:
            b = max(b, int(hi[i]))
            i += 1
        if b <= a:
            continue
        edits, start, end = best_stretch(index.symbols[row, :index.lengths[row]], text[a:b])
        if edits <= bound[row]:
            place = (edits, a + start - int(begins[d]), a + end - int(begins[d]))
            best[d, row] = min(best.get((d, row), place), place)
    return [(d, int(index.items[row]), start, end, edits, int(index.lengths[row])) for (d, row), (edits, start, end) in sorted(best.items())]


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
               rate: float = EDIT_RATE, recall: float = RECALL, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(key, item_id, start_word, end_word, edits, item_words): the best stretch of every item that occurs in a document.

    Words are lower-cased runs of letters and digits. An item of n words occurs where a stretch of the text is within
    floor(``rate`` * n) inserted, dropped or replaced words of it; shorter items must match exactly. Items and texts without
    words, and null ones, match nothing; an empty table on either side gives no rows. Repeated documents give repeated
    rows. Items with equal texts are all reported. Keys are integers; other columns are not read.

    The benchmark is a stated query set: it is read in blocks of ``item_block`` items ordered by id, each broadcast as one
    index, and the documents meet all blocks in one pass.
    """
    spark = docs.sparkSession
    ship_package(spark)
    narrow = items.select(F.col(item_key).cast("bigint").alias("id"), word_hashes(F.col(item_text)).alias("w")).where("id is not null and size(w) > 0")
    blocks, held = [], []
    for row in narrow.orderBy("id").toLocalIterator():
        held.append((row["id"], np.array(row["w"], dtype=np.int64).view(np.uint64)))
        if len(held) == item_block:
            blocks.append(spark.sparkContext.broadcast(build_index(held, rate, recall)))
            held = []
    if held:
        blocks.append(spark.sparkContext.broadcast(build_index(held, rate, recall)))
    hashed = docs.select(F.col(key).cast("bigint").alias("key"), word_hashes(F.col(text)).alias("w"))
    out = hashed.mapInArrow(sparing(_search(blocks)), "key bigint, item_id bigint, start_word bigint, end_word bigint, edits bigint, item_words bigint")
    return out.withColumnRenamed("key", key)
