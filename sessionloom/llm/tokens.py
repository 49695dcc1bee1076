"""Token files: documents as token ids in key order, compressed by Re-Pair grammars, decodable at any place.

A task encodes a range of keys and cuts it into shards of about ``SHARD_IDS`` ids, the only state it holds. A shard is one
row of a Parquet dataset, so writing, committing and reading back work in any store that Spark knows.

Shard layout (little endian). ``head``: document keys as int64 with a validity byte each, then ids per document as uint32.
``rules``: left and right symbol of every nonterminal as uint16 pairs; nonterminal k is symbol ``vocabulary`` + k and refers
to smaller symbols only. ``lengths``: ids each nonterminal expands to, uint32. ``body``: symbols, uint16. ``marks``: ids
before every ``MARK``-th symbol, uint64, so that any range is found by one search and decoded alone.
"""

from __future__ import annotations

import codecs
import json
import re
import string
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship_package
from .text import sparing

END_ID = 0
SHARD_IDS = 1 << 20
MARK = 1024
#: The first rounds share the room for rules evenly; later ones take what is left.
ROUNDS = 5
#: A pair must occur this often to pay for its rule.
LEAST_COUNT = 12
CACHED_PIECES = 1_000_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 23

_SHARD = "part int, shard int, docs bigint, ids bigint, vocabulary int, head binary, rules binary, lengths binary, body binary, marks binary"
#: Two blanks or line ends and blanks side by side or at an end, "<|", white space other than these, separators that Python alone
#: calls white space.
_UNCUT = ("  | \n|\n |\\A[ \n]|[ \n]\\z|<\\||"
          "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of letters of scripts to which Unicode adds nothing any more, so that every version knows the same ones.
_WORD = re.compile("\n?[^\\W\\d_\xb2\xb3\xb9\xbc-\xbe\u0530-\U0010ffff]+")
#: A line end that is a pre-token alone wherever it stands.
_LINE_END = re.compile("(?<!\n)\n(?!\n)")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = sorted({*range(256)} - {*_SHOWN})
#: Characters by which byte-level tokenizers write the bytes: shown ones stay, the others follow from 256 on.
_BYTE_LEVEL = "".join(chr(b if b in _SHOWN else 256 + _HIDDEN.index(b)) for b in range(256))


class Grammar(NamedTuple):
    """Re-Pair grammar of one shard: ``body`` over ids and nonterminals from ``vocabulary`` on."""

    vocabulary: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    body: np.ndarray

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size): all ids, then the expansions of the nonterminals, and where each symbol's stand in that."""
        ends = np.cumsum(self.lengths, dtype=np.int64)
        begin = np.concatenate([np.arange(self.vocabulary, dtype=np.int64), self.vocabulary + ends - self.lengths])
        size = np.concatenate([np.ones(self.vocabulary, dtype=np.int64), self.lengths.astype(np.int64)])
        ids = np.concatenate([np.arange(self.vocabulary, dtype=np.uint32), np.empty(ends[-1] if len(ends) else 0, dtype=np.uint32)])
        # Nonterminals by depth: those of one depth only copy what shallower ones hold.
        depth = [0] * self.vocabulary
        for a, b in zip(self.left.tolist(), self.right.tolist(), strict=True):
            depth.append(1 + max(depth[a], depth[b]))
        levels = np.array(depth[self.vocabulary:], dtype=np.int64)
        for level in range(1, max(depth) + 1):
            rows = np.flatnonzero(levels == level)
            halves = np.stack([self.left[rows], self.right[rows]], axis=1).astype(np.int64).ravel()
            into = np.stack([begin[self.vocabulary + rows], begin[self.vocabulary + rows] + size[self.left[rows]]], axis=1).ravel()
            ids[_spread(into, size[halves])] = ids[_spread(begin[halves], size[halves])]
        return ids, begin, size

    def decode(self, lo: int = 0, hi: int | None = None, marks: np.ndarray | None = None) -> np.ndarray:
        """Ids ``lo`` to ``hi`` as uint32; with ``marks`` only the symbols around the range are read, and only rules below them."""
        if marks is not None and len(marks) and hi is not None:
            from_mark = int(np.searchsorted(marks, lo, "right")) - 1
            to_mark = int(np.searchsorted(marks, hi, "left"))
            first = int(marks[from_mark])
            return self._within(self.body[from_mark * MARK:to_mark * MARK], lo - first, hi - first)
        ids, begin, size = self.table()
        return ids[_spread(begin[self.body], size[self.body])][lo:hi]

    def _within(self, symbols: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the expansion of ``symbols``: level by level, what lies outside by its length is dropped unread."""
        symbols = symbols.astype(np.int64)
        while True:
            deep = symbols >= self.vocabulary
            size = np.ones(len(symbols), dtype=np.int64)
            size[deep] = self.lengths[symbols[deep] - self.vocabulary]
            ends = np.cumsum(size)
            keep = (ends > lo) & (ends - size < hi)
            if not keep.any():
                return np.zeros(0, dtype=np.uint32)
            skipped = int((ends - size)[keep][0])
            symbols, deep, lo, hi = symbols[keep], deep[keep], lo - skipped, hi - skipped
            if not deep.any():
                return symbols[lo:hi].astype(np.uint32)
            at = np.cumsum(1 + deep) - 1 - deep
            rules = symbols[deep] - self.vocabulary
            symbols = np.repeat(symbols, 1 + deep)
            symbols[at[deep]], symbols[at[deep] + 1] = self.left[rules], self.right[rules]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, then the same for the next, back to back."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def compress(ids: np.ndarray, last: np.ndarray, vocabulary: int, rounds: int = ROUNDS, least: int = LEAST_COUNT) -> Grammar:
    """Re-Pair in rounds: count all adjacent pairs, make nonterminals of the commonest, replace them, and again, until no pair
    occurs ``least`` times or no symbol is left.

    Where two chosen pairs overlap the commoner one is replaced; of a run of one symbol every second pair is. ``last`` marks the final id of each document; no pair
    crosses it. Symbols stay below 65,536, which bounds the rules. A pair of older symbols never gets commoner, so later rounds count
    only places whose pair was common before (by hash) or has a new symbol.
    """
    body, last = ids.astype(np.uint16), last.copy()
    left, right = [], []
    room = 65_535 - vocabulary
    bits = 18
    turn = 0
    live = ~last
    live[-1:] = False
    while room and len(body) > 1:
        inside = np.flatnonzero(live)
        keys = ((body[:-1].astype(np.uint32) << np.uint32(16)) | body[1:])[live[:-1]]
        ordered = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(starts, len(ordered)))
        often = counts >= least
        pairs, counts = ordered[starts[often]], counts[often]
        at = (keys * np.uint32(2654435761)) >> np.uint32(32 - bits)
        common = np.zeros(1 << bits, dtype=bool)
        common[(pairs * np.uint32(2654435761)) >> np.uint32(32 - bits)] = True
        live[inside] = common[at]
        # Equal counts in mixed order: in ascending order a text of ascending ids would lose one pair a round.
        by = np.lexsort((pairs * np.uint32(2246822519), -counts))[:max(1, room // max(1, rounds - turn))]
        pairs = pairs[by]
        turn += 1
        if not len(pairs):
            break
        # Hash table from pair to rank (1 is the commonest); of colliding pairs the commoner keeps its place.
        slot = (pairs * np.uint32(2654435761)) >> np.uint32(32 - bits)
        _, keep = _first_of(slot)
        pairs, slot = pairs[keep], slot[keep]
        ranks, holder = np.zeros(1 << bits, dtype=np.int32), np.zeros(1 << bits, dtype=np.uint32)
        ranks[slot], holder[slot] = np.arange(1, len(pairs) + 1), pairs
        found = np.flatnonzero(holder[at] == keys)
        rank = ranks[at[found]]
        found, rank = inside[found[rank > 0]], rank[rank > 0]
        beside = found[1:] == found[:-1] + 1
        # Neighbours of one rank are one symbol repeated.
        again = np.concatenate([[False], beside & (rank[1:] == rank[:-1])]) if len(found) else beside
        run = np.arange(len(found)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(found))))
        found, rank = found[run % 2 == 0], rank[run % 2 == 0]
        beside = found[1:] == found[:-1] + 1
        wins = np.ones(len(found), dtype=bool)
        wins[1:] &= ~beside | (rank[1:] < rank[:-1])
        wins[:-1] &= ~beside | (rank[:-1] <= rank[1:])
        place, chosen = found[wins], rank[wins] - 1
        # Not every chosen pair wins so often that it pays; only those that do become rules, or all if none does.
        won = np.bincount(chosen, minlength=len(pairs))
        used = np.flatnonzero(won >= (least if won.max() >= least else 1))
        place, chosen = place[won[chosen] >= won[used].min()], chosen[won[chosen] >= won[used].min()]
        number = np.zeros(len(pairs), dtype=np.int64)
        number[used] = vocabulary + len(left) + np.arange(len(used))
        left.extend((pairs[used] >> np.uint32(16)).tolist())
        right.extend((pairs[used] & np.uint32(65_535)).tolist())
        room -= len(used)
        body[place] = number[chosen]
        last[place] = last[place + 1]
        for new in (place, np.maximum(place - 1, 0)):
            live[new] = ~last[new]
        stay = np.ones(len(body), dtype=bool)
        stay[place + 1] = False
        body, last, live = body[stay], last[stay], live[stay]
        live[-1] = False
    lengths: list[int] = []
    for a, b in zip(left, right, strict=True):
        lengths.append(sum(1 if s < vocabulary else lengths[s - vocabulary] for s in (a, b)))
    return Grammar(vocabulary, np.array(left, dtype=np.uint16), np.array(right, dtype=np.uint16), np.array(lengths, dtype=np.uint32), body)


def _first_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and, in input order, the positions where each occurs first."""
    by = np.argsort(values, kind="stable")
    first = np.concatenate([[True], values[by][1:] != values[by][:-1]])
    return values[by][first], np.sort(by[first])


class _Words:
    """Ids of words of letters, by the library's BPE model: as behind a blank, or behind a line end where one stands before
    the word (then with its id). Other strings have none and size -1. Words lie in one Arrow array and their ids in one NumPy
    array, a tenth of what as many Python objects take: the worker keeps them as long as it lives."""

    def __init__(self, model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.held = pa.array([], pa.large_string())
        self.ids, self.begin, self.size = np.zeros(0, dtype="<u2"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def __len__(self) -> int:
        return len(self.held)

    def items(self) -> Iterator[tuple[str, bytes | None]]:
        for word, begin, size in zip(self.held.to_pylist(), self.begin.tolist(), self.size.tolist(), strict=True):
            yield word, None if size < 0 else self.ids[begin:begin + size].tobytes()

    def pretoken(self, text: str) -> array:
        """Ids of a string that the pre-tokenizer leaves whole."""
        symbols = codecs.charmap_decode(text.encode(), "strict", _BYTE_LEVEL)[0]
        return array("H", [t.id for t in self.model.tokenize(symbols)])

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, after adding those that were not held."""
        at = pc.index_in(words, value_set=self.held)
        new = pc.is_null(at)
        if not pc.any(new).as_py():
            return at.to_numpy()
        at = pc.fill_null(at, 0).to_numpy().copy()
        coded = words.filter(new).dictionary_encode()
        at[new.to_numpy(zero_copy_only=False)] = coded.indices.to_numpy() + len(self.held)
        flat, sizes, line_end = array("H"), array("i"), self.pretoken("\n")
        for word in _strings(coded.dictionary):
            before = len(flat)
            if not _WORD.fullmatch(word):
                sizes.append(-1)
                continue
            if word[0] == "\n":
                flat.extend(line_end)
                flat.extend(self.pretoken(word[1:]))
            else:
                flat.extend(self.pretoken(" " + word))
            sizes.append(len(flat) - before)
        size = np.frombuffer(sizes, dtype=np.int32)
        ends = len(self.ids) + np.cumsum(np.maximum(size, 0), dtype=np.int64)
        self.begin, self.size = np.concatenate([self.begin, ends - np.maximum(size, 0)]), np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, np.frombuffer(flat, dtype="<u2")]) if len(flat) else self.ids
        self.held = pa.concat_arrays([self.held, coded.dictionary])
        return at


class Encoder:
    """Encodes texts with a byte-level BPE tokenizer, each distinct word once while it is cached.

    Texts are cut at single blanks and line ends between words; byte-level pre-tokens never reach from a word into the blank
    behind it, so the ids are those of the whole text. Arrow finds the distinct pieces of a slice of texts, NumPy lays out
    their ids for all pieces. A piece of letters and the marks behind them is two pre-tokens, which go to the BPE model;
    other new pieces are encoded many at a time between separator tokens. The caches are emptied when they are full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.separator = self.vocabulary - 1
        self.between = self.tokenizer.id_to_token(self.separator)
        if self.tokenizer.encode(self.between, add_special_tokens=False).ids != [self.separator]:
            raise ValueError("the last id of the tokenizer must be a special token")
        first = self.tokenizer.pre_tokenizer
        kind = json.loads(first.__getstate__()) if first is not None else {}
        #: Texts are cut for this pre-tokenizer only.
        self.byte_level = (kind.get("type"), kind.get("use_regex"), kind.get("add_prefix_space"), self.tokenizer.normalizer) == ("ByteLevel", True, False, None)
        self.words = _Words(self.tokenizer.model)
        self.marks: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def cuttable(self, texts: pa.Array) -> list[bool | None]:
        """Whether every blank stands between two words, and no string of a special token can occur."""
        return pc.and_(pc.invert(pc.match_substring_regex(texts, _UNCUT)), self.byte_level).to_pylist()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def between_separators(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; many pieces go through the tokenizer at once, between separators."""
        blocks = [pieces[i:i + 500] for i in range(0, len(pieces), 500)]
        out = []
        for found in self.tokenizer.encode_batch_fast([self.between.join(b) for b in blocks], add_special_tokens=False):
            ids = np.array([*found.ids, self.separator], dtype="<u2")
            data, at = ids.tobytes(), 0
            for end in np.flatnonzero(ids == self.separator).tolist():
                out.append(data[2 * at:2 * end])
                at = end + 1
        return out

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size) of distinct pieces of texts, each with the blank or line end before it (the line end is written, the blank is not)."""
        words, marks, odd = self.words, self.marks, self.odd
        for cache in (words, marks, odd):
            if len(cache) > CACHED_PIECES:
                cache.clear()
        cores = pc.utf8_rtrim(pieces, characters=string.punctuation)
        at = words.find(cores)
        # Two runs of ids for each piece: the word's, or an odd piece's, and those of the marks behind a word.
        begin, size = np.zeros((len(pieces), 2), dtype=np.int64), np.zeros((len(pieces), 2), dtype=np.int64)
        begin[:, 0], size[:, 0] = words.begin[at], words.size[at]
        others = size[:, 0] < 0
        sources, held = [words.ids], len(words.ids)

        def add(rows: np.ndarray, run: int, found: list[bytes], number: np.ndarray) -> None:
            nonlocal held
            sizes = np.array([len(ids) // 2 for ids in found], dtype=np.int64)
            begin[rows, run], size[rows, run] = (held + np.cumsum(sizes) - sizes)[number], sizes[number]
            sources.append(np.frombuffer(b"".join(found), dtype="<u2"))
            held += len(sources[-1])

        longer = pc.not_equal(pc.binary_length(pieces), pc.binary_length(cores)).to_numpy(zero_copy_only=False) & ~others
        if longer.any():
            chosen = pa.array(longer)
            behind = pa.array([p[len(c):] for p, c in zip(_strings(pieces.filter(chosen)), _strings(cores.filter(chosen)), strict=True)]).dictionary_encode()
            for mark in behind.dictionary.to_pylist():
                if mark not in marks:
                    marks[mark] = words.pretoken(mark).tobytes()
            add(np.flatnonzero(longer), 1, [marks[m] for m in behind.dictionary.to_pylist()], behind.indices.to_numpy())
        if others.any():
            texts = pieces.filter(pa.array(others)).to_pylist()
            missing = [p for p in texts if p not in odd]
            odd.update(zip(missing, self.between_separators([p if p.startswith("\n") else " " + p for p in missing]), strict=True))
            add(np.flatnonzero(others), 0, [odd[p] for p in texts], np.arange(len(texts)))
        data = np.concatenate(sources)[_spread(begin.ravel(), size.ravel())]
        size = size.sum(axis=1)
        return data, np.cumsum(size) - size, size

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian uint16 ids of each text, without end id; a null text has none."""
        out: list[bytes] = [b""] * len(texts)
        cut: list[int] = []
        lines: list[str] = []
        for i, (text, cuttable) in enumerate(zip(texts.to_pylist(), self.cuttable(texts), strict=True)):
            if not text:
                continue
            if cuttable:
                cut.append(i)
                lines.append("\n" + (_LINE_END.sub(" \n", text) if "\n\n" in text else text.replace("\n", " \n")))
            else:
                out[i] = self.whole(text)
        if not cut:
            return out
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        del lines
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        del split
        data, begin, size = self.pieces(coded.dictionary)
        number = coded.indices.to_numpy()
        size, begin = size[number], begin[number]
        # The line end before a text is none of its own.
        size[first[:-1]] -= 1
        begin[first[:-1]] += 1
        for i, lo, hi in zip(cut, first[:-1].tolist(), first[1:].tolist(), strict=True):
            out[i] = data[_spread(begin[lo:hi], size[lo:hi])].tobytes()
        return out


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``SLICE_BYTES`` bytes of text, of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
        yield column.slice(lo, hi - lo)
        lo = hi


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, kept with its cache from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _shards(tokenizer_path: str, shard_ids: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer_path)
        part, shard = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        texts: list[bytes] = []
        held = 0
        end = np.array([END_ID], dtype="<u2").tobytes()
        for batch in batches:
            names = iter(batch.column("key").to_pylist())
            for column in _slices(batch.column("text")):
                for ids in encode(column):
                    keys.append(next(names))
                    texts.append(ids + end)
                    held += len(ids) // 2 + 1
                    if held >= shard_ids:
                        yield _pack(part, shard, keys, texts, encode.vocabulary)
                        keys, texts, held, shard = [], [], 0, shard + 1
        if keys:
            yield _pack(part, shard, keys, texts, encode.vocabulary)

    return task


def _pack(part: int, shard: int, keys: list, texts: list[bytes], vocabulary: int) -> pa.RecordBatch:
    sizes = np.array([len(t) // 2 for t in texts], dtype=np.uint32)
    ids = np.frombuffer(b"".join(texts), dtype="<u2")
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(sizes) - 1] = True
    grammar = compress(ids, last, vocabulary)
    valid = np.array([k is not None for k in keys], dtype=np.uint8)
    head = np.array([k or 0 for k in keys], dtype="<i8").tobytes() + valid.tobytes() + sizes.astype("<u4").tobytes()
    rules = np.stack([grammar.left, grammar.right], axis=1).astype("<u2").tobytes()
    size = np.concatenate([np.ones(vocabulary, dtype=np.int64), grammar.lengths.astype(np.int64)])[grammar.body]
    marks = (np.cumsum(size) - size)[::MARK].astype("<u8")
    row = [part, shard, len(keys), len(ids), vocabulary, head, rules, grammar.lengths.astype("<u4").tobytes(),
           grammar.body.astype("<u2").tobytes(), marks.tobytes()]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                                      names=["part", "shard", "docs", "ids", "vocabulary", "head", "rules", "lengths", "body", "marks"])


def unpack(row: dict) -> tuple[list[int | None], np.ndarray, Grammar, np.ndarray]:
    """(keys, ids per document, grammar, marks) of a stored shard."""
    n = row["docs"]
    keys, valid = np.frombuffer(row["head"], "<i8", n), np.frombuffer(row["head"], np.uint8, n, 8 * n)
    sizes = np.frombuffer(row["head"], "<u4", n, 9 * n)
    rules = np.frombuffer(row["rules"], "<u2").reshape(-1, 2)
    grammar = Grammar(row["vocabulary"], rules[:, 0], rules[:, 1], np.frombuffer(row["lengths"], "<u4"), np.frombuffer(row["body"], "<u2"))
    return [k if v else None for k, v in zip(keys.tolist(), valid.tolist(), strict=True)], sizes, grammar, np.frombuffer(row["marks"], "<u8")


def write(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Writes the token file of ``docs`` below ``path``, in ascending order of the integer ``key`` (null first).

    Every text is encoded whole, special tokens are not added, and the end id 0 follows each document. Null and empty texts
    are an end id alone. Rows with equal keys follow each other in any order; an empty table writes an empty dataset. Texts
    are shuffled once, by key range; other columns are not read.
    """
    ship_package(docs.sparkSession)
    placed = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
    placed.mapInArrow(sparing(_shards(tokenizer_path, shard_ids)), _SHARD).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the file: ids of all documents before it, its own
    ids with the end id, and the unsigned CRC-32 of those as little-endian 32-bit integers."""
    ship_package(spark)
    stored = spark.read.schema(_SHARD).parquet(path)
    # Totals per part come first (as many rows as writing tasks), then places inside a part.
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("ids").alias("_ids")).select("part", F.coalesce(F.sum("_ids").over(by_part), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.select("part", "shard", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("_inside")).join(parts, "part")
    offsets = offsets.select("part", "shard", (F.col("_before") + F.col("_inside")).alias("_offset"))
    decoded = stored.mapInArrow(sparing(_digests), "part int, shard int, key bigint, place bigint, n_tokens bigint, ids_crc32 bigint")
    return decoded.join(offsets, ["part", "shard"]).select("key", (F.col("_offset") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            keys, sizes, grammar, _ = unpack(row)
            ids = grammar.decode().astype("<u4", copy=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            starts = ends - sizes
            view = memoryview(ids).cast("B")
            sums = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(keys, pa.int64()),
                 pa.array(starts, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(sums, pa.int64())],
                names=["part", "shard", "key", "place", "n_tokens", "ids_crc32"])


def decode_document(row: dict, index: int) -> np.ndarray:
    """Ids of one document of a stored shard, expanding only the symbols around it and the rules below them."""
    _, sizes, grammar, marks = unpack(row)
    ends = np.cumsum(sizes, dtype=np.int64)
    return grammar.decode(int(ends[index] - sizes[index]), int(ends[index]), marks)
