"""Repair of conversations: faults of their turns, the cheapest edits that make roles alternate, and the repaired turns.

The roles of a repaired conversation read ``(s?(ua)+)?``: nothing, or user and assistant in turn, with or without a system turn before.
An automaton with four states accepts that: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end. A turn
is one symbol of nine, and what can be done with it (keep, rerole, delete, insert turns before it) is a 4 x 4 matrix of (cost,
audit) over the states, multiplied by min-plus: costs add, audits are strung together, and of two ways the cheaper counts, of equal
ones the one whose audit is ASCII-least.

That is a semiring: stringing together keeps the order of two audits unless one begins with the other, and two audits of the same
turns and equal cost never do, for the longer one would end in insertions that cost more.

Many conversations share stretches of symbols. Re-Pair turns the distinct sequences of a batch into a grammar; each rule gets its
matrix once, from the two it stands for, and every sequence multiplies the few matrices of its body. Audits are ropes: a product
only refers to its two parts, so long ones cost nothing until they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage, ship_package
from .tokens import compress

#: One symbol a turn: initial of the role (o: any other), in capitals if the text is truncated; X must be deleted.
SYMBOLS = "suaoSUAOX"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Characters that do not count as text.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
START, ENDS = 0, (0, 3)
#: States in which a user or an assistant turn may follow, and where it leads.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE_INTO = {2: "user", 3: "assistant"}
#: Symbols of one grammar, and how often a pair must occur to get a rule.
BATCH_SYMBOLS, LEAST_COUNT = 1 << 18, 4
#: Sequences up to this length that stand for at least a thousandth of the conversations are joined by broadcast.
HOT_LENGTH, HOT_SHARE = 4096, 1000


class Rope(NamedTuple):
    """Two audits strung together; each is a string or again a rope."""

    left: str | Rope
    right: str | Rope

    def __str__(self) -> str:
        return "".join(_leaves(self))


Audit = str | Rope
#: matrix[i][j]: cheapest (cost, audit) from state i to state j, None where there is no way.
Matrix = list[list[tuple[int, Audit] | None]]


def _leaves(audit: Audit) -> Iterator[str]:
    stack = [audit]
    while stack:
        part = stack.pop()
        if isinstance(part, Rope):
            stack += (part.right, part.left)
        elif part:
            yield part


def before(a: Audit, b: Audit) -> bool:
    """Whether ``a`` is less than ``b``, from their leaves; a part that both share at the same place is not read."""
    ours, theirs = [a], [b]
    while ours and theirs:
        x, y = ours.pop(), theirs.pop()
        if x is y:
            continue
        if isinstance(x, Rope) or isinstance(y, Rope):
            for part, stack in ((x, ours), (y, theirs)):
                stack += (part.right, part.left) if isinstance(part, Rope) else (part,)
            continue
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x < y
        if x[n:]:
            ours.append(x[n:])
        if y[n:]:
            theirs.append(y[n:])
    return not any(map(len, map(str, ours))) and any(map(len, map(str, theirs)))


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product of two matrices."""
    out: Matrix = []
    for line in a:
        row: list = [None] * 4
        for k, first in enumerate(line):
            if first is None:
                continue
            for j, second in enumerate(b[k]):
                if second is None:
                    continue
                cost, held = first[0] + second[0], row[j]
                if held is None or cost <= held[0]:
                    audit = Rope(first[1], second[1]) if first[1] and second[1] else first[1] or second[1]
                    if held is None or cost < held[0] or before(audit, held[1]):
                        row[j] = (cost, audit)
        out.append(row)
    return out


def insertions() -> Matrix:
    """Turns inserted between two others: none, one or two; more lead nowhere else."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        state = i
        out[i][i] = (0, "")
        for n in (1, 2):
            state = NEXT[state]
            if out[i][state] is None:
                out[i][state] = (n * INSERT, "I" * n)
    return out


def symbol_matrix(symbol: str) -> Matrix:
    """What can be done with one turn, insertions before it included."""
    own: Matrix = [[None] * 4 for _ in range(4)]
    extra = TRUNCATED if symbol in "SUAO" else 0
    for i in range(4):
        own[i][i] = (DELETE, "D")
        if symbol == "X":
            continue
        own[i][NEXT[i]] = (REROLE + extra, "R")
        kept = {"s": 1 if i == 0 else None, "u": 2 if i != 2 else None, "a": 3 if i == 2 else None}.get(symbol.lower())
        if kept is not None:
            own[i][kept] = (KEEP + extra, "K")
    return product(insertions(), own)


def repair_sequences(sequences: list[str]) -> list[tuple[int, str]]:
    """(cost, audit) of the cheapest repair of every sequence of symbols, by one grammar for all of them."""
    sizes = np.array([len(s) for s in sequences], dtype=np.int64)
    ids = np.frombuffer("".join(sequences).encode().translate(bytes.maketrans(SYMBOLS.encode(), bytes(range(len(SYMBOLS))))), dtype=np.uint8)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    grammar = compress(ids, last, len(SYMBOLS), least=LEAST_COUNT)
    matrices = [symbol_matrix(s) for s in SYMBOLS]
    for left, right in zip(grammar.left.tolist(), grammar.right.tolist(), strict=True):
        matrices.append(product(matrices[left], matrices[right]))
    lengths = np.concatenate([np.ones(len(SYMBOLS), dtype=np.int64), grammar.lengths.astype(np.int64)])[grammar.body]
    ends = np.searchsorted(np.cumsum(lengths), np.cumsum(sizes), "right")
    body, at, tail, out = grammar.body.tolist(), 0, insertions(), []
    for end in ends.tolist():
        parts = [matrices[s] for s in body[at:end]] + [tail]
        while len(parts) > 1:  # halves first, so that ropes stay shallow
            parts = [product(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        best = None
        for way in (parts[0][START][j] for j in ENDS):
            if way is not None and (best is None or way[0] < best[0] or way[0] == best[0] and before(way[1], best[1])):
                best = way
        out.append((best[0], str(best[1])))
        at = end
    return out


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(held: list[str]) -> pa.RecordBatch:
        costs, audits = zip(*repair_sequences(held), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(held), pa.array(costs, pa.int64()), pa.array(audits)], names=["sequence", "cost", "audit"])

    held, size = [], 0
    for batch in batches:
        for sequence in batch.column("sequence").to_pylist():
            held.append(sequence)
            size += len(sequence)
            if size >= BATCH_SYMBOLS:
                yield done(held)
                held, size = [], 0
    if held:
        yield done(held)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its turns in order: gaps, counts of faults, and the sequence of symbols."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "sequence"]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
    state: dict | None = None
    rows: list[tuple] = []

    def close(s: dict) -> tuple:
        gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
        return s["conv"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], "".join(s["symbols"])

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for conv, turn, role, blank, cut, first, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "blank", "cut", "first", "n")), strict=True):
            if state is None or state["conv"] != conv:
                if state is not None:
                    rows.append(close(state))
                state = {"conv": conv, "low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "symbols": [], "role": None}
            initial = role[:1]
            if state["role"] is not None:
                state["illegal"] += state["role"] + initial not in ("su", "ua", "au")
            state["illegal"] += n - 1
            state["role"] = initial
            if turn is not None and turn != state["high"]:
                state["low"] = turn if state["low"] is None else state["low"]
                state["high"] = turn
                state["turns"] += 1
            if blank:
                state["blank"] += n
                state["symbols"].append("X" * n)
                continue
            symbol = initial if initial in ("s", "u", "a") else "o"
            state["duplicate"] += n - first
            state["truncated"] += first and cut
            state["symbols"].append((symbol.upper() if cut else symbol) + "X" * (n - 1) if first else "X" * n)
        if rows:
            yield packed()
            rows = []
    if state is not None:
        rows.append(close(state))
        yield packed()


def _walk(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(head, position, edit, role, text) of every repaired turn, from rows (head or None, role, text): each conversation's head, then
    its turns in order. Position -1 without text opens every conversation."""
    head, audit, at, state, place = None, "", 0, START, 0

    def inserted():
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            at, state, place = at + 1, NEXT[state], place + 1
            yield head, place - 1, "I", ROLE_INTO[state], ""

    for new, role, text in rows:
        if new is not None:
            yield from inserted()
            head, audit, at, state, place = new, new["audit"], 0, START, 0
            yield head, -1, None, None, None
            continue
        yield from inserted()
        edit = audit[at]
        at += 1
        if edit == "D":
            continue
        state = 1 if edit == "K" and role[0] == "s" else NEXT[state]
        place += 1
        yield head, place - 1, edit, role if edit == "K" else ROLE_INTO[state], text
    yield from inserted()


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(c) for c in ("head", "role", "text")]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


_HEAD = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_KINDS = [pa.string(), *[pa.int64()] * 6, pa.string()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), [*_KINDS, pa.string()], strict=True)], names=[*_HEAD, "digest"])

    rows, open_head, digest = [], None, sha256()
    for head, place, _, role, text in _walk(_ordered(batches)):
        if place < 0:
            if open_head is not None:
                rows.append((*(open_head[c] for c in _HEAD), digest.hexdigest()))
            open_head, digest = head, sha256()
            if len(rows) >= 1000:
                yield packed(rows)
                rows = []
            continue
        digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
    if open_head is not None:
        rows.append((*(open_head[c] for c in _HEAD), digest.hexdigest()))
        yield packed(rows)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    names, kinds = ["conv", "position", "edit", "role", "text"], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for head, place, edit, role, text in _walk(_ordered(batches)):
        if place >= 0:
            rows.append((head["conv"], place, edit, role, text))
            size += len(text) + 100
        if size > 1 << 23:
            yield packed()
            rows, size = [], 0
    if rows:
        yield packed()


class Repair(NamedTuple):
    """Result of :func:`repair`: stored turns in canonical form and one head row for every conversation."""

    turns: DataFrame
    heads: DataFrame
    conv: str
    kind: str

    def _stream(self) -> DataFrame:
        """Heads and turns of each conversation in one order: a task reads a conversation as a stream and holds its audit only."""
        heads = self.heads.select("conv", F.lit(0).alias("part"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
                                  F.lit(None).cast("binary").alias("digest"), F.struct(*_HEAD).alias("head"))
        turns = self.turns.select("conv", F.lit(1).alias("part"), "turn", "role", "text", "digest", F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
        return heads.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "part", F.asc_nulls_first("turn"), "role", "digest").select("head", "role", "text")

    def _named(self, df: DataFrame) -> DataFrame:
        plain = F.when(F.col("conv") != "", F.expr("substring(conv, 2)").cast(self.kind))
        return df.withColumn("conv", plain).withColumnRenamed("conv", self.conv)

    def summaries(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for every conversation."""
        kinds = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
        return self._named(self._stream().mapInArrow(_digests, kinds))

    def repaired(self) -> DataFrame:
        """(conv, position, edit, role, text): the turns after repair; ``edit`` is K, R or I."""
        return self._named(self._stream().mapInArrow(_turns, "conv string, position bigint, edit string, role string, text string"))


def _named(conv: str) -> Column:
    """Key as text in which null is a value: the empty string; others follow a sign, so that they never meet it."""
    return F.when(F.col(conv).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(conv).cast("string"))).alias("conv")


def repair(conversations: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Finds faults and the cheapest repair of every conversation of ``conversations``, and of those in ``ids`` that have no turns.

    Turns are ordered by ``turn``, null first; those of one number by role and SHA-256 of the text, so repeated rows are neighbours.
    A null role or text is one blank; a null ``conv`` is a conversation like any other. The first fault of a turn counts: blank (no
    character but white space), duplicate (role and text occur earlier in the conversation), truncated (the last character other
    than white space is none of ``.!?``). ``illegal`` counts neighbours whose role initials are not su, ua or au; ``gaps`` is the
    numbers missing between lowest and highest turn. Blank and duplicate turns are deleted; a conversation without turns has
    zeros and an empty audit. An empty table gives no rows; columns other than the four are not read.

    A row of the result holds a whole audit, one character a turn, and a digest of a whole conversation; one task reads a conversation
    from end to end for that. Texts pass through as a stream, and duplicates are found by aggregation, not in that task.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    kind = conversations.select(conv).schema[0].dataType.simpleString()
    turns = conversations.select(
        _named(conv), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    core = F.rtrim("text", F.lit(BLANKS))
    kinds = turns.select("conv", "turn", "role", "digest", (core == "").alias("blank"), (~F.substring(core, -1, 1).isin(".", "!", "?")).alias("cut")).groupBy(
        "conv", "turn", "role", "digest").agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.count("*").alias("n"))
    kinds = cut_lineage(kinds)
    order = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    firsts = kinds.groupBy("conv", "role", "digest").agg(F.min(order).alias("lead"))
    marked = kinds.join(firsts, ["conv", "role", "digest"]).select("conv", "turn", "role", "digest", "blank", "cut", (order == F.col("lead")).alias("first"), "n")
    summed = marked.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "digest").mapInArrow(
        _sequences, "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, sequence string")
    summed = cut_lineage(summed)

    audits = summed.groupBy("sequence").agg(F.count("*").alias("n"))
    solved = cut_lineage(audits.join(audits.select("sequence").repartition("sequence").mapInArrow(_repairs, "sequence string, cost bigint, audit string"), "sequence"))
    total = summed.count()
    is_hot = (F.col("n") * HOT_SHARE >= F.lit(total)) & (F.length("sequence") <= HOT_LENGTH)
    hot, rest = solved.where(is_hot).drop("n"), solved.where(~is_hot).drop("n")
    joined = summed.join(F.broadcast(hot), "sequence").unionByName(
        summed.join(F.broadcast(hot.select("sequence")), "sequence", "left_anti").join(rest, "sequence")).drop("sequence")
    if ids is not None:
        known = ids.select(_named(conv)).distinct()
        joined = known.join(joined, "conv", "left").fillna(0).fillna("", subset=["audit"])
    return Repair(turns, joined.select(*_HEAD), conv, kind)
