"""Hard negatives, SimHash components and conversation repair against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from brute import words
from pyspark.sql import functions as F

from sessionloom.llm import dialogues, hard_negatives, simhash
from sessionloom.llm.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Hard negatives.

def brute_negatives(rows: list[tuple], every: int) -> Counter:
    """Result rows for (key, vector, label), with floors by Python integers."""
    kept = [(k, [math.floor(256 * x) for x in v], lab) for k, v, lab in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out: Counter = Counter()
    for i, (key, vector, label) in enumerate(kept):
        if key is None or key % every:
            continue
        others = [(-sum(x * y for x, y in zip(vector, v, strict=False)), k is None, k or 0, k, lab) for j, (k, v, lab) in enumerate(kept) if j != i]
        others.sort(key=lambda o: o[:3])
        for p in [o for o in others if o[4] == label][:5]:
            hard = [o for o in others if o[4] != label and 50 * -p[0] <= 100 * -o[0] <= 95 * -p[0]][:3]
            out.update((key, p[3], rank, h[3], -p[0], -h[0]) for rank, h in enumerate(hard, 1))
    return out


def mined(rows, every: int) -> Counter:
    return Counter(tuple(r) for r in hard_negatives.mine(rows, F.col("vec_id") % every == 0).collect())


def test_strassen_is_exact():
    rng = np.random.default_rng(0)
    for n, k, m in ((1, 1, 1), (33, 65, 9), (100, 64, 77), (17, 1, 300)):
        a, b = rng.integers(-2 ** 20, 2 ** 20, (n, k)), rng.integers(-2 ** 20, 2 ** 20, (k, m))
        assert (hard_negatives.strassen(a, b, leaf=4) == a @ b).all()
    # Sums inside the recursion pass 64 bits here, the products do not.
    a, b = np.diag([2 ** 31] * 32), np.diag([2 ** 31 - 1] * 32)
    assert (hard_negatives.strassen(a, b, leaf=2) == a @ b).all()
    big = hard_negatives.strassen(np.array([[2 ** 70] * 20] * 20, dtype=object), np.array([[3] * 20] * 20, dtype=object), leaf=4)
    assert big[3, 7] == 60 * 2 ** 70


@pytest.mark.parametrize("block, group", [(1024, 8192), (3, 40)])
def test_negatives_against_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", group)
    rng = random.Random(7)
    rows = [(i, [rng.choice([-0.5, 0.1, 0.25, 0.3]) for _ in range(6)], rng.randint(0, 2)) for i in range(150)]
    # Repeated rows, repeated keys with other vectors, ties, nulls of every kind, ragged and empty vectors, a negative and a null key.
    rows += [rows[10]] * 3 + [(20, [0.3] * 6, 1), (20, [0.3] * 6, 2), (-10, [0.1, 0.2], 1), (None, [0.25] * 6, 0), (None, [0.25] * 6, 1)]
    rows += [(200, None, 1), (210, [0.1, None], 1), (220, [math.nan, 0.1], 1), (230, [math.inf], 1), (240, [0.5] * 6, None), (250, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("anchor_id", F.lit("clash")).withColumn("grp", F.lit(1))
    got, want = mined(frame, 10), brute_negatives(rows, 10)
    assert want and got == want


def test_negatives_beyond_small_integers(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 2 ** rng.choice([1, 20]) for _ in range(5)], i % 2) for i in range(40)]
    assert mined(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), 10) == brute_negatives(rows, 10)


def test_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"), F.lit(True)).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(lone, F.lit(True)).count() == 0


# SimHash.

def brute_fingerprint(text: str | None) -> int:
    w = words((text or "").translate(FOLD))
    hashes = [xxhash.xxh64(" ".join(w[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int], keys: list, distance: int = 4) -> list:
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                root[top(i)] = top(j)
    lowest: dict = {}
    for i, k in enumerate(keys):
        if k is not None:
            lowest[top(i)] = min(k, lowest.get(top(i), k))
    return [lowest.get(top(i)) for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = Counter((k, f"{f:016x}", c) for (k, _), f, c in zip(rows, fps, components(fps, [k for k, _ in rows]), strict=True))
    assert Counter(tuple(r) for r in REGISTRY["op12_simhash"][0](spark, FOLDER).collect()) == want


def test_simhash_odd_rows(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice("alpha beta gamma delta the of and to".split()) for _ in range(120_000))
    texts = [None, "", " \t\n", "One", "one", "one two three", "a b c d e", "\x1c odd\x85space here  two", long, long + " end", "x" * 300_000]
    rows = [(i if i not in (3, 8) else None, t) for i, t in enumerate(texts)] + [(5, "other words"), (5, "one two three"), (None, None)]
    fps = [brute_fingerprint(t) for _, t in rows]
    want = Counter((k, f"{f:016x}", c) for (k, _), f, c in zip(rows, fps, components(fps, [k for k, _ in rows]), strict=True))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    assert Counter(tuple(r) for r in simhash.near_duplicates(frame).collect()) == want
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("segments, distance", [(3, 4), (2, 4), (4, 4), (3, 3), (2, 1)])
def test_links_are_exactly_the_near_pairs(spark, segments, distance):
    """A dense cluster, borders at the distance, and fingerprints whose flips fall into one segment or are spread over all."""
    rng = random.Random(segments)
    fps = {0, 2 ** 64 - 1, 2 ** 63}
    for _ in range(25):
        centre = rng.getrandbits(64)
        places = [range(64), range(22), range(43, 64)][rng.randint(0, 2)]
        fps |= {centre} | {centre ^ sum(1 << b for b in rng.sample(list(places), k)) for k in range(1, 7) for _ in range(4)}
    signed = {f: f - 2 ** 64 if f >= 2 ** 63 else f for f in fps}
    want = {tuple(sorted((signed[a], signed[b]))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= distance}
    nodes = spark.createDataFrame([(f,) for f in signed.values()], "fp bigint")
    assert want and {tuple(r) for r in simhash.links(nodes, distance, segments).collect()} == want


def test_segments_follow_the_table():
    assert simhash.segments_of(10_000) == 3 and simhash.segments_of(10 ** 10) == 2
    assert simhash.layout(3, 4) == [(0, 22, 1), (22, 21, 1), (43, 21, 0)]


# Conversations.

def brute_audit(turns: list[tuple[str, str | None]]) -> tuple[int, str]:
    """Cheapest, then least audit of (role initial, fault) turns: a search by cost over places and states that keeps every tie."""
    follow, heap, best, ends = {0: 2, 1: 2, 2: 3, 3: 2}, [(0, "", 0, 0)], {}, []
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if ends and cost > ends[0][0]:
            break
        least, known = best.setdefault((i, state), (cost, set()))
        if cost > least or audit in known:
            continue
        known.add(audit)
        if i == len(turns) and state in (0, 3):
            ends.append((cost, audit))
        heapq.heappush(heap, (cost + 2, audit + "I", i, follow[state]))
        if i < len(turns):
            initial, fault = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, follow[state]))
                kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))
                if kept:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, kept))
    return min(ends)


def brute_repair(turns: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest, repaired) of ordered (turn, role, text)."""
    seen, faults = set(), []
    for _, role, text in turns:
        core = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    cost, audit = brute_audit([(r[:1], f) for (_, r, _), f in zip(turns, faults, strict=True)]) if turns else (0, "")
    follow, state, left, out = {0: "user", 1: "user", 2: "assistant", 3: "user"}, 0, list(turns), []
    for edit in audit:
        turn = left.pop(0) if edit != "I" else None
        if edit == "D":
            continue
        role = turn[1] if edit == "K" else follow[state]
        out.append((edit, role, turn[2] if turn else ""))
        state = 1 if edit == "K" and role[0] == "s" else 2 if follow[state] == "user" else 3
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in out).encode()).hexdigest()
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest, out


def test_sequences_against_search():
    rng = random.Random(5)
    sequences = ["".join(rng.choice(dialogues.SYMBOLS) for _ in range(rng.randint(1, 9))) for _ in range(300)] + [s for s in dialogues.SYMBOLS] + ["sua" * 4, "X" * 50]
    for sequence, got in zip(sequences, dialogues.repair_sequences(sequences), strict=True):
        assert got == brute_audit([(c.lower(), "blank" if c == "X" else "truncated" if c.isupper() else None) for c in sequence]), sequence
    # A sequence of its own or among many others: the grammar changes nothing.
    assert dialogues.repair_sequences(sequences[:1]) == dialogues.repair_sequences(sequences)[:1]
    assert dialogues.repair_sequences(["ua" * 30_000, "u" * 5_000])[0] == (0, "K" * 60_000)


def test_rope_order():
    rope = dialogues.Rope
    shared = rope("KK", "D")
    for a, b in [("K", "KD"), (rope("K", "D"), "KD"), (rope(shared, "I"), rope(shared, "K")), (rope("K", rope("K", "DI")), rope(rope("KK", "D"), "K")), ("", "D")]:
        assert dialogues.before(a, b) == (str(a) < str(b)) and dialogues.before(b, a) == (str(b) < str(a))


def test_registered_repair(spark):
    told: dict = {}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        place = f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}"
        kind, role, text = zlib.crc32(place.encode()) % 20, r.role or " ", r.text or " "
        rows = told.setdefault(r.conv_id, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [] if kind == 0 else [(r.turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    want = {k: brute_repair(sorted(rows))[:-1] for k, rows in told.items()}
    assert {r[0]: tuple(r[1:]) for r in REGISTRY["op13_dialogue_repair"][0](spark, FOLDER).collect()} == want


def test_repair_odd_conversations(spark):
    long = "word " * 50_000
    rows = [(1, None, "user", "Hi."), (1, 2, None, "x"), (1, 3, "assistant", None), (1, 3, "tool", "t."), (1, 9, "", "no role."), (1, 9, "", "no role."),
            (None, None, None, None), (None, None, "user", "a?"), (2, 5, "system", long), (2, 6, "user", "\x0b\x0c"), (2, 7, "user", " "), (2, 7, "user", "q? \n"),
            *[(3, 1, "user", "same.")] * 500, (3, 2, "assistant", "same."), (3, 0, "assistant", "same."), (4, 1, "assistant", ""), (5, 1, "a", "x!"), (6, 10 ** 15, "u", "u."),
            *[(7, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(300)]]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("audit", F.lit("clash")).withColumn("conv", F.lit(3))
    made = dialogues.repair(frame, ids=frame.select("conv_id").unionByName(spark.createDataFrame([(99,)], "conv_id bigint")))
    told: dict = {99: []}
    for conv, turn, role, text in rows:
        told.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    want = {k: brute_repair(sorted(v, key=order)) for k, v in told.items()}
    assert {r[0]: tuple(r[1:]) for r in made.summaries().collect()} == {k: v[:-1] for k, v in want.items()}
    repaired: dict = {}
    for r in made.repaired().orderBy("position").collect():
        repaired.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert repaired == {k: v[-1] for k, v in want.items() if v[-1]}
    assert dialogues.repair(frame.limit(0)).summaries().count() == 0
