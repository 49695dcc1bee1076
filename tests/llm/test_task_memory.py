"""What a Python task holds at once, and what its worker keeps: two workers share an executor with its heap."""

from __future__ import annotations

import gc
import random
import string
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from sessionloom.llm import decontamination, jaccard, tokens
from sessionloom.llm.queries import tokenizer_path


def hashed(n_docs: int, n_words: int) -> pa.RecordBatch:
    flat = np.random.default_rng(4).integers(-2 ** 62, 2 ** 62, n_docs * n_words)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1, dtype=np.int32) * n_words), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(range(n_docs), pa.int64()), lists], names=["key", "w"])


def peak_of(work) -> float:
    """Most bytes of Python and NumPy at once, in MB."""
    gc.collect()
    tracemalloc.start()
    work()
    out = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out


def test_a_slice_is_sent_in_small_batches_and_little_memory():
    batch = hashed(1000, 1000)
    classes = SimpleNamespace(value=np.zeros((jaccard.SKETCH_ROWS, 1 << jaccard.SKETCH_BITS), dtype=np.uint8))
    parts: list[pa.RecordBatch] = []
    assert peak_of(lambda: parts.extend(jaccard._send(5, 40, classes)(iter([batch])))) < 75
    assert max(part.nbytes for part in parts) < 4_000_000
    rows = [row for part in parts for row in part.to_pylist()]
    assert sum(len(row["c"]) // 8 for row in rows if row["kind"] == jaccard._POSTINGS) == 1000 * 996
    assert sum(len(row["a"]) // 8 for row in rows if row["kind"] == jaccard._FACTS) == 1000


def test_documents_meet_the_benchmark_slice_by_slice():
    batch = hashed(4000, 300)
    words = batch.column("w").values.to_numpy().view(np.uint64)
    items = [(i, words[300 * i + 10:300 * i + 40]) for i in range(0, 4000, 500)]
    index = SimpleNamespace(value=decontamination.build_index(items, decontamination.EDIT_RATE, decontamination.RECALL))
    found = []
    assert peak_of(lambda: found.extend(r for part in decontamination._search([index])(iter([batch])) for r in part.to_pylist())) < 45
    assert sorted(tuple(r.values()) for r in found) == [(i, i, 10, 40, 0, 30) for i, _ in items]


def test_cached_words_are_small():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(30_000)})
    encode = tokens.Encoder(tokenizer_path())
    gc.collect()
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    got = encode(pa.array([" ".join(words)]))[0]
    kept = len(got)
    assert got == encode.whole(" ".join(words))
    del got
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert len(encode.words) == len(words) and kept > 0
    assert held < 60 * len(words)
