"""The pipeline against a plain version of its five stages."""

from __future__ import annotations

import zlib

import brute
import corpus_pipeline
import numpy as np
from oracle import connect
from pyspark.sql import functions as F

from sessionloom.llm import decontamination, mixing, oracle
from sessionloom.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    good = {r[0] for r in connect(FOLDER).execute(f"SELECT doc_id FROM ({oracle.QUALITY_RULES}) WHERE kept").fetchall()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    classes = {k: c for k, _, c in brute.jaccard_components(left)}
    left = [(k, t) for k, t in left if classes[k] == k]
    items = [(r.item_id, " ".join(words(r.text))) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = [(k, " ".join(words(t))) for k, t in left]
    known = {w for _, t in items for w in t.split()}
    rows = [(k, t) for k, t in rows if sum(w in known for w in t.split()) >= 8]
    leaked = {d for d, _ in brute.leaks(rows, items, decontamination.EDIT_RATE)}
    left = [(k, t) for k, t in left if k not in leaked]
    mixed = mixing.mix(docs.where(F.col("doc_id").isin([k for k, _ in left])), F.size(F.split(F.trim("text"), r"\s+")))
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    whole = Tokenizer.from_file(tokenizer_path())
    want, at = [], 0
    for key, text in sorted(left):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 0]
        for _ in range(copies[key]):
            want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == want and len(want) > 50


def words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", text.lower())


def test_stages_on_an_empty_table_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), FOLDER)
        assert out.count() == 0, name
    few = docs.limit(5)
    kept = corpus_pipeline.near_duplicate_stage(spark, few.unionByName(few), FOLDER)
    assert kept.columns == docs.columns and kept.count() == kept.select("doc_id").distinct().count()


ROW = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], ROW)


def test_near_duplicates_of_a_repeated_id_keep_both_texts(spark):
    a, b = ("the quick brown fox jumps over the lazy dog by the river", "seven wise owls sat on an old oak and sang all night long")
    kept = sorted((r.text, r.doc_id) for r in corpus_pipeline.near_duplicate_stage(spark, rows_of(spark, [(3, b), (7, a), (7, b)]), FOLDER).collect())
    assert kept == [(b, 3), (a, 7)]
    kept = corpus_pipeline.near_duplicate_stage(spark, rows_of(spark, [(None, a), (None, b), (None, a), (7, b), (7, b)]), FOLDER)
    assert sorted(r.text for r in kept.collect()) == sorted([a, b])


def test_a_leak_without_id_goes(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    clean = "an invented sentence about nothing that any benchmark of this folder could know by heart at all"
    docs = rows_of(spark, [(None, item), (None, clean), (4, item), (4, clean), (5, clean)])
    left = corpus_pipeline.decontamination_stage(spark, docs, FOLDER)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, clean), (4, clean), (5, clean)]


def test_mixing_counts_each_row_of_an_id(spark):
    docs = spark.createDataFrame([(i % 10 if i < 30 else None, f"w{i} " * 100, "en", s, 1) for s in ("a", "b") for i in range(40)], ROW)
    mixed = corpus_pipeline.mixing_stage(spark, docs, FOLDER)
    sizes = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    want = {r.source: r.target for r in mixing.mix(docs, F.lit(100)).select("source", "target").distinct().collect()}
    assert all(abs(sizes[s] - want[s]) <= 50 for s in want)


def test_rows_are_told_apart_at_the_ends_of_the_number_range(spark):
    for ids in ([1, 2, 3], [1, 1, None], [2 ** 63 - 1, 2 ** 63 - 1, 5], [None, None]):
        rows, key = corpus_pipeline.keyed(rows_of(spark, [(i, "x") for i in ids]).withColumn("_ROW", F.lit(1)))
        assert key == "_row_" and rows.select(key).distinct().count() == len(ids)
