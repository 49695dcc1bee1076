"""Corpus operators against SQL, brute force, round trips and held-out accuracy, and on odd tables."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from oracle import canonical, connect
from pyspark.sql import functions as F

from sessionloom.llm import decontamination, jaccard, licenses, mixing, pu_quality, quality_rules, sharding, tokens, toxicity, urls
from sessionloom.llm.queries import REGISTRY, tokenizer_path
from sessionloom.llm.text import word_count

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, copies int, key string, slot int, w string, label string"


def odd_rows() -> list[tuple]:
    rng = random.Random(1)
    long = " ".join(rng.choice("alpha beta gamma delta the of and to".split()) for _ in range(30_000))
    base = "the quick brown fox jumps over the lazy dog and runs to the river of stones"
    texts = [None, "", " \t\n ", "one", "two words", base, base, base.upper(), base + " again", long, "x\n\nx\nx y\n", "The !!! ### | the", "\x1c odd\x85space here  two  blanks "]
    return [(i if i != 3 else None, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "clash", 9, "k", 1, "w", None)
            for i, t in enumerate(texts)] + [(5, base, "en", "s1", 3, "clash", 9, "k", 1, "w", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_matches_sql(spark, name):
    function, sql = REGISTRY[name]
    got, want = canonical(function(spark, FOLDER).toPandas()), canonical(connect(FOLDER).execute(sql).fetchdf())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_mix_meets_targets(odd, empty, documents):
    mixed = mixing.mix(documents, word_count(F.col("text"))).toPandas()
    assert (mixed.taken <= 3 * mixed["size"]).all()
    joined = mixed.groupby("source", dropna=False).agg(t=("target", "first"), n=("taken", "sum"), most=("size", "max"), s=("source_size", "first"))
    assert (abs(joined.t - joined.n) <= joined.most).all() and (joined.t <= 3 * joined.s + 1e-6).all()
    assert abs(joined.t.sum() - joined.s.sum()) < 1e-3
    rows = mixing.mix(odd, word_count(F.col("text")), key="doc_id").collect()
    assert len(rows) == odd.count() and all(r.taken == r.copies * r["size"] for r in rows)
    assert mixing.mix(empty, word_count(F.col("text"))).count() == 0


def test_mix_with_repeated_ids_capped_sources_and_long_documents(spark):
    rng = random.Random(9)
    texts = [(i // 2, "twice", 100) for i in range(20)] + [(None, "none", 100)] * 20
    texts += [(1000 + i, "capped", 10) for i in range(40)] + [(2000 + i, "large", rng.choice([5, 7, 300])) for i in range(400)] + [(5000, "large", 40_000)]
    docs = spark.createDataFrame([(k, "w " * n, s) for k, s, n in texts], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs, word_count(F.col("text")), weights=(5.0, 1.0, 1.0, 1.0)).collect()
    assert len(rows) == len(texts)
    for source in ("twice", "none", "capped", "large"):
        mine = [r for r in rows if r.source == source]
        short = mine[0].target - sum(r.taken for r in mine)
        left = [r["size"] for r in mine if r.copies < 3 and r.copies <= mine[0].target / mine[0].source_size]
        assert abs(short) <= min(left, default=0) / 2 + 1e-6, source


def test_mix_favours_higher_odds(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 3000, "x").otherwise("y").alias("source"),
                                    F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("good"))
    mixed = mixing.mix(docs, word_count(F.col("text")), weights=(1.0, 3.0), odds=F.col("good")).join(docs.select("doc_id", "good"), "doc_id")
    means = {(r.source, r.good): r.m for r in mixed.groupBy("source", "good").agg(F.avg("copies").alias("m")).collect()}
    assert means["x", 3.0] == pytest.approx(3 * means["x", 1.0], rel=0.1)


def test_leaks_against_brute_force(spark, odd, empty):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([1, 3, 5, 8, 14, 20, 33, 50, 59])]
    docs = []
    for d in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(0, 120))
        if d % 2:
            leak = items[rng.randrange(len(items))][1].split()
            for _ in range(rng.randrange(0, len(leak) // 6 + 1)):
                at = rng.randrange(len(leak))
                leak[at:at + rng.randrange(2)] = rng.choice([[], ["zz"], ["qq", "rr"]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak
        docs.append((d, " ".join(words)))
    benchmark = spark.createDataFrame([*items, (90, None), (91, ""), (None, "w1 w2 w3")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), benchmark).collect()}
    want = brute.leaks(docs, items, decontamination.EDIT_RATE)
    assert len(want) > 20 and set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert all(got[k] == want[k] for k in got)
    assert decontamination.find_leaks(odd, benchmark).where("edits > 0").count() == 0
    assert decontamination.find_leaks(empty, benchmark).count() == 0
    assert decontamination.find_leaks(odd, benchmark.where("false")).count() == 0
    blocks = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), benchmark, item_block=2)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} >= {k for k, e in want.items() if e == 0}


def test_walks_stay_close_after_an_edit():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 500, (50, 40)).astype(np.int32)
    b = np.concatenate([a[:, :10], a[:, 11:], np.zeros((50, 1), np.int32)], axis=1)
    n = np.full(50, 40)
    mine, edited, other = (decontamination.walks(x, n, 1) for x in (a, b, a[::-1].copy()))
    assert (mine == decontamination.walks(a, n, 1)).all()
    walking = mine > 0
    assert (mine == edited)[walking].mean() > 0.5 > 0.1 > (mine == other)[walking].mean()


def near_copies(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(rng.randrange(5, 150))]
        for _ in range(rng.randrange(1, 40)):
            words = list(base)
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
            rows.append(words + (passage if rng.random() < 0.3 else []))
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("region_rows,block_bytes", [(256, 16_000_000), (1, 4_000), (8, 20_000)])
def test_join_against_brute_force(spark, region_rows, block_bytes):
    rows = near_copies(region_rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = jaccard.join_documents(docs, region_rows=region_rows, block_bytes=block_bytes)
    want = sorted(brute.jaccard_components(rows))
    assert len({w[2] for w in want}) < len(want)
    assert sorted(map(tuple, got.collect())) == want


def test_join_on_odd_tables(odd, empty, documents):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, jaccard.join_documents(odd).collect()), key=key) == sorted(brute.jaccard_components(rows), key=key)
    assert jaccard.join_documents(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(map(tuple, jaccard.join_documents(documents).collect())) == sorted(brute.jaccard_components(rows))


def test_long_sets_leave_the_single_task(spark, monkeypatch):
    """A region of few rows but many bytes is joined by star and blocks: no task gets its sets together."""
    rng = random.Random(21)
    base = [f"b{j}" for j in range(3000)]
    rows = []
    for i in range(40):
        words = list(base)
        for at in rng.sample(range(3000), 3):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    seen = spark.sparkContext.accumulator(0)
    finish = jaccard._finish

    def watched(percent):
        inner = finish(percent)

        def group(table):
            if sum(map(len, table.column("core").to_pylist())) > 200_000:
                seen.add(1)
            return inner(table)

        return group

    monkeypatch.setattr(jaccard, "_finish", watched)
    got = jaccard.join_documents(docs, block_bytes=100_000).collect()
    assert sorted(map(tuple, got)) == sorted(brute.jaccard_components(rows)) and {r.component_id for r in got} == {0}
    assert seen.value == 0


def test_hot_shingles_are_announced(spark):
    """A passage in all documents of a batch and a large group of near copies."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, " ".join([f"d{i}x{j}" for j in range(60)]) + " " + passage) for i in range(150)]
    base = [f"b{j}" for j in range(80)]
    for i in range(150, 400):
        words = list(base)
        words[rng.randrange(80)] = f"n{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    assert sorted(map(tuple, jaccard.join_documents(docs, region_rows=50, block_bytes=30_000).collect())) == sorted(brute.jaccard_components(rows))


def test_licences(spark, odd, empty):
    rng = random.Random(11)
    plain = [" ".join(rng.choices("the of and to river stone tree house was for with version note use this".split(), k=12)) for _ in range(400)]
    model = licenses.fit(plain)
    scanner = licenses.Scanner(model)
    right = total = 0
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for text in licenses.variants(notice, random.Random(77), 3):
                total += 1
                right += (scanner(text) or ("",))[0] == family
    assert right / total > 0.9
    assert not any(scanner(p) for p in plain[:200])
    assert scanner("This font is licensed under the SIL Open Font License, Version 1.1")[0] == licenses.UNKNOWN
    docs = spark.createDataFrame([(1, "a b\nReleased under the MIT License.\nc d"), (2, "nothing here")], "doc_id bigint, text string")
    assert [(r.doc_id, r.paragraph, r.family) for r in licenses.scan(docs, model).collect()] == [(1, 1, "mit")]
    assert licenses.scan(odd, model).count() == 0 and licenses.scan(empty, licenses.train(empty)).count() == 0


def test_wrapped_licences(spark):
    """Notices wrapped as file headers carry them, behind comment signs, beside other notices and in the middle of lines."""
    rng = random.Random(12)
    plain = [" ".join(rng.choices("the of and to river stone tree house was for with version note use this".split(), k=12)) for _ in range(400)]
    texts = [
        "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
        "# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
        "Copyright (c) 2020 Jane Roe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
        "documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify",
        " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:",
        f"{plain[0]} {plain[1]}\n{plain[2]} This work is licensed under a Creative Commons Attribution-\nShareAlike 4.0 International License. {plain[3]}\n{plain[4]}",
        "the river\nReleased under the MIT License.\nAll rights reserved.\n\nLicensed under the GNU Affero\nGeneral Public License,\nversion 3\nthe stone",
        f"{plain[5]}\n{plain[6]}\n\n{plain[7]}"]
    want = [(0, 0, "gpl"), (1, 2, "mit"), (2, 0, "bsd"), (3, 1, "cc-by-sa"), (4, 1, "mit"), (4, 2, "proprietary"), (4, 4, "agpl")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = licenses.scan(docs, licenses.fit(plain)).where(F.col("family") != licenses.UNKNOWN).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got) == want
    # A notice is not carried over a blank line.
    assert "gpl" not in [n[1] for n in licenses.Scanner(licenses.fit(plain)).notices(texts[0].replace("modify\n", "modify\n\n"))]


def test_licence_sample(spark):
    """Words far inside a long paragraph reach `none`, and the sizes of the sample are arguments."""
    docs = spark.createDataFrame([(i, "river stone " * 500 + f"tail{'ab'[i % 2]}\nshort line {i}") for i in range(6)], "doc_id bigint, text string")
    assert {"taila", "tailb"} <= set(licenses.train(docs).features)
    assert "river" not in licenses.train(docs, sample_lines=0).features and "river" not in licenses.train(docs, sample_docs=0).features


def test_token_file_round_trip(spark, odd, empty, documents, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    for n, docs in enumerate((documents, odd)):
        path = str(tmp_path / f"file{n}")
        tokens.write(docs, path, tokenizer_path(), shard_ids=5000)
        got = sorted((r.start, r.key, r.n_tokens, r.ids_crc32) for r in tokens.read(spark, path).collect())
        rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0]))
        at, want = 0, []
        for key, text in rows:
            ids = [*(whole.encode(text, add_special_tokens=False).ids if text else []), 0]
            want.append((at, key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert sorted(g[1:] for g in got if g[1] is not None) == sorted(w[1:] for w in want if w[1] is not None)
    stored = spark.read.parquet(str(tmp_path / "file0")).limit(1).collect()[0].asDict()
    keys, sizes, grammar, _ = tokens.unpack(stored)
    everything, ends = grammar.decode(), np.cumsum(sizes)
    assert len(grammar.left) > 0 and len(grammar.body) < len(everything)
    for i in range(0, len(keys), 3):
        assert (tokens.decode_document(stored, i) == everything[ends[i] - sizes[i]:ends[i]]).all()
    tokens.write(empty, str(tmp_path / "none"), tokenizer_path())
    assert tokens.read(spark, str(tmp_path / "none")).count() == 0


def test_pieces_have_the_ids_of_whole_texts():
    """Texts of anything that cutting could get wrong, and a word goes to the model once whatever marks or line ends stand beside it."""
    rng = random.Random(6)
    parts = ["a", "b", "é", "Th", "ing", *[" "] * 5, "  ", "\n", "\n\n", ".", ",", "'s", "'", "don't", "²", "½", "3", "日", "ш", "ա", "\u0300", "<|",
             "<|endoftext|>", "-", "?!", "###", "\t", "\xa0", "😀", "_", "İ", "ß", "ª"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000))]
    encode = tokens.encoder(tokenizer_path())
    assert encode(pa.array(texts, pa.string())) == [encode.whole(t) if t else b"" for t in texts]
    assert sum(map(bool, encode.cuttable(pa.array(texts[2:])))) > 300 and encode(pa.array([None, None], pa.string())) == [b"", b""]
    fresh = tokens.Encoder(tokenizer_path())
    assert fresh(pa.array(["x zebra zebra, zebra. zebra.### \"zebra\" zebra;"])) == [fresh.whole("x zebra zebra, zebra. zebra.### \"zebra\" zebra;")]
    assert [w for w, ids in fresh.words.items() if ids is not None] == ["\nx", "zebra"] and list(fresh.odd) == ['"zebra"']


def test_slices_take_every_row():
    texts = pa.array(["x" * n if n else None for n in (0, 3, tokens.SLICE_BYTES, 5, 0, 7, tokens.SLICE_BYTES // 2, tokens.SLICE_BYTES // 2)])
    assert [x for s in tokens._slices(texts) for x in s.to_pylist()] == texts.to_pylist()
    assert all(len(s) == 1 or sum(len(x or "") for x in s.to_pylist()) <= tokens.SLICE_BYTES for s in tokens._slices(texts))


@pytest.mark.parametrize("ids", [[], [5], [7] * 1000, [1, 2] * 500, [3, 3, 4] * 300])
def test_grammar_round_trip(ids):
    array, last = np.array(ids, dtype=np.uint16), np.zeros(len(ids), dtype=bool)
    last[9::10] = True
    grammar = tokens.compress(array, last, 50_257, least=2)
    assert grammar.decode().tolist() == ids
    if len(ids) > 100:
        assert len(grammar.body) < len(ids) / 2


def test_grammar_goes_on_to_whole_copies():
    """Copies of a long text end as one symbol each, however deep the rules; so do ascending ids and a run of one id."""
    rng = np.random.default_rng(3)
    for text, copies in ((rng.integers(1, 50_000, 3000), 40), (np.arange(1, 3001), 40), (np.full(4096, 7), 40)):
        ids = np.tile(text, copies).astype(np.uint16)
        last = np.zeros(len(ids), dtype=bool)
        last[len(text) - 1::len(text)] = True
        grammar = tokens.compress(ids, last, 50_257)
        assert (grammar.decode() == ids).all()
        assert len(grammar.body) == copies and len(grammar.left) < 1.1 * len(text)


def accuracy(spark, name: str, label: str, folder: str) -> float:
    got = REGISTRY[name][0](spark, folder).toPandas()
    assert got.score.between(0, 1).all()
    joined = got.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    held = joined[joined.held_out]
    return float((held.predicted == held[label]).mean())


def test_toxicity(spark, odd, empty):
    assert accuracy(spark, "op6_toxicity", "toxic", "/root/testdata/sf0.01") > 0.93
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels)
    scored = toxicity.score(odd, model)
    assert scored.columns == [*odd.columns, "score"] and scored.where("score between 0 and 1").count() == odd.count()
    assert toxicity.score(empty, toxicity.train(empty, labels.where("false"))).count() == 0
    lexicon = toxicity.fit([], np.zeros(0), 0.1)
    assert [round(s) for s in toxicity.scores(lexicon, ["you idiot", "a fine day", None], {})] == [1, 0, 0]


def test_label_model_recovers_rates():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.3
    rates = np.array([0.6, 0.5, 0.4, 0.7, 0.3])
    votes = (rng.random((4000, 5)) < np.where(truth[:, None], rates, 0.02)).astype(float)
    posterior, on, off, _ = toxicity.label_model(votes, 0.3)
    assert np.abs(on - rates).max() < 0.15 and off.max() < 0.1
    assert ((posterior > 0.5) == truth).mean() > 0.9


def test_quality(spark, odd, empty):
    assert accuracy(spark, "op8_pu_quality", "quality", "/root/testdata/sf0.01") > 0.93
    model = pu_quality.train(odd, odd.where("doc_id in (5, 6, 9)").select("doc_id"))
    assert odd.select(pu_quality.score(F.col("text"), model).alias("s")).where("s between 0 and 1").count() == odd.count()
    none = pu_quality.train(empty, empty.select("doc_id"))
    assert odd.select(pu_quality.score(F.col("text"), none).alias("s")).where("s = 0.5").count() == odd.count()


def test_quality_rules_on_odd_tables(odd, empty):
    judged = quality_rules.judge(odd, out="verdict")
    assert judged.columns == [*odd.columns, "verdict"] and quality_rules.judge(empty).count() == 0
    for row in judged.select("text", "verdict.*").collect():
        words = brute.words(row.text)
        assert row.n_words == len(words) and row.word_chars == sum(map(len, words)) and row.n_repeat_words == brute.repeated_words(words)
    with pytest.raises(ValueError):
        quality_rules.judge(odd, out="text")


def test_shards(spark, odd, empty, documents, tmp_path):
    path = str(tmp_path / "map")
    placed = sharding.shard_documents(documents, shards=6, path=path).toPandas()
    loads = placed.groupby("shard")["size"].sum()
    assert len(loads) == 6 and loads.max() - loads.min() <= placed["size"].max()
    for _, group in placed.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert sharding.load_map(spark, path).version == 2 and sharding.load_map(spark, path, 1).shard_of[:3] == [0, 1, 2]
    assert placed.groupby("virtual_slot").shard.nunique().max() == 1
    old = sharding.load_map(spark, path)
    sizes = [0] * sharding.SLOTS
    for slot, size in zip(placed.virtual_slot, placed["size"], strict=True):
        sizes[slot] += size
    grown = sharding.rebalance(old, sizes, 7)
    assert grown.version == 3 and 6 in grown.shard_of
    rows = sharding.shard_documents(odd, shards=3).collect()
    assert len(rows) == odd.count() and all(r["size"] >= 8 for r in rows)
    assert sharding.shard_documents(empty).count() == 0


def test_stored_map_places_the_query(spark, monkeypatch):
    """The query stores both versions, and the stored one is what its rows follow."""
    paths = []
    load = sharding.load_map

    def turned(session, path, version=None):
        paths.append(path)
        stored = load(session, path, version)
        return sharding.SlotMap(stored.version, [(shard + 1) % 24 for shard in stored.shard_of])

    plain = {r.doc_id: r.shard for r in REGISTRY["op9_virtual_slots"][0](spark, FOLDER).collect()}
    monkeypatch.setattr(sharding, "load_map", turned)
    moved = {r.doc_id: r.shard for r in REGISTRY["op9_virtual_slots"][0](spark, FOLDER).collect()}
    assert moved == {k: (shard + 1) % 24 for k, shard in plain.items()}
    assert [load(spark, paths[0], v).version for v in (None, 1)] == [2, 1]


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme/x", "", "", None, "allow"),
    ("http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"), ("https://x.example.com/de/1#t", "x.example.com", "/de/1", "example.com/de/", "block"),
    ("http://casino.example.org/fr/1", "casino.example.org", "/fr/1", "org/fr/", "allow"), ("http://casino.example.org/en/1", "casino.example.org", "/en/1", None, "block"),
    ("http://cheap-pills.example.com/a", "cheap-pills.example.com", "/a", None, "block"), ("http://cheap.example.com/a", "cheap.example.com", "/a", None, "allow"),
    ("http://essexcasinos.example.com/", "essexcasinos.example.com", "/", None, "allow"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow")])
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "h")], "page_id bigint, url string, host string")
    row = urls.judge(pages).collect()[0]
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_urls_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def sent_rows(spark, docs, buckets: int) -> int:
    hashed = docs.select(F.col("doc_id").alias("key"), F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("w"))
    shared = spark.sparkContext.broadcast(jaccard.hot_classes(jaccard.frequency_sketch(hashed, 5)))
    return hashed.coalesce(1).mapInArrow(jaccard._send(5, buckets, shared), jaccard._PACKED).count()


def test_rows_of_a_slice_do_not_follow_the_bucket_count(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(str(rng.randint(0, 10 ** 6)) for _ in range(24))) for i in range(50)], "doc_id bigint, text string")
    assert sent_rows(spark, docs, 10 ** 7) <= 50 * (20 + 1) + 1 and sent_rows(spark, docs, 10 ** 9) <= 50 * (20 + 1) + 1


def test_shingles_thin_everywhere_are_hot_for_all(spark, monkeypatch):
    """A passage in a tenth of the texts, below the bound within every slice: no bucket lists it, and the join stays exact."""
    monkeypatch.setattr(jaccard, "SKETCH_LEAST", 20)
    monkeypatch.setattr(jaccard, "SKETCH_MEANS", 0)
    rng = random.Random(8)
    passage = "this passage of eight words stands in many"
    rows = []
    for i in range(300):
        own = " ".join(rng.choice("abcdefghij") * 3 + str(rng.randint(0, 400)) for _ in range(25))
        rows.append((i, f"{passage} {own}" if i % 4 == 0 else own if i % 10 else f"{rows[rng.randint(0, i - 1)][1] if i else own} more"))
    rows += [(1000 + i, passage + " end" * (i % 3)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    hashed = docs.select(F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("w"))
    classes = jaccard.hot_classes(jaccard.frequency_sketch(hashed, 5))
    tokens = jaccard.shingle_sets(np.array(hashed.where("size(w) = 8").first().w, dtype=np.int64), np.array([0, 8]), 5)[0]
    assert len(tokens) == 4 and (jaccard._class_of(tokens, classes) > jaccard.HOT).all()
    got = sorted(map(tuple, jaccard.join_documents(docs).collect()))
    assert got == sorted(brute.jaccard_components(rows))


def test_a_range_is_decoded_from_the_rules_below_it_only():
    rng = random.Random(12)
    phrase = [[rng.randint(1, 900) for _ in range(40)] for _ in range(30)]
    parts = [phrase[rng.randint(0, 29)] + [0] for _ in range(6000)]
    ids, last = np.array([i for p in parts for i in p], dtype=np.uint16), np.concatenate([[*[False] * 40, True]] * len(parts))
    grammar = tokens.compress(ids, last, 1000)
    size = np.concatenate([np.ones(1000, dtype=np.int64), grammar.lengths.astype(np.int64)])[grammar.body]
    marks = (np.cumsum(size) - size)[::tokens.MARK]
    assert len(marks) > 2 and len(grammar.left) > 100
    for lo, hi in [(0, 41), (41 * 77, 41 * 78), (123_456, 123_460), (len(ids) - 41, len(ids)), (500, 500), (0, len(ids))]:
        assert (grammar.decode(lo, hi, marks) == ids[lo:hi]).all()
    # Rules that the range does not use may even be broken.
    lo, hi = 41 * 77, 41 * 78
    used, stack = set(), grammar.body[np.searchsorted(np.cumsum(size), lo, "right"):np.searchsorted(np.cumsum(size), hi, "left") + 1].tolist()
    while stack:
        if (s := stack.pop()) >= 1000 and s not in used:
            used.add(s)
            stack += [int(grammar.left[s - 1000]), int(grammar.right[s - 1000])]
    left = grammar.left.copy()
    left[[r for r in range(len(left)) if r + 1000 not in used]] = 65_535
    assert len(used) < len(left) / 2 and (grammar._replace(left=left).decode(lo, hi, marks) == ids[lo:hi]).all()
