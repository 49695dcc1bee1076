"""Incremental components and digest trees."""

import random

import pytest

from sessionloom.operators import dedup
from sessionloom.sources import digests, stores


def test_merged_components_equal_a_search_from_scratch(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randint(0, 90):02d}", f"n{rng.randint(0, 90):02d}") for _ in range(80)]
    stars = dedup.connected_components(spark.createDataFrame(edges[:30], "a string, b string"))
    for lo in (30, 31, 55):
        hi = {30: 31, 31: 55, 55: 80}[lo]
        stars = dedup.cut_lineage(dedup.merge_components(stars, spark.createDataFrame(edges[lo:hi], "a string, b string")))
        want = dedup.connected_components(spark.createDataFrame(edges[:hi], "a string, b string"))
        proper = lambda df: {r.node: r.root for r in df.collect()}
        got = proper(stars)
        assert {k: v for k, v in got.items() if k in proper(want)} == proper(want)
    assert stars.count() == stars.select("node").distinct().count()
    same = dedup.merge_components(stars, spark.createDataFrame(edges[:10], "a string, b string"))
    assert proper(same) == got


def test_index_takes_batches_and_repeats_a_failed_one(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"e{rng.randint(0, 40)}", f"n{rng.randint(0, 25)}", f"v{rng.randint(0, 3)}") for i in range(120)]
    docs = spark.createDataFrame(rows, "session_id bigint, exact_signature string, near_signature string, identity string")
    folder = str(tmp_path / "index")
    for version, (lo, hi) in enumerate([(0, 50), (50, 51), (51, 120)]):
        for _ in range(2):
            dedup.add_batch(spark, docs.where(f"session_id >= {lo} and session_id < {hi}"), folder, version)
    key = lambda df: sorted((r.session_id, r.component, r.reason) for r in df.collect())
    assert key(dedup.indexed_groups(spark, docs, folder, 2)) == key(dedup.duplicate_groups(docs))
    first = docs.where("session_id < 50")
    assert key(dedup.indexed_groups(spark, first, folder, 0)) == key(dedup.duplicate_groups(first))


def test_tree_levels_and_damage(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.bin").write_bytes(bytes(range(256)) * 40)
        (tmp_path / name / "empty.bin").write_bytes(b"")
    data = bytearray((tmp_path / "b" / "x.bin").read_bytes())
    data[7000] ^= 1
    (tmp_path / "b" / "x.bin").write_bytes(data + b"more")
    blocks = {n: digests.block_digests(spark, str(tmp_path / n), block_bytes=100).cache() for n in "ab"}
    assert blocks["a"].count() == 104 and blocks["a"].agg({"bytes": "sum"}).first()[0] == 10_240
    for fan in (2, 7, 256):
        roots = [{r.path.rsplit("/")[-1]: r.digest for r in digests.tree_digests(blocks[n], fan).collect()} for n in "ab"]
        assert roots[0]["empty.bin"] == roots[1]["empty.bin"] and roots[0]["x.bin"] != roots[1]["x.bin"]
    wrong = {(r.file, r.block, r.problem) for r in digests.damaged_blocks(blocks["a"], blocks["b"]).collect()}
    assert wrong == {("x.bin", 70, "changed"), ("x.bin", 102, "changed")}


def test_facts_are_read_back_and_guarded(spark, tmp_path):
    root = str(tmp_path / "out")
    stores.save_tables(spark, root, {"t": spark.range(10), "u": spark.range(3)}, {"kind": "x", "seed": 7})
    assert stores.read_facts(spark, root)["seed"] == "7" and stores.load_tables(spark, root, ["u"])["u"].count() == 3
    rows = [(r.key, "8" if r.key == "seed" else r.value) for r in spark.read.parquet(f"{root}/_facts").collect()]
    spark.createDataFrame(rows, "key string, value string").write.mode("overwrite").parquet(f"{root}/_facts")
    with pytest.raises(ValueError, match="fingerprint"):
        stores.load_tables(spark, root, ["t"])
