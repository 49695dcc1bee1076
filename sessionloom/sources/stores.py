"""Manifests, report scans, sinks and verified table folders."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config_hash
from ..runtime import require_empty
from .digests import block_digests, tree_digests


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Enrolment rows (label_name, path, format); relative paths are resolved against the manifest's folder."""
    rows = spark.read.option("header", True).csv(path)
    clean = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    base = posixpath.dirname(path)
    absolute = F.col("path").startswith("/") | F.col("path").rlike("^[a-z0-9]+:/")
    full = F.when(absolute, F.col("path")).otherwise(F.concat(F.lit(base + "/"), F.col("path")))
    uri = F.when(full.startswith("/"), F.concat(F.lit("file://"), full)).otherwise(full)
    return clean.select(F.col("label").alias("label_name"), uri.alias("path"), "format")


def read_reports(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """Report JSON files below ``root``; unreadable ones and those without a config are skipped (A10)."""
    reader = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json")
    rows = (reader.schema(schema) if schema else reader).json(root)
    if "config" not in rows.columns:
        return rows.limit(0)
    return rows.where("config is not null").withColumn("source", F.col("_metadata.file_path"))


def write_rows(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write as parquet, json (one object per line) or csv with a header; Spark's commit makes it all or nothing."""
    if form not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown format {form}")
    writer = df.write.mode("errorifexists")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def save_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], facts: dict) -> str:
    """Write tables below ``root`` with a manifest of file digests and a fingerprinted facts row; returns the fingerprint."""
    for name, df in tables.items():
        write_rows(df, f"{root}/{name}")
    files = _digests(spark, root, list(tables))
    write_rows(files, f"{root}/_files")
    described = {**{key: str(value) for key, value in facts.items()}, "files": _listing(files)}
    fingerprint = config_hash(described)
    row = [*sorted(described.items()), ("fingerprint", fingerprint)]
    write_rows(spark.createDataFrame(row, "key string, value string").coalesce(1), f"{root}/_facts")
    return fingerprint


def load_tables(spark: SparkSession, root: str, names: list[str], verify: bool = True) -> dict[str, DataFrame]:
    """Tables written by :func:`save_tables`; changed, missing or added files are an error when ``verify``."""
    if verify:
        read_facts(spark, root)
        stored = spark.read.parquet(f"{root}/_files")
        current = _digests(spark, root, names).withColumnRenamed("digest", "found")
        wanted = stored.where(F.substring_index("file", "/", 1).isin(*names))
        require_empty(wanted.join(current, "file", "full").where("not (digest <=> found)"), "stored file differs from its digest")
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def read_facts(spark: SparkSession, root: str) -> dict[str, str]:
    """Facts written by :func:`save_tables`, as text; an error if they or the list of files do not belong to the stored fingerprint."""
    rows = {r["key"]: r["value"] for r in spark.read.parquet(f"{root}/_facts").collect()}
    fingerprint = rows.pop("fingerprint", None)
    if config_hash(rows) != fingerprint or rows.get("files") != _listing(spark.read.parquet(f"{root}/_files")):
        raise ValueError("stored facts differ from their fingerprint")
    return rows


def _listing(files: DataFrame) -> str:
    return files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "file", "digest"))), ";"), 256).alias("d")).first()["d"]


def _digests(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(file, digest): roots of the digest trees of all stored files; a large file is hashed by many tasks."""
    out = None
    for name in names:
        rows = tree_digests(block_digests(spark, f"{root}/{name}", r"\.parquet$")).select(
            F.concat(F.lit(f"{name}/"), F.regexp_extract("path", "([^/]+)$", 1)).alias("file"), "digest")
        out = rows if out is None else out.unionByName(rows)
    return out
