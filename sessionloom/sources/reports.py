"""Report files of any shape as VARIANT: parsed once, flattened path by path, keyed by a canonical form of their settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .lines import file_uri

#: Settings that do not make another configuration.
IGNORED = ("training.seed", "training.device", "training.threads")


def read_documents(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """(path, report VARIANT, problem): every file below ``root`` as one JSON document; ``problem`` is ``broken`` or ``no_config``, else null.

    A file without any text has no row.
    """
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    parsed = rows.select(file_uri("_metadata.file_path").alias("path"), F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("report"))
    has = F.try_variant_get("report", "$.config", "variant").isNotNull()
    return parsed.withColumn("problem", F.when(F.col("report").isNull(), "broken").when(~has, "no_config"))


def flatten(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, at, json): every scalar below the VARIANT ``value`` with its path, objects by ``.name`` and arrays by ``[n]``.

    One pass a level of nesting; empty objects and arrays are scalars. A name that holds a dot is told apart by quotes.
    """
    spark = rows.sparkSession
    level = rows.where(F.col(value).isNotNull()).select(key, F.lit("").alias("at"), F.col(value).alias("v"))
    leaves = None
    while True:
        kind = F.schema_of_variant("v")
        nested = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~F.to_json("v").isin("{}", "[]")
        level = level.withColumn("nested", nested)
        found = level.where(~F.col("nested")).select(key, "at", F.to_json("v").alias("json"))
        leaves = found if leaves is None else leaves.unionByName(found)
        inner = cut_lineage(level.where("nested").select(key, "at", "v"))
        if not inner.limit(1).collect():
            return leaves
        named = F.when(F.col("key").contains("."), F.concat(F.lit('"'), "key", F.lit('"'))).otherwise(F.col("key"))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(
            F.concat(F.when(F.col("at") == "", "").otherwise("."), named))
        level = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(key, F.concat("at", step).alias("at"), F.col("value").alias("v"))


def configuration_keys(rows: DataFrame, key: str, value: str, ignored=IGNORED) -> DataFrame:
    """(key, config_hash): SHA-256 of all settings in path order without the ignored ones; key order and spacing of the file do not matter."""
    kept = flatten(rows, key, value).where(~F.col("at").isin(*ignored))
    line = F.concat("at", F.lit("="), "json")
    return kept.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ";"), 256).alias("config_hash"))


def report_rows(documents: DataFrame) -> DataFrame:
    """(path, config_hash, seed, kind, alignment, scenario, fraction, accuracy) of usable documents; absent values are null."""
    good = cut_lineage(documents.where("problem is null").select("path", "report"))
    keys = configuration_keys(good.select("path", F.variant_get("report", "$.config", "variant").alias("config")), "path", "config")
    get = lambda at, kind: F.try_variant_get("report", at, kind)
    facts = good.select("path", get("$.config.training.seed", "bigint").alias("seed"), get("$.config.model.kind", "string").alias("kind"),
                        get("$.config.matching.alignment", "string").alias("alignment"), get("$.scenario", "string").alias("scenario"),
                        get("$.fraction", "double").alias("fraction"), get("$.accuracy", "double").alias("accuracy"))
    return facts.join(keys, "path")
