"""Corpus preparation: five stages from raw documents to a token file, each one operator applied to all that is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Stages tell
rows apart, not ids: a row whose doc_id is null or occurs again is judged for itself. Documents with null or empty text fail the
first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import decontamination, jaccard, mixing, quality_rules, tokens
from sessionloom.llm.queries import tokenizer_path
from sessionloom.llm.text import free_name, word_count
from sessionloom.runtime import cut_lineage, ensure_checkpoint_dir

#: The tokenizer in the last stage is no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and every rule of the threshold table."""
    verdict = free_name(docs, "_quality")
    return quality_rules.judge(docs, out=verdict).where(F.col(verdict)["kept"]).select(*docs.columns)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells all rows apart, and its name: doc_id where that is unique, else a number no doc_id has.

    Only rows with a null or repeated id are stored for that, as their new numbers must not change.
    """
    name = free_name(docs, "_row")
    often = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    facts = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    plain = docs.withColumn(name, F.col("doc_id").cast("bigint"))
    if not facts.nulls and not often.limit(1).collect():
        return plain, name
    often = cut_lineage(often)
    odd = docs.where("doc_id is null").unionByName(docs.join(often, "doc_id", "left_semi").select(*docs.columns))
    number = F.monotonically_increasing_id()
    above = (facts.high if facts.high is not None else 0) < 1 << 62
    fresh = number + F.lit((facts.high or 0) + 1) if above else F.lit((facts.low or 0) - 1) - number
    odd = cut_lineage(odd.withColumn(name, fresh))
    return plain.where("doc_id is not null").join(often, "doc_id", "left_anti").select(*plain.columns).unionByName(odd), name


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the shingle join: of the rows with a unique id the smallest, else any one row."""
    rows, key = keyed(docs)
    classes = jaccard.join_documents(rows, key=key).select(key, "component_id")
    return rows.join(classes.where(F.col(key) != F.col("component_id")).select(key), key, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    rows, key = keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontamination.find_leaks(rows, benchmark, key=key).select(key).distinct()
    return rows.join(leaks, key, "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, by the source weights over what is left."""
    rows, key = keyed(docs)
    copies = free_name(rows, "_copies")
    mixed = mixing.mix(rows, word_count(F.col("text")), key=key).select(key, F.col("copies").alias(copies)).where(F.col(copies) > 0)
    return rows.join(mixed, key).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of what is left, read back: (doc_id, start, n_tokens, ids_crc32)."""
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write(docs, path, tokenizer_path())
    return tokens.read(spark, path).withColumnRenamed("key", "doc_id")


STAGES = [("quality_rules", quality_stage), ("ngram_jaccard_join", near_duplicate_stage), ("benchmark_decontamination", decontamination_stage),
          ("source_mixing", mixing_stage), ("token_output", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what lies between them is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}_{name}")
            docs = spark.read.parquet(f"{folder}/{number}_{name}")
    return docs
