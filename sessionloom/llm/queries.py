"""The registered queries of this subpackage: each applies one operator to its whole table and returns the contract's columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ensure_checkpoint_dir
from . import decontamination, dialogues, hard_negatives, jaccard, licenses, mixing, oracle, pu_quality, quality_rules, sharding, simhash, tokens, toxicity, urls
from .text import word_count

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]
REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Adds a query under ``name``; ``sql`` is its DuckDB counterpart, None where SQL cannot express it."""
    def keep(function):
        REGISTRY[name] = (function, sql)
        return function
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_pareto_mix", oracle.PARETO_MIX)
def pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from every document when the sources are mixed by weight."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register("op2_benchmark_leaks")
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its place and edits."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


@register("op4_licenses")
def license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that holds a licence, with its family."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op5_token_file")
def token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document, read back from a token file in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokens.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens.read(spark, path).withColumnRenamed("key", "doc_id")


@register("op6_toxicity")
def judge_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows held out are never learned from."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.in_test(F.col("doc_id"), 5, 0)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.in_test(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op8_pu_quality")
def judge_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows held out are never learned from."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    learn = ~toxicity.in_test(F.col("doc_id"), 4, 2)
    model = pu_quality.train(docs, labels.where(learn & (F.col("quality") == 1)), usable=learn)
    scored = docs.select("doc_id", toxicity.in_test(F.col("doc_id"), 4, 2).alias("held_out"), pu_quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@register("op7_quality_rules", oracle.QUALITY_RULES)
def judge_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the rule table for every document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), out="q")
    return judged.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                         "base_failed", "kept")])


@register("op9_virtual_slots")
def virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document, by the slot map stored in the shared folder; the law is `bytes`."""
    path = f"{ensure_checkpoint_dir(spark)}/slots-{uuid.uuid4().hex}"
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24, path=path)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@register("op10_url_vocabulary", oracle.URL_VOCABULARY)
def url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@register("op11_hard_negatives", oracle.HARD_NEGATIVES)
def mine_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh row gets the next label first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


@register("op12_simhash")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with the contract's damage: by a checksum of its place a turn is dropped, emptied, cut, repeated or given to the user."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    told = conversations.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(place) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return told.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@register("op13_dialogue_repair", oracle.DIALOGUE_REPAIR)
def repair_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns of every conversation after damage."""
    conversations = table(spark, sf_dir, "conversations")
    return dialogues.repair(damage(conversations), ids=conversations).summaries()
