"""Pair scores to class scores, predictions and gallery recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LSE_RULES, MatchConfig
from ..functions.vectors import dot, normalize, vector_dim, vector_means
from .blocks import join_blocks, pack, score_pairs, score_partials

EPISODE = ["seed", "scenario", "partition", "episode"]


def episode_pairs(members: DataFrame, fingerprints: DataFrame, config: MatchConfig, group=None,
                  query_fingerprints: DataFrame | None = None, max_side: int | None = None,
                  keep_mass: bool = False, gammas=None) -> DataFrame:
    """All query x support pairs of each episode.

    Members fetch their fingerprint once and are packed per episode, so the payload shuffled grows with Q + S rather
    than Q x S. ``query_fingerprints`` supplies another view (a truncated one) for the query side.
    """
    group = EPISODE if group is None else group
    tokens = config.alignment != "none"
    columns = ["session_id", "z"] + (["v", "r"] if tokens else [])
    support_prints = fingerprints.select(*columns)
    query_prints = (query_fingerprints if query_fingerprints is not None else fingerprints).select(*columns)
    queries = members.where("role = 'query'").select(*group, "session_id").join(query_prints, "session_id")
    supports = members.where("role = 'support'").select(*group, "session_id", "label").join(support_prints, "session_id")
    q = pack(queries, group, "session_id", config.block_rows, "q", expected=max_side, tokens=tokens)
    s = pack(supports, group, "session_id", config.block_rows, "s", label="label", expected=max_side, tokens=tokens)
    return score_pairs(join_blocks(q, s, group), group, config, keep_mass, gammas)


def compatibility(rule: str, config: MatchConfig) -> Column:
    """Evidence of one support before the softmax; the overlap term exists only for partial alignment."""
    value = F.lit(0.0)
    if rule in ("compatibility", "similarity"):
        value = value + F.lit(config.beta_similarity) * F.col("local")
    if rule in ("compatibility", "overlap") and config.alignment == "pma":
        value = value + F.lit(config.beta_overlap) * F.col("overlap")
    return value


def candidate_scores(pairs: DataFrame, config: MatchConfig, group=None, rule: str | None = None) -> DataFrame:
    """(group, query_id, label, candidate): one score per class from its supports (C11).

    The soft rules are ratios of two log-sum-exps, tau_s * (LSE(c/tau_c + s/tau_s) - LSE(c/tau_c)); their maxima are
    taken by a window over the same keys as the sums, so pairs shuffle once.
    """
    group = EPISODE if group is None else group
    rule = rule or config.aggregation
    keys = [*group, "query_id", "label"]
    if rule == "mean":
        return pairs.groupBy(*keys).agg(F.avg("score").alias("candidate"))
    if rule == "support_max":
        return pairs.groupBy(*keys).agg(F.max("score").alias("candidate"))
    if rule not in LSE_RULES:
        raise ValueError(f"rule {rule} is not a pair rule; use prototype_scores")
    evidence = compatibility(rule, config) / F.lit(config.tau_c)
    both = evidence + F.col("score") / F.lit(config.tau_s)
    window = Window.partitionBy(*keys)
    shifted = (pairs.select(*keys, evidence.alias("_c"), both.alias("_b"))
               .select(*keys, "_c", "_b", F.max("_c").over(window).alias("_mc"), F.max("_b").over(window).alias("_mb")))
    sums = shifted.groupBy(*keys).agg(F.first("_mc").alias("_mc"), F.first("_mb").alias("_mb"),
                                      F.sum(F.exp(F.col("_c") - F.col("_mc"))).alias("_sc"),
                                      F.sum(F.exp(F.col("_b") - F.col("_mb"))).alias("_sb"))
    value = F.lit(config.tau_s) * (F.col("_mb") + F.log("_sb") - F.col("_mc") - F.log("_sc"))
    return sums.select(*keys, value.alias("candidate"))


def responsibilities(pairs: DataFrame, config: MatchConfig, group=None, rule: str | None = None) -> DataFrame:
    """Pairs with ``omega``, the weight of each support in its class score."""
    group = EPISODE if group is None else group
    rule = rule or config.aggregation
    window = Window.partitionBy(*group, "query_id", "label")
    if rule == "mean":
        return pairs.withColumn("omega", F.lit(1.0) / F.count("*").over(window))
    if rule == "support_max":
        # The best score; of equal ones the support with the lowest id, whatever type ids have.
        topped = pairs.withColumn("_top", F.max("score").over(window))
        first = topped.withColumn("_first", F.min(F.when(F.col("score") == F.col("_top"), F.col("support_id"))).over(window))
        hit = F.col("support_id") == F.col("_first")
        return first.withColumn("omega", F.when(hit, 1.0).otherwise(0.0)).drop("_top", "_first")
    if rule not in LSE_RULES:
        raise ValueError(f"rule {rule} has no pair responsibilities")
    weight = (pairs.withColumn("_c", compatibility(rule, config) / F.lit(config.tau_c))
              .withColumn("_e", F.exp(F.col("_c") - F.max("_c").over(window))))
    return weight.withColumn("omega", F.col("_e") / F.sum("_e").over(window)).drop("_c", "_e")


def class_prototypes(supports: DataFrame, keys: list[str], dim: int | None = None) -> DataFrame:
    """L2-normalised mean of the support vectors per key."""
    dim = dim or vector_dim(supports, "z")
    means = vector_means(supports, keys, "z", dim, "mean_z")
    return means.select(*keys, "members", normalize("mean_z").alias("prototype"))


def prototype_scores(members: DataFrame, fingerprints: DataFrame, group=None, dim: int | None = None,
                     query_fingerprints: DataFrame | None = None) -> DataFrame:
    """(group, query_id, label, candidate) against class prototypes, skipping the pair matrix."""
    group = EPISODE if group is None else group
    z = fingerprints.select("session_id", "z")
    query_z = z if query_fingerprints is None else query_fingerprints.select("session_id", "z")
    supports = members.where("role = 'support'").select(*group, "label", "session_id").join(z, "session_id")
    prototypes = class_prototypes(supports, [*group, "label"], dim or vector_dim(fingerprints, "z"))
    queries = (members.where("role = 'query'").select(*group, F.col("session_id"))
               .join(query_z, "session_id").withColumnRenamed("session_id", "query_id"))
    joined = queries.join(prototypes, group)
    return joined.select(*group, "query_id", "label", dot("z", "prototype").alias("candidate"))


def predictions(candidates: DataFrame, group=None) -> DataFrame:
    """Best class per query, smallest label on ties, and its score as confidence."""
    group = EPISODE if group is None else group
    best = candidates.groupBy(*group, "query_id").agg(
        F.max(F.struct(F.col("candidate"), (-F.col("label")).alias("minus"))).alias("_b"))
    return best.select(*group, "query_id", (-F.col("_b.minus")).alias("prediction"),
                       F.col("_b.candidate").alias("confidence"))


def gallery_candidates(queries: DataFrame, gallery: DataFrame, config: MatchConfig, rule: str | None = None,
                       group: list[str] | None = None) -> DataFrame:
    """(group, query_id, label, candidate) of every query against a whole gallery.

    Gallery and queries are packed into blocks and meet block by block. The pairs of one (query, class, block) are
    reduced at once to a maximum and a shifted sum, and only those partial results are shuffled and merged. Gallery
    blocks are the larger ones: a query block is repeated once per gallery block when the gallery is too big to
    broadcast, so few large blocks keep that factor low.
    """
    group = group or []
    rule = rule or config.aggregation
    tokens = config.alignment != "none"
    if rule == "prototype":
        prototypes = class_prototypes(gallery, [*group, "label"])
        fake = prototypes.select(*group, F.col("label").alias("support_id"), "label", F.col("prototype").alias("z"))
        plain = MatchConfig(alignment="none", aggregation="support_max", block_rows=config.block_rows)
        q = pack(queries, group, "session_id", config.block_rows, "q", tokens=False)
        s = pack(fake, group, "support_id", config.gallery_rows, "s", label="label", tokens=False)
        pairs = score_pairs(join_blocks(q, s, group), group, plain)
        return pairs.select(*group, "query_id", "label", F.col("score").alias("candidate"))
    q = pack(queries, group, "session_id", config.block_rows, "q", tokens=tokens)
    s = pack(gallery, group, "session_id", config.gallery_rows, "s", label="label", tokens=tokens)
    return merge_partials(score_partials(join_blocks(q, s, group), group, config, rule), config, group, rule)


def merge_partials(partials: DataFrame, config: MatchConfig, group: list[str], rule: str) -> DataFrame:
    """Class scores from block-wise partial results; a query has one partial row per class and gallery block."""
    keys = [*group, "query_id", "label"]
    if rule == "mean":
        return partials.groupBy(*keys).agg((F.sum("total") / F.sum("rows")).alias("candidate"))
    if rule == "support_max":
        return partials.groupBy(*keys).agg(F.max("best").alias("candidate"))
    window = Window.partitionBy(*keys)
    shifted = partials.select(*keys, *[c for s in "cb" for c in (
        F.max(f"top_{s}").over(window).alias(f"m_{s}"),
        (F.col(f"sum_{s}") * F.exp(F.col(f"top_{s}") - F.max(f"top_{s}").over(window))).alias(f"x_{s}"))])
    merged = shifted.groupBy(*keys).agg(*[c for s in "cb" for c in (
        F.max(f"m_{s}").alias(f"m_{s}"), F.log(F.sum(f"x_{s}")).alias(f"l_{s}"))])
    value = F.lit(config.tau_s) * (F.col("m_b") + F.col("l_b") - F.col("m_c") - F.col("l_c"))
    return merged.select(*keys, value.alias("candidate"))


def enroll(traces: DataFrame, manifest: DataFrame) -> DataFrame:
    """Gallery rows (label_name, label, session_id, z, v, r): fingerprints joined to their manifest labels.

    Labels are numbered in name order over the distinct names, which are as few as the enrolled classes.
    """
    names = manifest.select("label_name").distinct()
    numbered = names.withColumn("label", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label_name")) - 1)
    return manifest.join(numbered, "label_name").join(traces, "session_id").select(
        "label_name", "label", "session_id", "z", "v", "r")


def recognize(queries: DataFrame, gallery: DataFrame, config: MatchConfig, threshold: float | None = None) -> DataFrame:
    """One row per query: label (null when rejected), rejected, confidence, scores per label name."""
    names = gallery.select("label", "label_name").distinct()
    # Best class and score map come from one aggregation, so the pairs are scored once.
    named = gallery_candidates(queries, gallery, config).join(names, "label")
    per_query = named.groupBy("query_id").agg(
        F.max(F.struct(F.col("candidate"), (-F.col("label")).alias("minus"), "label_name")).alias("best"),
        F.map_from_entries(F.collect_list(F.struct("label_name", "candidate"))).alias("scores"))
    confidence = F.col("best.candidate")
    rejected = F.lit(False) if threshold is None else confidence < F.lit(threshold)
    return per_query.select("query_id", F.when(~rejected, F.col("best.label_name")).alias("label"), rejected.alias("rejected"),
                            confidence.alias("confidence"), F.lit(threshold).cast("double").alias("threshold"), "scores")
