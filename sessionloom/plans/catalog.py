"""Registered queries: name -> (function of (spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..runtime import cut_lineage, ensure_checkpoint_dir
from ..streaming import bins as streaming
from ..operators import features, matching, metrics, sampling
from ..operators.sampling import EpisodePart, scenario_catalogue
from . import oracle as sql
from ..functions import hashing, udtf
from ..sources import digests, reports, tracefiles
from . import logs, tables
from .tables import EVENT_DATA

REGISTRY: dict[str, tuple] = {}
SEED = 20260817
SEEDS3 = (20260814, 20260815, 20260816)
RANDOM_MIXED = [p for p in scenario_catalogue("shaped") if p.scenario == "random_mixed"]
CROSS_MODE = [p for p in scenario_catalogue("shaped") if p.scenario == "cross_mode"]
EPISODE = matching.EPISODE
EP = "seed, scenario, partition, episode"


def r6(column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def register(name: str, oracle: str | None = None):
    def add(function):
        REGISTRY[name] = (function, oracle)
        return function
    return add


def with_clause(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts)


# --- episodes and prototypes -------------------------------------------------------------------------------------

ALL_SCENARIOS = scenario_catalogue("shaped")


@register("episode_members", with_clause(sql.VECTORS, sql.members(ALL_SCENARIOS, [SEED])) + f"""
SELECT seed::BIGINT AS seed, scenario, partition, episode::BIGINT AS episode, role, identity, label::BIGINT AS label,
       session_id FROM mem""")
def episode_members(spark, sf_dir) -> DataFrame:
    """Every scenario of the catalogue over the embeddings."""
    rows = sampling.episode_members(tables.vector_sessions(spark, sf_dir), ALL_SCENARIOS, (SEED,), strict=False)
    return rows.select(F.col("seed").cast("bigint"), "scenario", "partition", F.col("episode").cast("bigint"), "role",
                       "identity", F.col("label").cast("bigint"), "session_id")


def drawn(spark, sf_dir, parts, seeds=(SEED,)) -> DataFrame:
    """Episode rows of the embeddings, materialised: they are few, used several times and costly to redraw."""
    return cut_lineage(sampling.episode_members(tables.vector_sessions(spark, sf_dir), parts, seeds, strict=False))


def mixed_members(spark, sf_dir, seeds=(SEED,)):
    return drawn(spark, sf_dir, RANDOM_MIXED, seeds)


@register("prototype_scores", with_clause(sql.VECTORS, sql.members(RANDOM_MIXED, [SEED]), sql.PROTOTYPES) + f"""
SELECT seed::BIGINT AS seed, scenario, partition, episode::BIGINT AS episode, query_id, label::BIGINT AS label,
       {sql.rounded('candidate', 'candidate')} FROM cand""")
def prototype_scores(spark, sf_dir) -> DataFrame:
    """Queries against L2-normalised class means."""
    vec = tables.vectors(spark, sf_dir)
    scores = matching.prototype_scores(mixed_members(spark, sf_dir), vec, dim=64)
    return scores.select(F.col("seed").cast("bigint"), "scenario", "partition", F.col("episode").cast("bigint"),
                         "query_id", F.col("label").cast("bigint"), r6("candidate").alias("candidate"))


@register("episode_accuracy", with_clause(sql.VECTORS, sql.members(RANDOM_MIXED, [SEED]), sql.PROTOTYPES, sql.PREDICT) + f"""
SELECT scenario, count(*) AS episodes, {sql.rounded('avg(accuracy)', 'accuracy')},
       {sql.rounded('coalesce(stddev_samp(accuracy), 0)', 'episode_std')},
       {sql.rounded('coalesce(stddev_samp(accuracy), 0) / sqrt(count(*))', 'episode_sem')} FROM acc GROUP BY scenario""")
def episode_accuracy(spark, sf_dir) -> DataFrame:
    """Flagship; prediction by prototypes and accuracy over episodes."""
    members = mixed_members(spark, sf_dir)
    scores = matching.prototype_scores(members, tables.vectors(spark, sf_dir), dim=64)
    per_episode = metrics.episode_accuracy(matching.predictions(scores), members)
    out = metrics.accuracy_summary(per_episode, ["scenario"])
    return out.select("scenario", "episodes", *[r6(c).alias(c) for c in ("accuracy", "episode_std", "episode_sem")])


# --- trace features ----------------------------------------------------------------------------------------------

HELD_OUT = "bw4"
HALF = EVENT_DATA.window / 2
FEATURE_BASE = with_clause(sql.PACKETS, sql.SESSIONS, sql.split_ctes(SEED), sql.grid_ctes())


def training_sessions(spark, sf_dir):
    sessions = cut_lineage(tables.event_sessions(spark, sf_dir))
    split = sampling.identity_split(sessions, SEED)
    return sessions.join(split.where("split = 'train'"), "identity", "left_semi").where(F.col("condition") != HELD_OUT)


def event_stats(spark, sf_dir):
    """Fifteen rows from a full pass over the training packets, so they are materialised before reuse."""
    return cut_lineage(features.norm_stats(tables.packets(spark, sf_dir), training_sessions(spark, sf_dir), EVENT_DATA))


@register("bin_features", FEATURE_BASE + """
SELECT session_id, scale, bin, round(c0, 6) + 0.0 AS c0, round(c1, 6) + 0.0 AS c1, c2, c3, round(c4, 6) + 0.0 AS c4, mask FROM dense""")
def bin_features(spark, sf_dir) -> DataFrame:
    """Dense multi-scale bins of every session."""
    dense = features.bin_features(tables.packets(spark, sf_dir), EVENT_DATA)
    return dense.select("session_id", "scale", "bin", r6("c0").alias("c0"), r6("c1").alias("c1"), "c2", "c3",
                        r6("c4").alias("c4"), "mask")


@register("observation_mask", with_clause(sql.PACKETS, sql.grid_ctes()) + """
, horizon AS (SELECT session_id, max(t) AS until FROM pk GROUP BY ALL)
SELECT session_id, scale, sum(CASE WHEN (bin + 0.5) * scale / 1000 <= until THEN 1 ELSE 0 END)::BIGINT AS observed,
       count(*) AS bins FROM dense JOIN horizon USING (session_id) GROUP BY ALL""")
def observation_mask(spark, sf_dir) -> DataFrame:
    """Bins observed up to each session's last packet."""
    last = tables.packets(spark, sf_dir).groupBy("session_id").agg(F.max("t").alias("until"))
    mask = features.observation_mask(EVENT_DATA, last, F.col("until"))
    return mask.groupBy("session_id", "scale").agg(F.sum("mask").alias("observed"), F.count("*").alias("bins"))


@register("norm_stats", FEATURE_BASE + ", " + sql.STATS + """
SELECT scale, channel::INT AS channel, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std FROM stats""")
def norm_stats(spark, sf_dir) -> DataFrame:
    """Moments over observed bins of training sessions without the held-out condition."""
    return event_stats(spark, sf_dir).select("scale", "channel", r6("mean").alias("mean"), r6("std").alias("std"))


@register("normalized_bins", FEATURE_BASE + ", " + ", ".join([sql.STATS, sql.norm_ctes()]) + """
SELECT session_id, scale, bin, channel::INT AS channel, round(x, 6) + 0.0 AS x, mask FROM norm""")
def normalized_bins(spark, sf_dir) -> DataFrame:
    """Z-scored log1p bins."""
    dense = features.bin_features(tables.packets(spark, sf_dir), EVENT_DATA)
    wide = features.normalized_bins(dense, event_stats(spark, sf_dir))
    return wide.select("session_id", "scale", "bin", "mask", F.posexplode(F.array(*[f"x{i}" for i in range(5)]))
                       .alias("channel", "x")).withColumn("x", r6("x"))


@register("token_pool", FEATURE_BASE + ", " + ", ".join([sql.STATS, sql.norm_ctes(), sql.token_ctes()]) + """
SELECT session_id, scale, token, channel::INT AS channel, round(x, 6) + 0.0 AS x, round(r, 6) + 0.0 AS r FROM tok""")
def token_pool(spark, sf_dir) -> DataFrame:
    """adaptive mean pooling of bins and masks."""
    dense = features.bin_features(tables.packets(spark, sf_dir), EVENT_DATA)
    pooled = features.token_pool(features.normalized_bins(dense, event_stats(spark, sf_dir)), EVENT_DATA)
    return pooled.select("session_id", "scale", "token", r6("r").alias("r"),
                         F.posexplode(F.array(*[f"x{i}" for i in range(5)])).alias("channel", "x")).withColumn("x", r6("x"))


def fingerprint_rows(prints: DataFrame) -> DataFrame:
    """z as part 'z' and each token of v as part 'v<token>', one number per row."""
    cell = "named_struct('token', {0}, 'i', i, 'x', x)"
    z = f"transform(z, (x, i) -> {cell.format('-1')})"
    v = f"flatten(transform(v, (p, t) -> transform(p, (x, i) -> {cell.format('t')})))"
    return prints.selectExpr("session_id", f"inline(concat({z}, {v}))").withColumn("x", r6("x"))


FINGERPRINT_SQL = """
SELECT session_id, token::INT AS token, i::INT AS i, round(x, 6) + 0.0 AS x FROM (
  SELECT session_id, -1 AS token, unnest(range(len(z))) AS i, unnest(z) AS x FROM fp{0}
  UNION ALL SELECT session_id, token, unnest(range(len(p))), unnest(p) FROM (
    SELECT session_id, unnest(range(len(v))) AS token, unnest(v) AS p FROM fp{0}))"""


@register("session_fingerprint", FEATURE_BASE + ", " + ", ".join(
    [sql.STATS, sql.norm_ctes(), sql.token_ctes(), sql.print_ctes()]) + FINGERPRINT_SQL.format(""))
def session_fingerprint(spark, sf_dir) -> DataFrame:
    """Full-window fingerprints of every session."""
    return fingerprint_rows(features.fingerprints(tables.packets(spark, sf_dir), event_stats(spark, sf_dir), EVENT_DATA))


@register("session_fingerprint_prefix", FEATURE_BASE + ", " + ", ".join(
    [sql.STATS, sql.grid_ctes(HALF, 86_400.0, "_p"), sql.norm_ctes("_p"), sql.token_ctes("_p"), sql.print_ctes("_p")])
    + FINGERPRINT_SQL.format("_p"))
def session_fingerprint_prefix(spark, sf_dir) -> DataFrame:
    """half of the window observed, starting one day into the session."""
    prints = features.fingerprints(tables.packets(spark, sf_dir), event_stats(spark, sf_dir), EVENT_DATA, until=HALF, start=86_400.0)
    return fingerprint_rows(prints)


# --- pair matching -----------------------------------------------------------------------------------------------

CROSS_SQL = [sql.VECTORS, sql.members(CROSS_MODE, [SEED])]
MAX_SIDE = max(p.ways * max(p.shots, p.queries) for p in ALL_SCENARIOS)
HOLE_LIST = "list_transform(range(8), lambda i: CASE WHEN {0}.session_id % 8 = i THEN 0.0 ELSE 1.0 END)"
COMPACT = ("compact AS (SELECT * REPLACE (list_filter(qv, lambda x, i: qr[i] > 0) AS qv, "
           "list_filter(sv, lambda x, i: sr[i] > 0) AS sv) FROM pr)")


def pair_sql(*ctes, source, columns=("local", "overlap", "score")):
    return with_clause(*CROSS_SQL, *ctes) + f"""
SELECT {sql.PAIR_KEYS}, support_id, label::BIGINT AS label, {', '.join(sql.rounded(c, c) for c in columns)} FROM {source}"""


def cross_pairs(spark, sf_dir, alignment, holes=False, **extra):
    vec = tables.vectors(spark, sf_dir)
    if holes:
        vec = vec.withColumn("r", F.col("r_holes"))
    members = drawn(spark, sf_dir, CROSS_MODE)
    return matching.episode_pairs(members, vec, MatchConfig(alignment=alignment), max_side=MAX_SIDE, **extra)


def pair_rows(pairs, columns=("local", "overlap", "score")):
    return pairs.select(F.col("seed").cast("bigint"), "scenario", "partition", F.col("episode").cast("bigint"), "query_id",
                        "support_id", "label", *[r6(c).alias(c) for c in columns])


@register("pair_global", pair_sql(sql.pairs_cte(), source="(SELECT *, g AS score FROM pr)", columns=("score",)))
def pair_global(spark, sf_dir) -> DataFrame:
    """Global similarity only; token arrays never leave the scan."""
    return pair_rows(cross_pairs(spark, sf_dir, "none"), ("score",))


DIAGONAL = ("dg AS (SELECT *, list_sum(list_transform(range(1, 9), lambda i: list_dot_product(qv[i], sv[i]))) / (8 + 1e-8) AS local, "
            "0.5 * g + 0.5 * list_sum(list_transform(range(1, 9), lambda i: list_dot_product(qv[i], sv[i]))) / (8 + 1e-8) AS score FROM pr)")


@register("pair_diagonal", pair_sql(sql.pairs_cte(), DIAGONAL, source="dg", columns=("local", "score")))
def pair_diagonal(spark, sf_dir) -> DataFrame:
    """token i against token i."""
    return pair_rows(cross_pairs(spark, sf_dir, "diagonal"), ("local", "score"))


@register("pair_pma", pair_sql(sql.pairs_cte(), sql.pma_ctes(8, 8), source="pma"))
def pair_pma(spark, sf_dir) -> DataFrame:
    """partial monotone alignment of 8 x 8 tokens."""
    return pair_rows(cross_pairs(spark, sf_dir, "pma"))


@register("pair_pma_holes", pair_sql(sql.pairs_cte(r=HOLE_LIST), sql.pma_ctes(8, 8, holes=True), source="pma"))
def pair_pma_holes(spark, sf_dir) -> DataFrame:
    """F3 with an unobserved token per fingerprint."""
    return pair_rows(cross_pairs(spark, sf_dir, "pma", holes=True))


@register("pair_softdtw", pair_sql(sql.pairs_cte(), sql.soft_dtw_ctes(8, 8), source="sdtw", columns=("local", "score")))
def pair_softdtw(spark, sf_dir) -> DataFrame:
    """soft-DTW occupancy."""
    return pair_rows(cross_pairs(spark, sf_dir, "soft_dtw"), ("local", "score"))


@register("pair_softdtw_holes", pair_sql(sql.pairs_cte(r=HOLE_LIST), COMPACT, sql.soft_dtw_ctes(7, 7, source="compact"),
                                         source="sdtw", columns=("local", "score")))
def pair_softdtw_holes(spark, sf_dir) -> DataFrame:
    """F4 on the valid tokens only."""
    return pair_rows(cross_pairs(spark, sf_dir, "soft_dtw", holes=True), ("local", "score"))


def candidate_rows(scores):
    return scores.select(F.col("seed").cast("bigint"), "scenario", "partition", F.col("episode").cast("bigint"), "query_id",
                         F.col("label").cast("bigint"), r6("candidate").alias("candidate"))


def _register_rule(rule):
    text = with_clause(*CROSS_SQL, sql.pairs_cte(), sql.pma_ctes(8, 8), sql.class_scores(rule)) + f"""
SELECT {sql.PAIR_KEYS}, label::BIGINT AS label, {sql.rounded('candidate', 'candidate')} FROM cand"""

    @register(f"support_agg_{rule}", text)
    def run(spark, sf_dir) -> DataFrame:
        return candidate_rows(matching.candidate_scores(cross_pairs(spark, sf_dir, "pma"), MatchConfig(), rule=rule))

    run.__doc__ = f"C11: class scores from pair scores by the {rule} rule."


for _rule in ("mean", "support_max", "uniform_lse", "similarity", "overlap", "compatibility"):
    _register_rule(_rule)


@register("responsibility", with_clause(*CROSS_SQL, sql.pairs_cte(), sql.pma_ctes(8, 8), sql.class_scores("compatibility")) + f"""
SELECT {sql.PAIR_KEYS}, support_id, label::BIGINT AS label, {sql.rounded('omega', 'omega')} FROM cw""")
def responsibility(spark, sf_dir) -> DataFrame:
    """Weight of each support in its class score."""
    rows = matching.responsibilities(cross_pairs(spark, sf_dir, "pma"), MatchConfig())
    return pair_rows(rows, ("omega",))


@register("responsibility_max", with_clause(*CROSS_SQL, sql.pairs_cte(), sql.pma_ctes(8, 8)) + f"""
, pick AS (SELECT *, row_number() OVER (PARTITION BY {EP}, query_id, label ORDER BY score DESC, support_id) AS rn FROM pma)
SELECT {sql.PAIR_KEYS}, support_id, label::BIGINT AS label, CASE WHEN rn = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS omega FROM pick""")
def responsibility_max(spark, sf_dir) -> DataFrame:
    """One-hot weight of the best support."""
    rows = matching.responsibilities(cross_pairs(spark, sf_dir, "pma"), MatchConfig(), rule="support_max")
    return pair_rows(rows, ("omega",))


# --- players, modes ------------------------------------------------------------------------------------------------

from ..operators import audit, dedup, modes, players  # noqa: E402
from .tables import FRONTIER_GAP, FRONTIER_TARGETS, INITIAL_GAP, STEP  # noqa: E402


def quality_samples(spark, sf_dir, initial):
    series = tables.player_series(spark, sf_dir).select("session_id", "t", "seq", "quality").where("quality is not null")
    return players.sample_steps(series, tables.event_sessions(spark, sf_dir), {"quality": initial}, STEP, 30, INITIAL_GAP)


@register("step_sample", with_clause(sql.EVENT_ROWS, sql.SERIES, sql.samples_cte("quality", "0", "smp")) + """
SELECT session_id, k::INT AS k, round(x, 6) + 0.0 AS quality FROM smp""")
def step_sample(spark, sf_dir) -> DataFrame:
    """As-of samples with a constant before the first observation."""
    samples, _ = quality_samples(spark, sf_dir, 0.0)
    return samples.select("session_id", "k", r6("quality").alias("quality"))


@register("step_sample_backfill", with_clause(sql.EVENT_ROWS, sql.SERIES, sql.SESSIONS, sql.samples_cte("quality", "x0", "smp")) + f"""
SELECT session_id, k::INT AS k, round(x, 6) + 0.0 AS quality, NULL AS reason FROM smp WHERE t0 - {STEP / 2} <= {INITIAL_GAP}
UNION ALL SELECT session_id, -1, NULL, 'missing_player_observations' FROM sess
WHERE session_id NOT IN (SELECT session_id FROM smp WHERE t0 - {STEP / 2} <= {INITIAL_GAP})""")
def step_sample_backfill(spark, sf_dir) -> DataFrame:
    """First value used before the first observation, late starters refused."""
    samples, rejected = quality_samples(spark, sf_dir, None)
    kept = samples.select("session_id", "k", r6("quality").alias("quality"), F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(rejected.select("session_id", F.lit(-1).alias("k"), F.lit(None).cast("double").alias("quality"), "reason"))


@register("mode_features_a", with_clause(sql.EVENT_ROWS, sql.SERIES, sql.samples_cte("quality", "x0", "smp"), sql.MODES_A) + """
SELECT session_id, k::INT AS i, round(q, 6) + 0.0 AS x FROM lq
UNION ALL SELECT session_id, unnest(range(30, 37))::INT, round(unnest([f30, f31, f32, f33, f34, f35, f36]), 6) + 0.0 FROM ma JOIN mb USING (session_id)""")
def mode_features_a(spark, sf_dir) -> DataFrame:
    """30 log samples and seven summaries."""
    samples, _ = quality_samples(spark, sf_dir, None)
    rows = players.bitrate_mode_features(samples)
    return rows.select("session_id", F.posexplode("mode_features").alias("i", "x")).withColumn("x", r6("x"))


def playback_samples(spark, sf_dir):
    initial = {"quality": 0.0, "buffer": 0.0, "stalled": 1.0, "state": 1.0}
    return players.sample_steps(tables.player_series(spark, sf_dir), tables.event_sessions(spark, sf_dir), initial, STEP, 30)


@register("mode_features_b", with_clause(sql.EVENT_ROWS, sql.SERIES, sql.samples_cte("quality", "0", "sq"), sql.samples_cte("buffer", "0", "sb"),
                                         sql.samples_cte("stalled", "1", "ss"), sql.samples_cte("state", "1", "sp")) + """
, j AS (SELECT session_id, k, sq.x AS q, sb.x AS b, ss.x AS s, sp.x AS p, lag(sq.x) OVER (PARTITION BY session_id ORDER BY k) AS before
        FROM sq JOIN sb USING (session_id, k) JOIN ss USING (session_id, k) JOIN sp USING (session_id, k)),
f AS (SELECT session_id, [avg(s), avg((b < 1)::INT), median(b), avg(b) FILTER (k >= 25), avg(p), avg((q <= 360)::INT), avg(ln(1 + q)),
                          avg((q <> before)::INT)] AS x FROM j GROUP BY ALL)
SELECT session_id, unnest(range(8))::INT AS i, round(unnest(x), 6) + 0.0 AS x FROM f""")
def mode_features_b(spark, sf_dir) -> DataFrame:
    """Eight playback shares and averages."""
    samples, _ = playback_samples(spark, sf_dir)
    rows = players.playback_mode_features(samples)
    return rows.select("session_id", F.posexplode("mode_features").alias("i", "x")).withColumn("x", r6("x"))


PLAYBACK_FEATURES = (sql.EVENT_ROWS, sql.SERIES, sql.samples_cte("quality", "0", "sq"), sql.samples_cte("buffer", "0", "sb"),
                     sql.samples_cte("stalled", "1", "ss"), sql.samples_cte("state", "1", "sp"), sql.MODES_B, sql.SESSIONS, sql.split_ctes(SEED))


@register("kmeans_modes", with_clause(*PLAYBACK_FEATURES, sql.kmeans_ctes([3], 20260816, 8, HELD_OUT)).replace("WITH", "WITH RECURSIVE", 1) + """
, cen AS (SELECT generate_subscripts(centres, 1) AS c, unnest(centres) AS z FROM best),
raw AS (SELECT c, z[1] * s1 + m1 + z[2] * s2 + m2 AS stalled, z[7] * s7 + m7 + 0.02 * (z[3] * s3 + m3) - (z[8] * s8 + m8) AS delivery FROM cen, mom),
one AS (SELECT *, row_number() OVER (ORDER BY stalled DESC, c) = 1 AS starved FROM raw),
two AS (SELECT *, row_number() OVER (ORDER BY starved, delivery DESC, c) AS place FROM one),
named AS (SELECT c, CASE WHEN starved THEN 'S' WHEN place = 1 THEN 'H' ELSE 'T' END AS mode FROM two),
near AS (SELECT session_id, list_position(d, list_min(d)) AS c
         FROM (SELECT session_id, list_transform(centres, lambda m: list_distance(m, x)) AS d FROM std, best))
SELECT session_id, mode FROM near JOIN named USING (c)""")
def kmeans_modes(spark, sf_dir) -> DataFrame:
    """Modes from clusters fitted on training sessions by seeded k-means, best of 20 restarts."""
    samples, _ = playback_samples(spark, sf_dir)
    rows = players.playback_mode_features(samples)
    predicted, _ = modes.fit_modes(rows, training_sessions(spark, sf_dir), "playback", seed=20260816)
    return predicted.select("session_id", "mode")


@register("silhouette_by_k", with_clause(*PLAYBACK_FEATURES, sql.kmeans_ctes(range(2, 11), 20260814, 8, HELD_OUT)).replace("WITH", "WITH RECURSIVE", 1) + """
, lab AS (SELECT k, session_id, x, list_position(d, list_min(d)) AS c
          FROM (SELECT k, session_id, x, list_transform(centres, lambda m: list_distance(m, x)) AS d FROM pts, best)),
gap AS (SELECT a.session_id, a.k, a.c AS own, b.c AS other, sum(list_distance(a.x, b.x)) AS total, count(*) AS n
        FROM lab a JOIN lab b USING (k) GROUP BY ALL),
ab AS (SELECT k, session_id, own, max(n) FILTER (own = other) AS size, max(total) FILTER (own = other) AS within,
              min(total / n) FILTER (own <> other) AS b FROM gap GROUP BY ALL),
sil AS (SELECT k, avg(CASE WHEN size > 1 THEN (b - within / (size - 1)) / greatest(b, within / (size - 1)) ELSE 0 END) AS s
        FROM ab GROUP BY k HAVING count(DISTINCT own) = k)
SELECT k, round(s, 6) + 0.0 AS silhouette, row_number() OVER (ORDER BY round(s, 9) DESC, k) = 1 AS best FROM sil""")
def silhouette_by_k(spark, sf_dir) -> DataFrame:
    """Silhouette of the training sessions' clusters for K from 2 to 10, the best K marked."""
    samples, _ = playback_samples(spark, sf_dir)
    rows = players.playback_mode_features(samples)
    return modes.silhouette_by_k(rows, training_sessions(spark, sf_dir)).select("k", r6("silhouette").alias("silhouette"), "best")


@register("silhouette", with_clause(sql.VECTORS) + """
, pairs AS (SELECT a.session_id, a.identity AS own, b.identity AS other, sum(list_distance(a.z, b.z)) AS total, count(*) AS n
            FROM vec a, vec b GROUP BY ALL),
ab AS (SELECT session_id, max(n) FILTER (own = other) AS size, max(total) FILTER (own = other) AS within,
              min(total / n) FILTER (own <> other) AS b FROM pairs GROUP BY ALL)
SELECT round(avg(CASE WHEN size > 1 THEN (b - within / (size - 1)) / greatest(b, within / (size - 1)) ELSE 0 END), 6) + 0.0 AS silhouette,
       count(*) AS rows FROM ab""")
def silhouette(spark, sf_dir) -> DataFrame:
    """Euclidean silhouette of the label clusters."""
    points = tables.vectors(spark, sf_dir).select("session_id", F.col("identity").alias("cluster"), F.col("z").alias("x"))
    return modes.silhouette(points).select(r6("silhouette").alias("silhouette"), "rows")


@register("delivery_frontier", with_clause(sql.EVENT_ROWS, sql.SESSIONS, sql.FRONTIER) + """
SELECT session_id, k::INT AS k, round(max(raw) OVER (PARTITION BY session_id ORDER BY k), 6) + 0.0 AS frontier, NULL AS reason
FROM chk JOIN verdict USING (session_id) WHERE reason IS NULL
UNION ALL SELECT session_id, -1, NULL, reason FROM verdict WHERE reason IS NOT NULL
UNION ALL SELECT session_id, -1, NULL, 'insufficient_dynamics' FROM fs WHERE NOT (nr >= 2 AND nb >= 2 AND ns >= 1)""")
def delivery_frontier(spark, sf_dir) -> DataFrame:
    """Running playback integral plus as-of buffer, with refusals."""
    logs = tables.playback_logs(spark, sf_dir)
    result = players.delivery_frontier(logs["sessions"], logs["states"], logs["rates"], logs["buffers"], FRONTIER_TARGETS,
                                       FRONTIER_GAP, bucket=86_400.0)
    return result.select("session_id", "reason", F.posexplode_outer("frontier").alias("k", "x")).select(
        "session_id", F.coalesce("k", F.lit(-1)).alias("k"), r6("x").alias("frontier"), "reason")


# --- duplicates, splits, partitions, audit -------------------------------------------------------------------------

DOC_KEYS = r"""
dk AS (SELECT doc_id, source, lang, sha256(text) AS exact, sha256(lower(regexp_replace(text, '[^\p{L}]+', ' ', 'g'))) AS near FROM documents),
dg AS (SELECT near, min(doc_id) AS component, min(source) <> max(source) AS conflict FROM dk GROUP BY ALL),
marked AS (SELECT doc_id, source, lang, component, CASE WHEN conflict THEN 'conflicting_duplicate' WHEN doc_id <> component THEN 'duplicate' END AS r0
           FROM dk JOIN dg USING (near)),
kept AS (SELECT source, count(*) AS n FROM marked WHERE r0 IS NULL GROUP BY ALL),
final AS (SELECT marked.*, CASE WHEN r0 IS NULL AND n < 11 THEN 'identity_below_minimum_sessions' ELSE r0 END AS reason
          FROM marked LEFT JOIN kept USING (source))"""


def marked_documents(spark, sf_dir):
    return dedup.minimum_sessions(dedup.duplicate_groups(tables.document_keys(spark, sf_dir)), 11)


@register("dup_groups", with_clause(DOC_KEYS) + " SELECT doc_id AS session_id, component, reason FROM final")
def dup_groups(spark, sf_dir) -> DataFrame:
    """Duplicate components over exact and near keys, conflicts and small identities dropped."""
    return marked_documents(spark, sf_dir).select("session_id", "component", "reason")


@register("cohort_inventory", with_clause(DOC_KEYS) + """
SELECT 'identity' AS kind, source AS key, count(*) AS sessions FROM final WHERE reason IS NULL GROUP BY ALL
UNION ALL SELECT 'condition', lang, count(*) FROM final WHERE reason IS NULL GROUP BY ALL
UNION ALL SELECT 'reason', reason, count(*) FROM final WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'total', 'discovered', count(*) FROM final""")
def cohort_inventory(spark, sf_dir) -> DataFrame:
    """Counts of kept and dropped rows."""
    return dedup.cohort_inventory(marked_documents(spark, sf_dir))


@register("trace_signature", with_clause(sql.PACKETS) + """
, part AS (SELECT session_id, round_even(t / 60, 0)::BIGINT // 144 AS slice,
                  sha256(string_agg(round_even(t / 60, 0)::BIGINT || ',' || direction || ',' || round_even(length, 0)::BIGINT, ';' ORDER BY t, seq)) AS digest
           FROM pk GROUP BY ALL)
SELECT session_id, sha256(string_agg(slice || ':' || digest, ';' ORDER BY slice)) AS signature FROM part GROUP BY ALL""")
def trace_signature(spark, sf_dir) -> DataFrame:
    """Sliced trace digests at one-minute ticks."""
    return dedup.trace_signature(tables.packets(spark, sf_dir), 60.0, "signature", EVENT_DATA.window, slices=60)


@register("identity_split", with_clause(sql.EVENT_ROWS, sql.SESSIONS, sql.split_ctes(SEED)) + " SELECT identity, split FROM split")
def identity_split(spark, sf_dir) -> DataFrame:
    """Seeded identity-disjoint split of the users."""
    return sampling.identity_split(tables.event_sessions(spark, sf_dir), SEED)


@register("open_partitions", with_clause(sql.VECTORS) + f"""
, grid AS (SELECT identity, p AS partition, n, row_number() OVER (PARTITION BY p ORDER BY sha256('{SEED}|open|' || p || '|' || identity)) - 1 AS place
           FROM (SELECT identity, p, count(*) AS n FROM vec, (SELECT unnest(range(5)) AS p) GROUP BY ALL)),
lab AS (SELECT *, place < 5 AS known, CASE WHEN place < 5 THEN row_number() OVER (PARTITION BY partition, place < 5 ORDER BY identity) - 1 ELSE -1 END AS label,
               '{SEED}|gallery|' || partition || '|' || identity AS key FROM grid),
draw AS (SELECT *, CASE WHEN known THEN {sql.draws('n', '5', 'key')} ELSE []::BIGINT[] END AS places FROM lab),
ranked AS (SELECT session_id, identity, row_number() OVER (PARTITION BY identity ORDER BY sha256(session_id::VARCHAR)) - 1 AS place FROM vec)
SELECT partition::INT AS partition, identity, known, CASE WHEN list_contains(places, ranked.place) THEN 'support' ELSE 'query' END AS role,
       label::INT AS label, session_id FROM ranked JOIN draw USING (identity)""")
def open_partitions(spark, sf_dir) -> DataFrame:
    """Five known/unknown partitions with gallery rows."""
    return sampling.open_partitions(tables.vector_sessions(spark, sf_dir), 5, 5, 5, SEED)


@register("audit_violations", with_clause(sql.EVENT_ROWS, DOC_KEYS, sql.VECTORS, sql.members(CROSS_MODE, [SEED])) + """
, s AS (SELECT exact AS signature FROM dk UNION ALL SELECT near FROM dk),
k AS (SELECT exact AS signature FROM dk JOIN final USING (doc_id) WHERE reason IS NULL UNION ALL
      SELECT near FROM dk JOIN final USING (doc_id) WHERE reason IS NULL),
e AS (SELECT mem.*, vec.identity AS ti, vec.mode, spec.sm, spec.qm FROM mem JOIN vec USING (session_id) JOIN spec ON (spec.scenario, spec.partition) = (mem.scenario, mem.partition))
SELECT 'signatures_before' AS "check", (SELECT count(*) FROM (SELECT signature, kind FROM (SELECT exact AS signature, 0 AS kind FROM dk UNION ALL SELECT near, 1 FROM dk) GROUP BY ALL HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'signatures_after', (SELECT count(*) FROM (SELECT signature, kind FROM (
    SELECT exact AS signature, 0 AS kind, doc_id FROM dk UNION ALL SELECT near, 1, doc_id FROM dk) JOIN final USING (doc_id) WHERE reason IS NULL GROUP BY signature, kind HAVING count(*) > 1))
UNION ALL SELECT 'block_leaks', (SELECT count(*) FROM (SELECT identity FROM ev GROUP BY 1 HAVING min(block) <> max(block)))
UNION ALL SELECT 'unknown_session', (SELECT count(*) FROM mem WHERE session_id NOT IN (SELECT session_id FROM vec))
UNION ALL SELECT 'identity_mismatch', (SELECT count(*) FROM e WHERE identity <> ti)
UNION ALL SELECT 'role_overlap', (SELECT count(*) FROM (SELECT seed, scenario, partition, episode, session_id FROM mem GROUP BY ALL HAVING count(DISTINCT role) > 1))
UNION ALL SELECT 'repeated_record', (SELECT count(*) FROM (SELECT seed, scenario, partition, episode, session_id FROM mem GROUP BY ALL HAVING count(DISTINCT role) = 1 AND count(*) > 1))
UNION ALL SELECT 'label_conflict', (SELECT count(*) FROM (SELECT seed, scenario, partition, episode, label FROM mem GROUP BY ALL HAVING count(DISTINCT identity) > 1))
UNION ALL SELECT 'mode_mismatch', (SELECT count(*) FROM e WHERE CASE role WHEN 'support' THEN mode <> sm ELSE mode <> qm END)
UNION ALL SELECT 'condition_mismatch', 0""")
def audit_violations(spark, sf_dir) -> DataFrame:
    """Integrity checks; raw documents and time blocks show what a violation looks like."""
    documents = marked_documents(spark, sf_dir)
    blocks = tables.event_sessions(spark, sf_dir).withColumn("split", F.col("block").cast("string"))
    sessions = tables.vector_sessions(spark, sf_dir)
    checks = {"signatures_before": audit.repeated_signatures(documents),
              "signatures_after": audit.repeated_signatures(documents.where("reason is null")),
              "block_leaks": audit.split_leaks(blocks)}
    members = drawn(spark, sf_dir, CROSS_MODE)
    checks.update(audit.episode_violations(members, sessions, CROSS_MODE))
    return audit.audit_report(checks)


# --- metrics -------------------------------------------------------------------------------------------------------

from ..operators import quality, reporting  # noqa: E402
from .tables import SLICES  # noqa: E402


@register("auroc_fpr95", """
WITH s AS (SELECT quality = 1 AS known, n_chars::DOUBLE AS confidence FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0 AS rk,
             sum(known::INT) OVER (ORDER BY confidence DESC) AS tp, sum((NOT known)::INT) OVER (ORDER BY confidence DESC) AS fp FROM s),
n AS (SELECT count(*) FILTER (known) AS p, count(*) FILTER (NOT known) AS q FROM s)
SELECT round((SELECT sum(rk) FROM r WHERE known) / (p * q) - (p + 1) / (2.0 * q), 6) + 0.0 AS auroc,
       round((SELECT arg_max(fp, confidence) FROM r WHERE tp >= 0.95 * p) / q, 6) + 0.0 AS fpr95, p AS known_count, q AS unknown_count FROM n""")
def auroc_fpr95(spark, sf_dir) -> DataFrame:
    """C14: known documents against unknown ones by length, ties included."""
    scores = (tables.table(spark, sf_dir, "labels").join(tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
              .select((F.col("quality") == 1).alias("known"), F.col("n_chars").cast("double").alias("confidence")))
    return metrics.open_set_metrics(scores).select(r6("auroc").alias("auroc"), r6("fpr95").alias("fpr95"), "known_count", "unknown_count")


@register("reject_threshold", """
WITH r AS (SELECT n_chars::DOUBLE AS c, row_number() OVER (ORDER BY n_chars) AS rn, count(*) OVER () AS n FROM documents),
t AS (SELECT max(c) FILTER (rn = floor(0.05 * (n - 1)) + 1) AS threshold FROM r)
SELECT threshold, round((SELECT avg((c >= threshold)::INT) FROM r), 6) + 0.0 AS empirical_known_tpr FROM t""")
def reject_threshold(spark, sf_dir) -> DataFrame:
    """Lower five-percent quantile and the share kept."""
    confidence = tables.table(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("confidence"))
    return metrics.reject_threshold(confidence).select("threshold", r6("empirical_known_tpr").alias("empirical_known_tpr"))


WINDOWS_SQL = f"""
cells AS (SELECT identity, condition, count(*) AS n FROM vec GROUP BY ALL HAVING count(*) >= 3),
slots AS (SELECT identity, condition, unnest(places) AS place, unnest(range(3)) AS slot FROM (
  SELECT *, {sql.draws('n', '3', f"'{SEED}|' || identity || '|' || condition")} AS places FROM cells)),
win AS (SELECT identity, condition, slot, session_id, z, v, 60 * abs(z[1]) AS m0, 60 * abs(z[1]) + 20 + 40 * abs(z[2]) AS m1
        FROM (SELECT *, row_number() OVER (PARTITION BY identity, condition ORDER BY sha256(session_id::VARCHAR)) - 1 AS place FROM vec)
             JOIN slots USING (identity, condition, place)),
pr AS (SELECT a.identity, a.slot, a.session_id AS left_id, b.session_id AS right_id, a.condition AS left_condition, b.condition AS right_condition,
              greatest(0, least(a.m1, b.m1) - greatest(a.m0, b.m0)) / least(a.m1 - a.m0, b.m1 - b.m0) AS reference,
              list_dot_product(a.z, b.z) AS g, a.v AS qv, b.v AS sv
       FROM win a JOIN win b ON a.identity = b.identity AND a.slot = b.slot AND a.condition < b.condition)"""
OVERLAP_SQL = [sql.VECTORS, WINDOWS_SQL, sql.pma_ctes(8, 8)]


def overlap_frame(spark, sf_dir):
    vec = tables.vectors(spark, sf_dir)
    start = F.lit(60.0) * F.abs(F.col("z")[0])
    valid = (vec.select("session_id", "identity", start.alias("media_start"),
                        (start + 20 + F.lit(40.0) * F.abs(F.col("z")[1])).alias("media_end"))
             .join(tables.vector_sessions(spark, sf_dir).select("session_id", "condition"), "session_id"))
    windows, _ = sampling.select_windows(valid, ["identity", "condition"], 3, SEED)
    return quality.overlap_pairs(windows, vec, MatchConfig())


@register("overlap_pairs", with_clause(*OVERLAP_SQL) + """
SELECT identity, slot::INT AS slot, left_id, right_id, left_condition, right_condition, round(reference, 6) + 0.0 AS reference,
       round(overlap, 6) + 0.0 AS prediction FROM pma""")
def overlap_pairs(spark, sf_dir) -> DataFrame:
    """Three windows per identity and condition, paired across conditions."""
    return overlap_frame(spark, sf_dir).select("identity", "slot", "left_id", "right_id", "left_condition", "right_condition",
                                               r6("reference").alias("reference"), r6("prediction").alias("prediction"))


REPLICATES = 2000


@register("spearman_ci", with_clause(*OVERLAP_SQL) + f"""
, op AS MATERIALIZED (SELECT identity, round(reference, 6) AS x, round(overlap, 6) AS y FROM pma),
ids AS (SELECT identity, row_number() OVER (ORDER BY sha256(identity::VARCHAR)) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT identity FROM op)),
drawn AS (SELECT r, d, {sql.hash_number(f"'{SEED}|' || r || '|' || d")} % n AS place
          FROM (SELECT unnest(range({REPLICATES})) AS r), (SELECT DISTINCT n FROM ids), LATERAL (SELECT unnest(range(n)) AS d)),
boot AS (SELECT r, x, y FROM drawn JOIN ids USING (place) JOIN op USING (identity) UNION ALL SELECT -1, x, y FROM op),
rk AS (SELECT r, x, y, rank() OVER (PARTITION BY r ORDER BY x) + (count(*) OVER (PARTITION BY r, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY r ORDER BY y) + (count(*) OVER (PARTITION BY r, y) - 1) / 2.0 AS ry FROM boot),
rho AS (SELECT r, corr(rx, ry) AS s, avg(abs(x - y)) AS e, count(*) AS n FROM rk GROUP BY ALL),
ok AS (SELECT * FROM rho WHERE r >= 0 AND s IS NOT NULL AND NOT isnan(s))
SELECT round(s, 6) + 0.0 AS spearman, round(e, 6) + 0.0 AS mae, n AS pairs,
       round((SELECT quantile_cont(s, 0.025) FROM ok), 6) + 0.0 AS ci_spearman_low, round((SELECT quantile_cont(s, 0.975) FROM ok), 6) + 0.0 AS ci_spearman_high,
       round((SELECT quantile_cont(e, 0.025) FROM ok), 6) + 0.0 AS ci_mae_low, round((SELECT quantile_cont(e, 0.975) FROM ok), 6) + 0.0 AS ci_mae_high,
       (SELECT count(*) FROM ok) AS replicates FROM rho WHERE r = -1""")
def spearman_ci(spark, sf_dir) -> DataFrame:
    """Rank correlation of reference and predicted overlap with a clustered bootstrap."""
    pairs = overlap_frame(spark, sf_dir).select("identity", F.round("reference", 6).alias("reference"), F.round("prediction", 6).alias("prediction"))
    out = metrics.spearman_with_interval(cut_lineage(pairs), REPLICATES, SEED)
    rounded = [c for c in out.columns if c not in ("pairs", "replicates")]
    return out.select(*[r6(c).alias(c) for c in rounded], "pairs", "replicates")


@register("ecdf", with_clause(*OVERLAP_SQL) + """
, er AS MATERIALIZED (SELECT round(abs(reference - overlap), 6) + 0.0 AS error FROM pma)
SELECT DISTINCT error, round(count(*) OVER (ORDER BY error) / (SELECT count(*) FROM er)::DOUBLE, 6) + 0.0 AS cdf FROM er""")
def ecdf(spark, sf_dir) -> DataFrame:
    """Empirical distribution of the absolute overlap error."""
    errors = overlap_frame(spark, sf_dir).select(r6(F.abs(F.col("reference") - F.col("prediction"))).alias("error"))
    return reporting.empirical_cdf(cut_lineage(errors), "error").select("error", r6("cdf").alias("cdf"))


BATCH_SQL = with_clause(sql.VECTORS, sql.members(RANDOM_MIXED, [SEED])) + f"""
, b AS (SELECT {EP}, session_id, role, label, mode, z FROM mem JOIN vec USING (session_id)),
d AS (SELECT x.episode, x.session_id AS i, x.label AS li, y.label AS lj, x.session_id = y.session_id AS me, list_cosine_similarity(x.z, y.z) AS c
      FROM b x JOIN b y ON x.episode = y.episode),"""


def batch_frame(spark, sf_dir):
    """Episode rows and the vectors with their modes."""
    vec = tables.vectors(spark, sf_dir).select("session_id", "z").join(tables.vector_sessions(spark, sf_dir).select("session_id", "mode"), "session_id")
    return mixed_members(spark, sf_dir), vec


@register("supcon_value", BATCH_SQL + """
den AS (SELECT episode, i, ln(sum(exp(c / 0.1))) AS l FROM d WHERE NOT me GROUP BY ALL),
a AS (SELECT episode, i, avg(c / 0.1 - l) AS v FROM d JOIN den USING (episode, i) WHERE li = lj AND NOT me GROUP BY ALL)
SELECT episode::BIGINT AS episode, round(-avg(v), 6) + 0.0 AS contrastive FROM a GROUP BY ALL""")
def supcon_value(spark, sf_dir) -> DataFrame:
    """Supervised contrastive value of every episode."""
    return quality.contrastive_values(*batch_frame(spark, sf_dir)).select(F.col("episode").cast("bigint"), r6("contrastive").alias("contrastive"))


@register("triplet_value", BATCH_SQL + """
h AS (SELECT episode, i, max(sqrt(greatest(2 - 2 * c, 0))) FILTER (li = lj AND NOT me) AS p, min(sqrt(greatest(2 - 2 * c, 0))) FILTER (li <> lj) AS n FROM d GROUP BY ALL)
SELECT episode::BIGINT AS episode, round(avg(greatest(p - n + 0.2, 0)), 6) + 0.0 AS triplet FROM h GROUP BY ALL""")
def triplet_value(spark, sf_dir) -> DataFrame:
    """Batch-hard triplet hinge of every episode."""
    return quality.triplet_values(*batch_frame(spark, sf_dir)).select(F.col("episode").cast("bigint"), r6("triplet").alias("triplet"))


@register("class_consistency", BATCH_SQL + """
rm AS (SELECT episode, label, role, k, avg(x) AS m FROM (SELECT episode, label, role, unnest(range(64)) AS k, unnest(z) AS x FROM b) GROUP BY ALL),
cs AS (SELECT episode, label, sum((s.m - q.m) ** 2) AS v FROM rm s JOIN rm q USING (episode, label, k) WHERE s.role = 'support' AND q.role = 'query' GROUP BY ALL),
mm AS (SELECT episode, label, mode, k, avg(x) AS m FROM (SELECT episode, label, mode, unnest(range(64)) AS k, unnest(z) AS x FROM b) GROUP BY ALL),
ds AS (SELECT episode, label, s.mode, q.mode AS other, sum((s.m - q.m) ** 2) AS v FROM mm s JOIN mm q USING (episode, label, k) WHERE s.mode < q.mode GROUP BY ALL)
SELECT episode::BIGINT AS episode, round((SELECT avg(v) FROM cs WHERE cs.episode = e.episode), 6) + 0.0 AS consistency,
       round((SELECT avg(v) FROM ds WHERE ds.episode = e.episode), 6) + 0.0 AS domain FROM (SELECT DISTINCT episode FROM b) e""")
def class_consistency(spark, sf_dir) -> DataFrame:
    """support/query and mode mean gaps of every episode."""
    members, vec = batch_frame(spark, sf_dir)
    joined = quality.consistency_values(members, vec, dim=64).join(quality.domain_values(members, vec, dim=64), quality.EPISODE)
    return joined.select(F.col("episode").cast("bigint"), r6("consistency").alias("consistency"), r6("domain").alias("domain"))


# --- evaluation and reports ----------------------------------------------------------------------------------------

from ..operators import evaluation, search  # noqa: E402

REPORT_PARTS = RANDOM_MIXED + CROSS_MODE
REPORT_SQL = [sql.VECTORS, sql.members(REPORT_PARTS, SEEDS3), sql.PROTOTYPES, sql.PREDICT, sql.REPORT_ACC]
SESSION_PARTS = [EpisodePart("random_mixed", 0, 300, 5, 2, 2)]
FRACTIONS = (0.2, 0.5, 1.0)
OPEN_CONFIG = MatchConfig(alignment="none", aggregation="support_max", lambda_z=1.0)


def report_frame(spark, sf_dir):
    """Accuracy reports of three sampling seeds, one row per seed and scenario; materialised as six rows."""
    members = drawn(spark, sf_dir, REPORT_PARTS, SEEDS3)
    scores = matching.prototype_scores(members, tables.vectors(spark, sf_dir), dim=64)
    per_episode = metrics.episode_accuracy(matching.predictions(scores), members)
    return cut_lineage(metrics.accuracy_summary(per_episode, ["seed", "scenario"]))


@register("seed_summary", with_clause(*REPORT_SQL) + f"""
SELECT scenario, count(*) AS seeds, {sql.rounded('100 * avg(accuracy)', 'mean_percent')}, {sql.rounded('100 * stddev_samp(accuracy)', 'sample_std_percent')},
       count(*) = 3 AS complete FROM rep GROUP BY scenario""")
def seed_summary(spark, sf_dir) -> DataFrame:
    """Mean and deviation over seeds."""
    out = reporting.seed_summary(report_frame(spark, sf_dir), ["scenario"])
    return out.select("scenario", "seeds", r6("mean_percent").alias("mean_percent"), r6("sample_std_percent").alias("sample_std_percent"), "complete")


@register("diagnostics_summary", with_clause(*REPORT_SQL) + f"""
, long AS (UNPIVOT (SELECT scenario AS kind, accuracy, episode_std, episode_sem FROM rep) ON accuracy, episode_std, episode_sem INTO NAME metric VALUE value)
SELECT kind, metric, count(*) AS measurements, {sql.rounded('avg(value)', 'mean')}, {sql.rounded('stddev_samp(value)', 'sample_std')} FROM long GROUP BY ALL""")
def diagnostics_summary(spark, sf_dir) -> DataFrame:
    """Unpivoted metrics by kind."""
    rows = report_frame(spark, sf_dir).withColumnRenamed("scenario", "kind")
    out = reporting.diagnostics_summary(rows, ["kind"], ["accuracy", "episode_std", "episode_sem"])
    return out.select("kind", "metric", "measurements", r6("mean").alias("mean"), r6("sample_std").alias("sample_std"))


@register("completeness_table", with_clause(*REPORT_SQL) + f"""
, grid AS (SELECT s AS scenario, d AS seed FROM (SELECT unnest(['random_mixed', 'cross_mode', 'same_mode']) AS s), (SELECT unnest([{', '.join(map(str, SEEDS3))}]) AS d)),
j AS (SELECT grid.*, accuracy FROM grid LEFT JOIN rep USING (scenario, seed))
SELECT scenario, -1::BIGINT AS seed, {sql.rounded('avg(accuracy)', 'mean')}, {sql.rounded('stddev_samp(accuracy)', 'sample_std')}, count(accuracy) AS measurements,
       count(*) AS expected_measurements, count(accuracy) = count(*) AS complete FROM j GROUP BY scenario
UNION ALL SELECT scenario, seed, NULL, NULL, 0, 1, false FROM j WHERE accuracy IS NULL""")
def completeness_table(spark, sf_dir) -> DataFrame:
    """Expected against measured cells, then the missing units."""
    grid = spark.createDataFrame([(s,) for s in ("random_mixed", "cross_mode", "same_mode")], "scenario string").withColumn(
        "seed", F.explode(F.array(*[F.lit(s) for s in SEEDS3])))
    table, missing = reporting.completeness_table(grid, report_frame(spark, sf_dir), ["scenario"], ["seed"], "accuracy")
    top = table.select("scenario", F.lit(-1).cast("bigint").alias("seed"), r6("mean").alias("mean"), r6("sample_std").alias("sample_std"),
                       "measurements", "expected_measurements", "complete")
    rest = missing.select("scenario", F.col("seed").cast("bigint"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("sample_std"),
                          F.lit(0).cast("bigint").alias("measurements"), F.lit(1).cast("bigint").alias("expected_measurements"), F.lit(False).alias("complete"))
    return top.unionByName(rest)


GAMMAS = [0.01, 0.05, 0.1, 0.2, 0.5]
GAMMA_SQL = with_clause(sql.VECTORS, sql.members(CROSS_MODE, SEEDS3), sql.pairs_cte(),
                        f"prg AS (SELECT pr.*, gm FROM pr, (SELECT unnest({GAMMAS}::DOUBLE[]) AS gm))", sql.soft_dtw_ctes(8, 8, gamma="gm", source="prg").replace("sdtw AS (", "sdtw AS MATERIALIZED ("))


@register("best_gamma", GAMMA_SQL + f"""
, candg AS (SELECT gm, {EP}, query_id, label, max(score) AS candidate FROM sdtw GROUP BY ALL),
tops AS (SELECT *, row_number() OVER (PARTITION BY gm, {EP}, query_id ORDER BY candidate DESC, label) AS rn FROM candg),
ep AS (SELECT gm, t.seed, t.scenario, t.partition, t.episode, avg((t.label = m.label)::INT) AS accuracy FROM tops t JOIN mem m
  ON (t.seed, t.scenario, t.partition, t.episode, t.query_id, 'query') = (m.seed, m.scenario, m.partition, m.episode, m.session_id, m.role) WHERE rn = 1 GROUP BY ALL),
sd AS (SELECT gm, seed, avg(accuracy) AS a FROM ep GROUP BY ALL), mn AS (SELECT gm, avg(a) AS a FROM sd GROUP BY ALL)
SELECT 'cross_mode' AS scenario, gm AS gamma, round(a, 6) + 0.0 AS mean_value FROM mn ORDER BY round(a, 12) DESC, gm LIMIT 1""")
def best_gamma(spark, sf_dir) -> DataFrame:
    """Soft-DTW smoothing chosen by mean accuracy over three seeds."""
    vec = tables.vectors(spark, sf_dir)
    members = drawn(spark, sf_dir, CROSS_MODE, SEEDS3)
    config = MatchConfig(alignment="soft_dtw", aggregation="support_max")
    pairs = matching.episode_pairs(members, vec, config, max_side=MAX_SIDE, gammas=GAMMAS)
    group = ["gamma", *EPISODE]
    best = matching.predictions(matching.candidate_scores(pairs, config, group), group)
    truth = members.where("role = 'query'").select(*EPISODE, F.col("session_id").alias("query_id"), "label")
    hits = best.join(truth, [*EPISODE, "query_id"]).groupBy(*group).agg(
        F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"))
    results = hits.groupBy("scenario", "gamma", "seed").agg(F.avg("accuracy").alias("accuracy")).withColumn("accuracy", F.round("accuracy", 12))
    out = reporting.best_parameter(results, ["scenario"], "gamma", GAMMAS, list(SEEDS3))
    return out.select("scenario", "gamma", r6("mean_value").alias("mean_value"))


SWEEP = [({"tau_c": c, "tau_s": s}, "grid") for c in (0.1, 0.2, 0.4) for s in (0.05, 0.1, 0.2)] + [({"tau_c": 0.2, "tau_s": 0.1}, "default")]


@register("param_sweep", with_clause(*CROSS_SQL, sql.pairs_cte(), sql.pma_ctes(8, 8)) + f"""
, grid AS (SELECT tau_c, tau_s, CASE WHEN tau_c = 0.2 AND tau_s = 0.1 THEN 'default,grid' ELSE 'grid' END AS tags
           FROM (SELECT unnest([0.1, 0.2, 0.4]::DOUBLE[]) AS tau_c), (SELECT unnest([0.05, 0.1, 0.2]::DOUBLE[]) AS tau_s)),
w AS (SELECT tau_c, tau_s, tags, {EP}, query_id, label, score, exp((local + overlap) / tau_c) / sum(exp((local + overlap) / tau_c)) OVER (PARTITION BY tau_c, tau_s, {EP}, query_id, label) AS omega FROM pma, grid),
c AS (SELECT tau_c, tau_s, tags, {EP}, query_id, label, max(tau_s) * ln(sum(omega * exp(score / tau_s))) AS candidate FROM w GROUP BY tau_c, tau_s, tags, {EP}, query_id, label),
t AS (SELECT *, row_number() OVER (PARTITION BY tau_c, tau_s, {EP}, query_id ORDER BY candidate DESC, label) AS rn FROM c)
SELECT tau_c, tau_s, tags, round(avg((t.label = m.label)::INT), 6) + 0.0 AS accuracy FROM t JOIN mem m
  ON (t.seed, t.scenario, t.partition, t.episode, t.query_id, 'query') = (m.seed, m.scenario, m.partition, m.episode, m.session_id, m.role)
WHERE rn = 1 GROUP BY ALL""")
def param_sweep(spark, sf_dir) -> DataFrame:
    """Temperatures swept over pairs scored once; equal settings merged with their tags."""
    grid = reporting.parameter_grid(spark, SWEEP)
    members = drawn(spark, sf_dir, CROSS_MODE)
    scores = reporting.sweep_scores(cross_pairs(spark, sf_dir, "pma"), grid, EPISODE)
    best = matching.predictions(scores, ["config_hash", *EPISODE])
    truth = members.where("role = 'query'").select(*EPISODE, F.col("session_id").alias("query_id"), "label")
    hits = best.join(truth, [*EPISODE, "query_id"]).groupBy("config_hash").agg(
        F.avg(F.when(F.col("prediction") == F.col("label"), 1.0).otherwise(0.0)).alias("accuracy"))
    return hits.join(grid, "config_hash").select("tau_c", "tau_s", F.array_join("tags", ",").alias("tags"), r6("accuracy").alias("accuracy"))


MATRIX_PARTS = [p for p in scenario_catalogue("shaped", condition_matrix=True) if p.scenario.startswith("bandwidth_")]


@register("condition_matrix", with_clause(sql.VECTORS, sql.members(MATRIX_PARTS, [SEED]), sql.PROTOTYPES, sql.PREDICT) + f"""
, one AS (SELECT scenario, 100 * avg(accuracy) AS v FROM acc GROUP BY ALL),
mx AS (SELECT q.seed, q.scenario, q.partition, q.episode, q.session_id AS query_id, s.label, max(list_dot_product(a.z, b.z)) AS candidate
  FROM mem q JOIN mem s ON (q.scenario, q.episode) = (s.scenario, s.episode) JOIN vec a ON a.session_id = q.session_id JOIN vec b ON b.session_id = s.session_id
  WHERE q.role = 'query' AND s.role = 'support' GROUP BY ALL),
mt AS (SELECT *, row_number() OVER (PARTITION BY scenario, episode, query_id ORDER BY candidate DESC, label) AS rn FROM mx),
two AS (SELECT scenario, 100 * avg(a) AS v FROM (SELECT t.scenario, t.episode, avg((t.label = m.label)::INT) AS a FROM mt t JOIN mem m
  ON (t.scenario, t.episode, t.query_id, 'query') = (m.scenario, m.episode, m.session_id, m.role) WHERE rn = 1 GROUP BY ALL) GROUP BY ALL)
SELECT 'bw' || split_part(scenario, '_', 2) AS support_condition, 'bw' || split_part(scenario, '_', 4) AS query_condition,
       round(one.v, 6) + 0.0 AS value, round(two.v, 6) + 0.0 AS other, round(one.v - two.v, 6) + 0.0 AS delta FROM one JOIN two USING (scenario)""")
def condition_matrix(spark, sf_dir) -> DataFrame:
    """Accuracy by support and query condition for prototypes and nearest support, and their difference."""
    vec = tables.vectors(spark, sf_dir)
    members = drawn(spark, sf_dir, MATRIX_PARTS)

    def cells(scores):
        mean = metrics.accuracy_summary(metrics.episode_accuracy(matching.predictions(scores), members), ["scenario"])
        part = lambda i: F.concat(F.lit("bw"), F.split("scenario", "_")[i])
        return mean.select(part(1).alias("support_condition"), part(3).alias("query_condition"), (F.col("accuracy") * 100).alias("mean_percent"))

    nearest = matching.candidate_scores(matching.episode_pairs(members, vec, OPEN_CONFIG, max_side=MAX_SIDE), OPEN_CONFIG)
    delta = reporting.matrix_delta(cells(matching.prototype_scores(members, vec, dim=64)), cells(nearest))
    return delta.select("support_condition", "query_condition", r6("value").alias("value"), r6("other").alias("other"), r6("delta").alias("delta"))


@register("truncation_curve", with_clause(sql.PACKETS, sql.SESSIONS, sql.split_ctes(SEED), sql.members(SESSION_PARTS, [SEED], "sess"),
                                          sql.closed_set_ctes(FRACTIONS)) + """
SELECT fraction::DOUBLE AS fraction, scenario, count(*) AS episodes, round(avg(accuracy), 6) + 0.0 AS accuracy FROM acc_all GROUP BY ALL""")
def truncation_curve(spark, sf_dir) -> DataFrame:
    """Recognition of event sessions with truncated queries, from raw packets."""
    members = cut_lineage(sampling.episode_members(tables.event_sessions(spark, sf_dir), SESSION_PARTS, (SEED,), strict=False))
    stats = event_stats(spark, sf_dir)
    per_episode = evaluation.evaluate_closed(members, tables.packets(spark, sf_dir), stats, EVENT_DATA, MatchConfig(), FRACTIONS, max_side=10)
    out = evaluation.closed_set_report(per_episode)
    return out.select("fraction", "scenario", "episodes", r6("accuracy").alias("accuracy"))


def open_frame(spark, sf_dir, seed=SEED):
    return cut_lineage(sampling.open_partitions(tables.vector_sessions(spark, sf_dir), 5, 5, 5, seed))


def open_sql(seed: int, tag: str = "") -> str:
    return f"""
grid{tag} AS (SELECT identity, p AS partition, n, row_number() OVER (PARTITION BY p ORDER BY sha256('{seed}|open|' || p || '|' || identity)) - 1 AS place
           FROM (SELECT identity, p, count(*) AS n FROM vec, (SELECT unnest(range(5)) AS p) GROUP BY ALL)),
lab{tag} AS (SELECT *, place < 5 AS known, CASE WHEN place < 5 THEN row_number() OVER (PARTITION BY partition, place < 5 ORDER BY identity) - 1 ELSE -1 END AS label,
               '{seed}|gallery|' || partition || '|' || identity AS key FROM grid{tag}),
draw{tag} AS (SELECT *, CASE WHEN known THEN {sql.draws('n', '5', 'key')} ELSE []::BIGINT[] END AS places FROM lab{tag}),
ranked{tag} AS (SELECT session_id, identity, row_number() OVER (PARTITION BY identity ORDER BY sha256(session_id::VARCHAR)) - 1 AS place FROM vec),
op{tag} AS (SELECT partition, identity, known, CASE WHEN list_contains(places, ranked{tag}.place) THEN 'support' ELSE 'query' END AS role, label, session_id
            FROM ranked{tag} JOIN draw{tag} USING (identity)),
sc{tag} AS (SELECT q.partition, q.session_id, q.known, max(list_dot_product(a.z, b.z)) AS confidence
            FROM op{tag} q JOIN op{tag} s ON q.partition = s.partition JOIN vec a ON a.session_id = q.session_id JOIN vec b ON b.session_id = s.session_id
            WHERE q.role = 'query' AND s.role = 'support' GROUP BY ALL),
rr{tag} AS (SELECT *, rank() OVER (PARTITION BY partition ORDER BY confidence) + (count(*) OVER (PARTITION BY partition, confidence) - 1) / 2.0 AS rk,
       sum(known::INT) OVER (PARTITION BY partition ORDER BY confidence DESC) AS tp, sum((NOT known)::INT) OVER (PARTITION BY partition ORDER BY confidence DESC) AS fp FROM sc{tag}),
nn{tag} AS (SELECT partition, count(*) FILTER (known) AS p, count(*) FILTER (NOT known) AS q FROM sc{tag} GROUP BY ALL),
res{tag} AS (SELECT partition, p, q, (SELECT sum(rk) FROM rr{tag} r WHERE r.known AND r.partition = nn{tag}.partition) / (p * q) - (p + 1) / (2.0 * q) AS auroc,
       (SELECT arg_max(fp, confidence) FROM rr{tag} r WHERE r.partition = nn{tag}.partition AND tp >= 0.95 * p) / q::DOUBLE AS fpr95 FROM nn{tag})"""


@register("open_set_eval", with_clause(sql.VECTORS, open_sql(SEED)) + """
SELECT partition::INT AS partition, round(auroc, 6) + 0.0 AS auroc, round(fpr95, 6) + 0.0 AS fpr95, p AS known_count, q AS unknown_count FROM res""")
def open_set_eval(spark, sf_dir) -> DataFrame:
    """known/unknown detection per partition by the best gallery score."""
    result, _ = evaluation.evaluate_open(open_frame(spark, sf_dir), tables.vectors(spark, sf_dir), OPEN_CONFIG)
    return result.select("partition", r6("auroc").alias("auroc"), r6("fpr95").alias("fpr95"), "known_count", "unknown_count")


@register("open_set_summary", with_clause(sql.VECTORS, *[open_sql(s, f"_{i}") for i, s in enumerate(SEEDS3)]) + f"""
, a AS ({' UNION ALL '.join(f'SELECT auroc, fpr95 FROM res_{i}' for i in range(3))})
SELECT 'nearest' AS method, count(*) AS evaluations, count(*) = 15 AS complete, round(avg(auroc), 6) + 0.0 AS auroc_mean, round(stddev_samp(auroc), 6) + 0.0 AS auroc_sample_std,
       round(avg(fpr95), 6) + 0.0 AS fpr95_mean, round(stddev_samp(fpr95), 6) + 0.0 AS fpr95_sample_std FROM a""")
def open_set_summary(spark, sf_dir) -> DataFrame:
    """C20: fifteen open-set measurements over three seeds and five partitions."""
    vec, rows = tables.vectors(spark, sf_dir), None
    for seed in SEEDS3:
        result, _ = evaluation.evaluate_open(open_frame(spark, sf_dir, seed), vec, OPEN_CONFIG)
        rows = result if rows is None else rows.unionByName(result)
    out = reporting.open_set_summary(rows.withColumn("method", F.lit("nearest")), ["method"])
    return out.select("method", "evaluations", "complete", *[r6(c).alias(c) for c in ("auroc_mean", "auroc_sample_std", "fpr95_mean", "fpr95_sample_std")])


RECOGNIZE_SQL = with_clause(sql.VECTORS, open_sql(SEED), """
pr AS (SELECT q.session_id AS query_id, s.session_id AS support_id, 'class_' || s.identity AS label, list_dot_product(a.z, b.z) AS g, a.v AS qv, b.v AS sv
       FROM op q JOIN op s ON q.partition = 0 AND s.partition = 0 JOIN vec a ON a.session_id = q.session_id JOIN vec b ON b.session_id = s.session_id
       WHERE q.role = 'query' AND s.role = 'support')""", sql.pma_ctes(8, 8))


@register("recognize", RECOGNIZE_SQL + """
, cw AS (SELECT *, exp((local + overlap) / 0.2) / sum(exp((local + overlap) / 0.2)) OVER (PARTITION BY query_id, label) AS omega FROM pma),
cand AS (SELECT query_id, label, 0.1 * ln(sum(omega * exp(score / 0.1))) AS candidate FROM cw GROUP BY ALL),
best AS (SELECT query_id, max(candidate) AS confidence, arg_max(label, candidate) AS label FROM cand GROUP BY ALL)
SELECT c.query_id, c.label AS candidate_label, round(c.candidate, 6) + 0.0 AS candidate, round(confidence, 6) + 0.0 AS confidence, confidence < 0.25 AS rejected,
       CASE WHEN confidence < 0.25 THEN NULL ELSE b.label END AS label FROM cand c JOIN best b USING (query_id)""")
def recognize(spark, sf_dir) -> DataFrame:
    """Enrol the first partition's gallery, recognise its queries, reject below a threshold."""
    vec = tables.vectors(spark, sf_dir)
    rows = open_frame(spark, sf_dir).where("partition = 0")
    manifest = rows.where("role = 'support'").select("session_id", F.concat(F.lit("class_"), F.col("identity").cast("string")).alias("label_name"))
    gallery = cut_lineage(matching.enroll(vec, manifest))  # an enrolled gallery is a stored table
    queries = rows.where("role = 'query'").select("session_id").join(vec, "session_id")
    out = matching.recognize(queries, gallery, MatchConfig(), threshold=0.25)
    return out.select("query_id", "label", "rejected", r6("confidence").alias("confidence"), F.explode("scores").alias("candidate_label", "candidate")).withColumn("candidate", r6("candidate"))


@register("case_study", with_clause(*CROSS_SQL, sql.pairs_cte(), sql.pma_ctes(8, 8), sql.class_scores("compatibility")) + """
, first_query AS (SELECT episode, min(session_id) AS query_id FROM mem WHERE role = 'query' AND scenario = 'cross_mode' AND episode = 0 GROUP BY ALL)
SELECT c.support_id, round(local, 6) + 0.0 AS local, round(overlap, 6) + 0.0 AS overlap, round(score, 6) + 0.0 AS score, round(omega, 6) + 0.0 AS omega,
       rank() OVER (ORDER BY round(omega, 9) DESC, support_id) AS place
FROM cw c JOIN first_query f USING (episode, query_id) JOIN mem m ON m.role = 'query' AND m.episode = 0 AND m.session_id = c.query_id AND m.label = c.label""")
def case_study(spark, sf_dir) -> DataFrame:
    """Supports behind one query's true class, ranked by responsibility."""
    members = drawn(spark, sf_dir, CROSS_MODE)
    query = members.where("role = 'query' and episode = 0").agg(F.min("session_id")).first()[0]
    pairs = matching.episode_pairs(members.where("episode = 0"), tables.vectors(spark, sf_dir), MatchConfig(), max_side=MAX_SIDE)
    rows = quality.case_study(pairs, members, MatchConfig(), SEED, "cross_mode", 0, query)
    # One query has at most ``shots`` supports of its class.
    place = F.rank().over(Window.partitionBy("query_id").orderBy(F.round("omega", 9).desc(), "support_id"))
    return rows.select("support_id", *[r6(c).alias(c) for c in ("local", "overlap", "score", "omega")], place.cast("bigint").alias("place"))


@register("storage_footprint", """
SELECT count(*) AS fingerprints, sum(len(embedding) * 8)::BIGINT AS z_bytes, (count(*) * 64 * 8)::BIGINT AS v_bytes, (count(*) * 8 * 8)::BIGINT AS r_bytes,
       round((sum(len(embedding) * 8) + count(*) * 72 * 8) / count(*)::DOUBLE / 1024, 6) + 0.0 AS kib_per_fingerprint FROM embeddings""")
def storage_footprint(spark, sf_dir) -> DataFrame:
    """Bytes per stored fingerprint component."""
    out = reporting.storage_footprint(tables.vectors(spark, sf_dir), ["z", "v", "r"])
    return out.withColumn("kib_per_fingerprint", r6("kib_per_fingerprint"))


# --- views of a fingerprint ----------------------------------------------------------------------------------------

VIEW_WINDOW = 60.0


@register("correspondence", with_clause(sql.VECTORS, sql.view_ctes(SEED), sql.pma_ctes(8, 8, holes=True), sql.correspondence_ctes(2.0)) + """
, per AS (SELECT session_id, any_value(abs(overlap - reference)) AS gap FROM er GROUP BY ALL)
SELECT (SELECT count(*) FROM per) AS pairs, count(*) AS tokens, round(avg(e), 6) + 0.0 AS alignment_mae, round(avg((e <= 2)::INT), 6) + 0.0 AS align_near,
       round((SELECT avg(gap) FROM per), 6) + 0.0 AS overlap_mae FROM er""")
def correspondence(spark, sf_dir) -> DataFrame:
    """Aligned times of two partial, warped views against the truth."""
    errors = quality.correspondence_errors(tables.vectors(spark, sf_dir), SLICES, VIEW_WINDOW, SEED, MatchConfig())
    out = quality.correspondence_report(cut_lineage(errors))
    return out.select("pairs", "tokens", *[r6(c).alias(c) for c in ("alignment_mae", "align_near", "overlap_mae")])


@register("alignment_entropy", with_clause(sql.VECTORS, f"""
sd AS (SELECT session_id, 1 AS side, v, 0.0 AS s, 1.0 AS l, 0.6 * {sql.hash_number(f"'{SEED}|' || session_id || '|warp'")} / {float(1 << 48)!r}::DOUBLE - 0.3 AS eta FROM vec)""",
    sql.warp_ctes(VIEW_WINDOW), """
pr AS (SELECT session_id, vec.v AS qv, list_transform(range(8), lambda i: 1.0) AS qr, p.v AS sv, p.r AS sr, p.c AS cb, 0.0 AS g FROM packed p JOIN vec USING (session_id))""",
    sql.pma_ctes(8, 8, holes=True), sql.entropy_ctes()) + """
SELECT session_id, count(*)::INT AS columns, round(avg(l), 6) + 0.0 AS cross_entropy FROM en GROUP BY ALL""")
def alignment_entropy(spark, sf_dir) -> DataFrame:
    """Alignment mass of a fingerprint and its warped copy against the Gaussian target."""
    pairs = quality.warp_pairs(tables.vectors(spark, sf_dir), SLICES, VIEW_WINDOW, SEED)
    out = quality.alignment_entropy(pairs, SLICES, MatchConfig())
    return out.select("session_id", "columns", r6("cross_entropy").alias("cross_entropy"))


@register("prefix_view", with_clause(sql.VECTORS) + """
, p AS (SELECT session_id, unnest(range(64)) AS i, unnest(z) AS x, (session_id % 10 + 1) / 10.0::DOUBLE AS f FROM vec)
SELECT session_id, sum(((i + 0.5) * 60 / 64 <= f * 60)::INT)::BIGINT AS kept, round(sum(CASE WHEN (i + 0.5) * 60 / 64 <= f * 60 THEN x ELSE 0 END), 6) + 0.0 AS total FROM p GROUP BY ALL""")
def prefix_view(spark, sf_dir) -> DataFrame:
    """Entries beyond a fraction of the window become zero."""
    rows = tables.vectors(spark, sf_dir).selectExpr("session_id", "z", "(session_id % 10 + 1) / 10D AS f")
    rows = rows.selectExpr("session_id", f"{quality.prefix_view('z', 'f', VIEW_WINDOW)} AS seen",
                           f"{quality.prefix_view('transform(z, x -> 1D)', 'f', VIEW_WINDOW)} AS ones")
    add = "aggregate({0}, 0D, (s, x) -> s + x)"
    return rows.selectExpr("session_id", f"cast({add.format('ones')} AS bigint) AS kept", f"{add.format('seen')} AS total").withColumn("total", r6("total"))


@register("verify_reports", with_clause(*REPORT_SQL) + """
SELECT seed::BIGINT AS seed, scenario, round(accuracy, 6) + 0.0 AS accuracy, true AS passed FROM rep""")
def verify_reports(spark, sf_dir) -> DataFrame:
    """Reported accuracy against the one recomputed from prediction records."""
    members = drawn(spark, sf_dir, REPORT_PARTS, SEEDS3)
    predicted = cut_lineage(matching.predictions(matching.prototype_scores(members, tables.vectors(spark, sf_dir), dim=64)))
    reported = metrics.accuracy_summary(metrics.episode_accuracy(predicted, members), ["seed", "scenario"])
    truth = members.where("role = 'query'").select(*EPISODE, F.col("session_id").alias("query_id"), F.col("label").alias("target"))
    out = metrics.verify_accuracy(predicted.join(truth, [*EPISODE, "query_id"]), reported, ["seed", "scenario"])
    return out.select(F.col("seed").cast("bigint"), "scenario", r6("accuracy").alias("accuracy"), "passed")


@register("real_overlap_windows", with_clause(sql.EVENT_ROWS, sql.SESSIONS, sql.FRONTIER) + """
, span AS (SELECT session_id, min(raw) FILTER (k = 0) AS m0, max(raw) AS m1 FROM chk JOIN verdict USING (session_id) WHERE reason IS NULL GROUP BY ALL),
good AS (SELECT session_id, identity, condition, m0, m1 FROM span JOIN sess USING (session_id) WHERE m1 > m0)
SELECT a.identity, a.condition AS left_condition, b.condition AS right_condition,
       round(greatest(0, least(a.m1, b.m1) - greatest(a.m0, b.m0)) / least(a.m1 - a.m0, b.m1 - b.m0), 6) + 0.0 AS reference
FROM good a JOIN good b ON a.identity = b.identity AND a.condition < b.condition""")
def real_overlap_windows(spark, sf_dir) -> DataFrame:
    """Delivered-media intervals of event sessions paired within a user across blocks."""
    logs = tables.playback_logs(spark, sf_dir)
    frontier = players.delivery_frontier(logs["sessions"], logs["states"], logs["rates"], logs["buffers"], FRONTIER_TARGETS, FRONTIER_GAP, bucket=86_400.0)
    spans = players.media_intervals(frontier).where("reason is null").drop("reason")
    rows = cut_lineage(spans.join(tables.event_sessions(spark, sf_dir).select("session_id", "identity", "condition"), "session_id"))
    a, b = rows.alias("a"), rows.alias("b")
    # A user has one window per block, five at most.
    paired = a.join(b, "identity").where("a.condition < b.condition")
    value = quality.interval_overlap(F.col("a.media_start"), F.col("a.media_end"), F.col("b.media_start"), F.col("b.media_end"))
    return paired.select("identity", F.col("a.condition").alias("left_condition"), F.col("b.condition").alias("right_condition"), r6(value).alias("reference"))


BALANCED = [p for p in ALL_SCENARIOS if p.balanced]


@register("balanced_episodes", with_clause(sql.VECTORS, sql.members(BALANCED, [SEED])) + """
SELECT episode::BIGINT AS episode, role, identity, label::BIGINT AS label, mode, session_id FROM mem JOIN (SELECT session_id, mode FROM vec) USING (session_id)""")
def balanced_episodes(spark, sf_dir) -> DataFrame:
    """Two rows per mode and identity, one for each role."""
    sessions = tables.vector_sessions(spark, sf_dir)
    rows = sampling.episode_members(sessions, BALANCED, (SEED,), strict=False).join(sessions.select("session_id", "mode"), "session_id")
    return rows.select(F.col("episode").cast("bigint"), "role", "identity", F.col("label").cast("bigint"), "mode", "session_id")


@register("protocol_manifest", with_clause(sql.VECTORS, sql.members(ALL_SCENARIOS, [SEED])) + """
SELECT seed::BIGINT AS seed, scenario, count(DISTINCT episode) AS episodes, count(*) FILTER (role = 'support') AS supports, count(*) FILTER (role = 'query') AS queries
FROM mem GROUP BY ALL""")
def protocol_manifest(spark, sf_dir) -> DataFrame:
    """E5: episodes and rows per scenario."""
    out = sampling.protocol_manifest(sampling.episode_members(tables.vector_sessions(spark, sf_dir), ALL_SCENARIOS, (SEED,), strict=False))
    return out.select(F.col("seed").cast("bigint"), "scenario", "episodes", "supports", "queries")


@register("packet_validity", with_clause(sql.EVENT_ROWS) + """
SELECT CASE WHEN value < 0 THEN 'invalid_packet_value' WHEN event_type = 'signup' THEN 'invalid_direction' ELSE 'usable' END AS verdict, count(*) AS packets
FROM ev GROUP BY ALL""")
def packet_validity(spark, sf_dir) -> DataFrame:
    """Packets without a direction are set aside with a reason (signups have none here)."""
    kind = F.col("event_type")
    direction = F.when(kind.isin("click", "purchase"), 1).when(kind.isin("view", "error"), 0)
    raw = tables.event_rows(spark, sf_dir).select("session_id", "t", direction.alias("direction"), F.col("value").alias("length"))
    good, bad = features.split_packets(raw)
    rows = good.select(F.lit("usable").alias("verdict")).unionByName(bad.select(F.col("reason").alias("verdict")))
    return rows.groupBy("verdict").agg(F.count("*").alias("packets"))


# --- logs of every format, written from the events and read back ---------------------------------------------------

def rounded6(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])


@register("line_log_packets", with_clause(sql.LOG_ROWS) + """
SELECT session_id, 'bw' || (1 << (block % 4)) AS condition, round(u0 / 1000.0::DOUBLE / 1000, 6) + 0.0 AS origin,
       round(u1 * 1000 / 1e9 - u0 * 1000 / 1e9, 6) + 0.0 AS duration, round(us * 1000 / 1e9 - u0 * 1000 / 1e9, 6) + 0.0 AS t, up AS direction,
       round(value, 6) + 0.0 AS length FROM lg JOIN ends USING (session_id)""")
def line_log_packets(spark, sf_dir) -> DataFrame:
    """Line logs written with their companions, discovered, paired and read."""
    return rounded6(logs.line_packets(spark, sf_dir), "origin", "duration", "t", "length")


@register("line_log_player", with_clause(sql.LOG_ROWS) + """
SELECT session_id, CASE WHEN event_type IN ('error', 'signup') THEN 'state' ELSE 'series' END AS kind,
       round(us / 1000.0::DOUBLE / 1000 - u0 / 1000.0::DOUBLE / 1000, 6) + 0.0 AS t,
       CASE event_type WHEN 'view' THEN 'btr' WHEN 'purchase' THEN 'buf' WHEN 'click' THEN 'pbr' WHEN 'error' THEN 'playbackWaiting' ELSE 'playbackPlaying' END AS name,
       CASE WHEN event_type IN ('view', 'purchase', 'click') THEN round(value, 6) + 0.0 END AS value FROM lg JOIN ends USING (session_id)""")
def line_log_player(spark, sf_dir) -> DataFrame:
    """A5: states and series of the player event logs, relative to the trace's origin."""
    return rounded6(logs.line_player(spark, sf_dir), "t", "value")


@register("capture_packets", with_clause(sql.LOG_ROWS) + """
SELECT session_id, round(u1 / 1e6 - u0 / 1e6, 6) + 0.0 AS duration, round(us / 1e6 - u0 / 1e6, 6) + 0.0 AS t, up AS direction, round(value, 6) + 0.0 AS length
FROM lg JOIN ends USING (session_id)""")
def capture_packets(spark, sf_dir) -> DataFrame:
    """A2, A4: CSV captures, the client inferred from the addresses, paired with their application data."""
    return rounded6(logs.capture_packets(spark, sf_dir), "duration", "t", "length")


@register("capture_player", with_clause(sql.LOG_ROWS) + """
SELECT session_id, 'v' || identity AS identity, round(us / 1e6, 6) + 0.0 AS t, ([360, 360, 480, 720, 1080, 144])[(seq % 6 + 1)::INT]::DOUBLE AS quality,
       round(value / 1000, 6) + 0.0 AS buffer, (event_type = 'error')::INT::DOUBLE AS stalled, (event_type IN ('error', 'purchase'))::INT::DOUBLE AS state FROM lg""")
def capture_player(spark, sf_dir) -> DataFrame:
    """Application data with format codes, one identity a log."""
    return rounded6(logs.csv_player(spark, sf_dir), "t", "buffer")


NPZ_SQL = with_clause(sql.LOG_ROWS) + """
SELECT session_id, round(us / 1e6 - u0 / 1e6, 6) + 0.0 AS t, up AS direction, round(value, 6) + 0.0 AS length FROM lg JOIN ends USING (session_id)"""


@register("npz_packets", NPZ_SQL)
def npz_packets(spark, sf_dir) -> DataFrame:
    """NPZ traces written whole and read as binary files."""
    return rounded6(logs.npz_packets(spark, sf_dir), "t", "length")


@register("trace_source_npz", NPZ_SQL)
def trace_source_npz(spark, sf_dir) -> DataFrame:
    """NPZ traces through the registered data source."""
    return rounded6(logs.npz_packets(spark, sf_dir, "source"), "t", "length")


@register("trace_source_lines", with_clause(sql.LOG_ROWS) + """
SELECT session_id, round(us * 1000 / 1e9 - u0 * 1000 / 1e9, 6) + 0.0 AS t, up AS direction, round(value, 6) + 0.0 AS length
FROM lg JOIN ends USING (session_id) WHERE us * 1000 / 1e9 - u0 * 1000 / 1e9 < 259200""")
def trace_source_lines(spark, sf_dir) -> DataFrame:
    """A3: line logs through the registered data source, cut into small splits, with the time filter pushed down."""
    return rounded6(logs.trace_log_packets(spark, sf_dir, 259_200.0), "t", "length")


# --- stored state: duplicate index and digest trees -----------------------------------------------------------------

@register("dup_groups_incremental", REGISTRY["dup_groups"][1])
def dup_groups_incremental(spark, sf_dir) -> DataFrame:
    """The duplicate groups of the documents, taken into the index in four batches."""
    folder = f"{ensure_checkpoint_dir(spark)}/duplicates-{uuid.uuid4().hex}"
    docs = cut_lineage(tables.document_keys(spark, sf_dir))
    batch = F.pmod(F.xxhash64("session_id"), F.lit(4))
    for version in range(4):
        dedup.add_batch(spark, docs.where(batch == version), folder, version)
    marked = dedup.minimum_sessions(dedup.indexed_groups(spark, docs, folder, 3), 11)
    return marked.select("session_id", "component", "reason")


@register("digest_tree", """
WITH lines AS (SELECT vec_id, vec_id % 4 AS k, label, (row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) - 1) * 64 AS place FROM embeddings),
hit AS (SELECT k, max(vec_id) FILTER (label = 3) AS vec_id FROM lines GROUP BY k)
SELECT 'vectors-' || k || '.txt' AS file, (place + length(vec_id::VARCHAR) + 1) // 4096 AS block, 'changed' AS problem FROM lines JOIN hit USING (k, vec_id)
UNION SELECT 'vectors-0.txt', (max(place) + 64) // 4096, CASE WHEN (max(place) + 64) % 4096 = 0 THEN 'added' ELSE 'changed' END FROM lines WHERE k = 0""")
def digest_tree(spark, sf_dir) -> DataFrame:
    """A stored copy of the embeddings' labels in which one character a file is changed and one file has grown, by file and block."""
    rows = tables.table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 4).alias("k"))
    hit = rows.where("label = 3").groupBy("k").agg(F.max("vec_id").alias("hit"))
    marked = rows.join(hit, "k", "left").withColumn("file", F.concat(F.lit("vectors-"), F.col("k").cast("string"), F.lit(".txt")))
    line = lambda label: F.rpad(F.concat_ws(",", "vec_id", label), 63, ".")
    root = f"{ensure_checkpoint_dir(spark)}/digests-{uuid.uuid4().hex}"
    tracefiles.write_named(marked.select("k", "vec_id", "file", line("label").alias("line")), f"{root}/stored", ["k"], ["vec_id"])
    other = marked.select("k", "vec_id", "file", line(F.when(F.col("vec_id") == F.col("hit"), "X").otherwise(F.col("label").cast("string"))).alias("line"))
    more = rows.where("k = 0").groupBy("k").agg((F.max("vec_id") + 1).alias("vec_id")).select("k", "vec_id", F.lit("vectors-0.txt").alias("file"), F.lit("one more").alias("line"))
    tracefiles.write_named(other.unionByName(more), f"{root}/found", ["k"], ["vec_id"])
    stored, found = (cut_lineage(digests.block_digests(spark, f"{root}/{name}", block_bytes=4096)) for name in ("stored", "found"))
    changed = digests.tree_digests(stored).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "digest").join(
        digests.tree_digests(found).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("digest").alias("other")), "file").where("digest <> other")
    return digests.damaged_blocks(stored, found).join(changed.select("file"), "file", "left_semi")


# --- second ways to the same numbers -------------------------------------------------------------------------------

def scored_labels(spark, sf_dir) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return tables.table(spark, sf_dir, "labels").join(docs, "doc_id").select((F.col("quality") == 1).alias("known"), F.col("n_chars").cast("double").alias("confidence"))


@register("auroc_by_merging", """
WITH s AS (SELECT quality = 1 AS known, n_chars::DOUBLE AS c FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)
SELECT round(avg(CASE WHEN a.c > b.c THEN 1 WHEN a.c = b.c THEN 0.5 ELSE 0 END), 6) + 0.0 AS auroc,
       (SELECT count(*) FILTER (known) FROM s) AS known_count, (SELECT count(*) FILTER (NOT known) FROM s) AS unknown_count
FROM s a JOIN s b ON a.known AND NOT b.known""")
def auroc_by_merging(spark, sf_dir) -> DataFrame:
    """AUROC by counting inversions; the SQL compares all pairs."""
    return metrics.auroc_by_merging(scored_labels(spark, sf_dir)).select(r6("auroc").alias("auroc"), "known_count", "unknown_count")


@register("pair_pma_sql", REGISTRY["pair_pma"][1])
def pair_pma_sql(spark, sf_dir) -> DataFrame:
    """F3, F7 from SQL alone: the table function over all pairs of every episode."""
    udtf.register(spark)
    vec = tables.vectors(spark, sf_dir)
    members = drawn(spark, sf_dir, CROSS_MODE)
    view = lambda df, name: df.createOrReplaceTempView(name)
    view(members.where("role = 'query'").select(*EPISODE, F.col("session_id").alias("query_id")), "episode_queries")
    view(members.where("role = 'support'").select(*EPISODE, F.col("session_id").alias("support_id"), "label"), "episode_supports")
    view(vec.select("session_id", "z", "v", "r"), "prints")
    return spark.sql("""
        WITH pairs AS (
          SELECT q.seed, q.scenario, q.partition, q.episode, q.query_id, s.support_id, s.label,
                 aggregate(zip_with(a.z, b.z, (x, y) -> x * y), 0D, (t, x) -> t + x) AS g, a.v AS q_v, a.r AS q_r, b.v AS s_v, b.r AS s_r
          FROM episode_queries q JOIN episode_supports s USING (seed, scenario, partition, episode)
               JOIN prints a ON a.session_id = q.query_id JOIN prints b ON b.session_id = s.support_id)
        SELECT cast(seed AS bigint) AS seed, scenario, partition, cast(episode AS bigint) AS episode, query_id, support_id, cast(label AS bigint) AS label,
               round(local, 6) + 0D AS local, round(overlap, 6) + 0D AS overlap, round(score, 6) + 0D AS score
        FROM align(TABLE(pairs) PARTITION BY (seed, scenario, partition, episode), 'pma')""")


@register("verify_altered_reports", with_clause(*REPORT_SQL) + """
, marked AS (SELECT *, row_number() OVER (ORDER BY seed, scenario) = 1 AS altered FROM rep)
SELECT seed::BIGINT AS seed, scenario, round(CASE WHEN altered THEN accuracy + 0.25 ELSE accuracy END, 6) + 0.0 AS accuracy, round(accuracy, 6) + 0.0 AS recomputed,
       NOT altered AS passed FROM marked""")
def verify_altered_reports(spark, sf_dir) -> DataFrame:
    """Reports of which the first is altered, against the records; only that one fails."""
    members = drawn(spark, sf_dir, REPORT_PARTS, SEEDS3)
    predicted = cut_lineage(matching.predictions(matching.prototype_scores(members, tables.vectors(spark, sf_dir), dim=64)))
    reported = metrics.accuracy_summary(metrics.episode_accuracy(predicted, members), ["seed", "scenario"])
    first = F.row_number().over(Window.orderBy("seed", "scenario")) == 1  # one row per report
    altered = reported.withColumn("accuracy", F.when(first, F.col("accuracy") + 0.25).otherwise(F.col("accuracy")))
    truth = members.where("role = 'query'").select(*EPISODE, F.col("session_id").alias("query_id"), F.col("label").alias("target"))
    out = metrics.verify_accuracy(predicted.join(truth, [*EPISODE, "query_id"]), altered, ["seed", "scenario"])
    return out.select(F.col("seed").cast("bigint"), "scenario", r6("accuracy").alias("accuracy"), r6("recomputed").alias("recomputed"), "passed")


@register("session_keys", """
WITH k AS (SELECT doc_id, lang, source, sha256('["' || lang || '","' || source || '"]') AS d, sha256('[20260817,"' || source || '","' || doc_id || '"]') AS s FROM documents)
SELECT doc_id, substr(d, 1, 24) AS session_key, ('0x' || substr(s, 1, 8))::BIGINT AS seed FROM k""")
def session_keys(spark, sf_dir) -> DataFrame:
    """Canonical keys of (dataset, source) and seeds derived per document."""
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", hashing.session_key(F.col("lang"), F.col("source")).alias("session_key"),
                       hashing.seed_from(SEED, F.col("source"), F.col("doc_id").cast("string")).alias("seed"))


@register("audit_damaged", with_clause(sql.EVENT_ROWS, DOC_KEYS, sql.VECTORS, sql.members(ALL_SCENARIOS, [SEED])) + """
, bad AS (
  SELECT seed, scenario, partition, episode, role, CASE WHEN episode % 6 = 0 AND role = 'support' AND label = 0 THEN identity + 1 ELSE identity END AS identity, label,
         CASE WHEN episode % 6 = 1 AND role = 'query' THEN -session_id - 1 WHEN episode % 6 = 4 THEN session_id + 1 ELSE session_id END AS session_id FROM mem
  UNION ALL SELECT seed, scenario, partition, episode, CASE WHEN episode % 6 = 2 THEN 'query' ELSE role END, identity, label, session_id
            FROM mem WHERE role = 'support' AND episode % 6 IN (2, 3)),
stay AS (SELECT exact, near FROM dk JOIN final USING (doc_id) WHERE reason IS NULL OR doc_id % 2 = 0),
sig AS (SELECT 0 AS kind, exact AS signature FROM stay UNION ALL SELECT 1, near FROM stay),
raw AS (SELECT 0 AS kind, exact AS signature FROM dk UNION ALL SELECT 1, near FROM dk),
e AS (SELECT bad.*, vec.identity AS ti, vec.mode, vec.condition, sm, qm, sc, qc FROM bad JOIN vec USING (session_id)
      JOIN spec ON (spec.scenario, spec.partition) = (bad.scenario, bad.partition)),
s AS (SELECT seed, scenario, partition, episode, session_id, count(*) AS n, count(DISTINCT role) AS roles FROM bad GROUP BY ALL)
SELECT 'signatures_before' AS "check", (SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY kind, signature HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'signatures_after', (SELECT count(*) FROM (SELECT 1 FROM sig GROUP BY kind, signature HAVING count(*) > 1))
UNION ALL SELECT 'block_leaks', (SELECT count(*) FROM (SELECT identity FROM ev GROUP BY 1 HAVING min(block) <> max(block)))
UNION ALL SELECT 'unknown_session', (SELECT count(*) FROM bad WHERE session_id NOT IN (SELECT session_id FROM vec))
UNION ALL SELECT 'identity_mismatch', (SELECT count(*) FROM bad JOIN vec USING (session_id) WHERE bad.identity <> vec.identity)
UNION ALL SELECT 'role_overlap', (SELECT count(*) FROM s WHERE roles > 1)
UNION ALL SELECT 'repeated_record', (SELECT count(*) FROM s WHERE roles = 1 AND n > 1)
UNION ALL SELECT 'label_conflict', (SELECT count(*) FROM (SELECT 1 FROM bad GROUP BY seed, scenario, partition, episode, label HAVING count(DISTINCT identity) > 1))
UNION ALL SELECT 'mode_mismatch', (SELECT count(*) FROM e WHERE CASE role WHEN 'support' THEN mode <> sm ELSE mode <> qm END)
UNION ALL SELECT 'condition_mismatch', (SELECT count(*) FROM e WHERE CASE role WHEN 'support' THEN condition <> sc ELSE condition <> qc END)""")
def audit_damaged(spark, sf_dir) -> DataFrame:
    """All checks over every scenario of the catalogue, with episodes and documents damaged so that each check finds something."""
    documents = marked_documents(spark, sf_dir)
    blocks = tables.event_sessions(spark, sf_dir).withColumn("split", F.col("block").cast("string"))
    members = drawn(spark, sf_dir, ALL_SCENARIOS)
    turn, support = F.col("episode") % 6, F.col("role") == "support"
    changed = members.withColumns({
        "identity": F.when((turn == 0) & support & (F.col("label") == 0), F.col("identity") + 1).otherwise(F.col("identity")),
        "session_id": F.when((turn == 1) & ~support, -F.col("session_id") - 1).when(turn == 4, F.col("session_id") + 1).otherwise(F.col("session_id"))})
    more = members.where(support & turn.isin(2, 3)).withColumn("role", F.when(turn == 2, "query").otherwise(F.col("role")))
    checks = {"signatures_before": audit.repeated_signatures(documents),
              "signatures_after": audit.repeated_signatures(documents.where("reason is null or session_id % 2 = 0")), "block_leaks": audit.split_leaks(blocks)}
    checks.update(audit.episode_violations(cut_lineage(changed.unionByName(more)), tables.vector_sessions(spark, sf_dir), ALL_SCENARIOS))
    return audit.audit_report(checks)


@register("audit_summary", with_clause(sql.VECTORS, sql.members(ALL_SCENARIOS, [SEED]), sql.split_ctes(SEED, "vec")) + """
, s AS (SELECT vec.session_id, vec.identity, mode, split FROM vec JOIN split USING (identity))
SELECT 'identities' AS item, split AS key, count(DISTINCT identity) AS value FROM s GROUP BY ALL
UNION ALL SELECT 'mode', mode, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'episodes', scenario, count(*) FROM (SELECT DISTINCT seed, scenario, episode FROM mem) GROUP BY ALL""")
def audit_summary(spark, sf_dir) -> DataFrame:
    """What an audit covered: identities per split, sessions per mode, episodes per scenario."""
    sessions = cut_lineage(tables.vector_sessions(spark, sf_dir))
    split = sampling.identity_split(sessions, SEED)
    return audit.audit_summary(sessions.join(split, "identity"), drawn(spark, sf_dir, ALL_SCENARIOS))


# --- report files ----------------------------------------------------------------------------------------------------

REPORT_RUNS = """
WITH runs AS (SELECT label, seed, 'run-' || label || '-' || seed AS run, round(avg((embedding[seed + 1] > 0)::INT), 6) AS accuracy,
                     CASE WHEN label % 2 = 0 THEN 'amp' ELSE 'protonet' END AS kind FROM embeddings, range(3) t(seed) GROUP BY label, seed),
keyed AS (SELECT *, sha256('matching.alignment="pma";matching.gamma=0.' || (label + 1) || ';model.kind="' || kind
                           || '";training.epochs=5;training.rates[0]=0.5;training.rates[1].x=null') AS config_hash FROM runs),
told AS (SELECT *, CASE WHEN label >= 7 THEN 'missing' WHEN label = 6 THEN 'mismatch' ELSE 'ok' END AS status FROM keyed)"""


def report_files(spark, sf_dir) -> DataFrame:
    rows = cut_lineage(reports.report_rows(reports.read_documents(spark, logs.report_folder(spark, sf_dir))))
    return rows.withColumn("run", F.regexp_extract("path", r"(run-\d+-\d+)\.json$", 1))


@register("report_status", REPORT_RUNS + """
SELECT run, status, CASE WHEN status = 'ok' THEN config_hash END AS config_hash,
       CASE WHEN status = 'ok' THEN CASE kind WHEN 'amp' THEN 'AMP + PMA' ELSE 'ProtoNet' END END AS method,
       CASE WHEN status = 'ok' THEN accuracy + 0.0 END AS accuracy, label % 3 = 0 AND status = 'ok' AS selected FROM told""")
def report_status(spark, sf_dir) -> DataFrame:
    """Report files against the expected runs: matching, mismatching and missing ones, and a selection by analysis."""
    found = report_files(spark, sf_dir)
    expected = tables.table(spark, sf_dir, "embeddings").select("label").distinct().select("label", F.explode(F.array(*map(F.lit, range(3)))).alias("seed"))
    gamma = F.when(F.col("label") == 6, F.lit("9")).otherwise((F.col("label") + 1).cast("string"))  # the matrix wants another gamma for label 6
    kind = F.when(F.col("label") % 2 == 0, "amp").otherwise("protonet")
    settings = F.concat(F.lit('{"training":{"rates":[0.5,{"x":null}],"epochs":5},"model":{"kind":"'), kind, F.lit('"},"matching":{"alignment":"pma","gamma":0.'), gamma, F.lit("}}"))
    matrix = expected.select(F.concat(F.lit("run-"), F.col("label").cast("string"), F.lit("-"), F.col("seed").cast("string")).alias("run"),
                             F.when(F.col("label") % 3 == 0, F.array(F.lit("main"), F.lit("extra"))).otherwise(F.array(F.lit("extra"))).alias("analyses"),
                             F.parse_json(settings).alias("config"))
    matrix = cut_lineage(matrix)
    wanted = matrix.select("run", "analyses").join(reports.configuration_keys(matrix, "run", "config"), "run")
    good, wrong, missing = reporting.checked_reports(found, wanted)
    chosen = reporting.select_runs(good.join(wanted.select("run", "analyses"), "run"), analyses=["main"]).select("run", F.lit(True).alias("selected"))
    named = good.select("run", F.lit("ok").alias("status"), "config_hash", reporting.display_method().alias("method"), r6("accuracy").alias("accuracy"))
    blank = lambda df, status: df.select("run", F.lit(status).alias("status"), *[F.lit(None).cast(t).alias(c) for c, t in
                                                                                 (("config_hash", "string"), ("method", "string"), ("accuracy", "double"))])
    rows = named.unionByName(blank(wrong, "mismatch")).unionByName(blank(missing, "missing"))
    return rows.join(chosen, "run", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


@register("report_groups", REPORT_RUNS + """
SELECT config_hash, count(*) AS seeds, round(100 * avg(accuracy), 6) + 0.0 AS mean_percent, round(100 * stddev_samp(accuracy), 6) + 0.0 AS sample_std_percent,
       true AS complete FROM told WHERE label < 7 GROUP BY ALL""")
def report_groups(spark, sf_dir) -> DataFrame:
    """Report files grouped by their settings over seeds, whatever the order of keys in the file."""
    out = reporting.seed_summary(report_files(spark, sf_dir), ["config_hash"])
    return out.select("config_hash", "seeds", r6("mean_percent").alias("mean_percent"), r6("sample_std_percent").alias("sample_std_percent"), "complete")


# --- bins from a stream ------------------------------------------------------------------------------------------

def streamed_bins(spark, sf_dir) -> DataFrame:
    """Events in five arrivals by time, the second one late, with a restart after every one; sessions reach over the cuts."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = tables.packets(spark, sf_dir).withColumn("day", (F.col("block") * tables.BLOCK_SECONDS + F.col("t")) / 86_400)
    micros = F.round((F.col("block") * tables.BLOCK_SECONDS + F.col("t")) * 1_000_000).cast("bigint")
    told = rows.select("session_id", F.timestamp_micros(micros).alias("event_time"), ((F.col("block") + 1) * tables.BLOCK_SECONDS * 1000).alias("ends"),
                       "t", "direction", "length", "day")
    cuts = [-math.inf, 9.0, 15.0, 21.0, 27.0, math.inf]
    for part in (0, 2, 1, 3, 4):
        arrived = told.where((F.col("day") >= F.lit(cuts[part])) & (F.col("day") < F.lit(cuts[part + 1]))).drop("day")
        arrived.write.mode("append").parquet(f"{root}/incoming")
        stream = spark.readStream.schema(arrived.schema).parquet(f"{root}/incoming")
        streaming.run_available(spark, stream, EVENT_DATA, f"{root}/bins", f"{root}/checkpoint", "13 days")
    return streaming.latest_bins(spark, f"{root}/bins")


@register("stream_bins", REGISTRY["bin_features"][1])
def stream_bins(spark, sf_dir) -> DataFrame:
    """Dense bins of every session from a stream with late packets and restarts."""
    dense = streaming.dense_bins(streamed_bins(spark, sf_dir), EVENT_DATA)
    return dense.select("session_id", "scale", "bin", r6("c0").alias("c0"), r6("c1").alias("c1"), "c2", "c3", r6("c4").alias("c4"), "mask")


@register("stream_fingerprint_prefix", REGISTRY["session_fingerprint_prefix"][1])
def stream_fingerprint_prefix(spark, sf_dir) -> DataFrame:
    """Prefix fingerprints from the streamed bins."""
    seen = cut_lineage(streamed_bins(spark, sf_dir))
    part = streaming.prefix_bins(seen, EVENT_DATA, HALF, 86_400.0)
    return fingerprint_rows(features.fingerprints(seen, event_stats(spark, sf_dir), EVENT_DATA, until=HALF, start=86_400.0, bins=part))


@register("nearest_class", with_clause(sql.VECTORS, """
pr AS (SELECT a.session_id AS query_id, b.session_id AS support_id, b.identity AS label, list_dot_product(a.z, b.z) AS g, a.v AS qv, b.v AS sv
       FROM vec a, vec b WHERE a.session_id % 20 = 0 AND b.session_id % 20 <> 0)""", sql.pma_ctes(8, 8)) + """
, top AS (SELECT query_id, label, max(score) AS candidate FROM pma GROUP BY ALL)
SELECT query_id, arg_max(label, (round(candidate, 9), -label)) AS label, round(max(candidate), 6) + 0.0 AS confidence, true AS below_half FROM top GROUP BY ALL""")
def nearest_class(spark, sf_dir) -> DataFrame:
    """Nearest class of every twentieth embedding among all others, with fewer than half of the pairs aligned."""
    vec = tables.vectors(spark, sf_dir)
    found = search.nearest_class(vec.where("session_id % 20 = 0"), vec.where("session_id % 20 <> 0").withColumnRenamed("identity", "label"), MatchConfig())
    found = cut_lineage(found)
    saved = found.agg((F.sum("aligned") * 2 < F.sum("pairs")).alias("below_half"))  # one row
    return found.crossJoin(saved).select("query_id", "label", r6("confidence").alias("confidence"), "below_half")
