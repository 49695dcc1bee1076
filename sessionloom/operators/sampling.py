"""Identity splits, episodes and open-set partitions as seeded draws of ranks.

Nothing here explodes sessions by episode: sessions are ranked once per pool, each episode draws a handful of rank
numbers, and one equi-join fetches the drawn sessions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import distinct_draws, hash_text
from ..functions.ranking import rank_by_digest
from ..runtime import require_empty

MODES = ("L", "T", "H")


@dataclass(frozen=True)
class EpisodePart:
    """``count`` episodes of ``ways`` identities with filters on either role."""

    scenario: str
    partition: int
    count: int
    ways: int
    shots: int
    queries: int
    support_mode: str | None = None
    query_mode: str | None = None
    support_condition: str | None = None
    query_condition: str | None = None
    balanced: bool = False


def scenario_catalogue(kind: str, heldout: str | None = None, condition_matrix: bool = False) -> list[EpisodePart]:
    """The fixed evaluation scenarios (E4): ``shaped`` has four conditions, ``native`` has one."""
    if kind == "native":
        return [EpisodePart("random_mixed", 0, 300, 10, 5, 5),
                EpisodePart("T_to_H", 0, 500, 6, 5, 5, support_mode="T", query_mode="H"),
                EpisodePart("H_to_T", 0, 500, 6, 5, 5, support_mode="H", query_mode="T")]
    if kind != "shaped":
        raise ValueError(f"unknown dataset kind {kind}")
    if heldout:
        return [EpisodePart(f"heldout_{heldout}", 0, 300, 5, 2, 2, support_condition=heldout,
                            query_condition=heldout)]
    parts = []
    directed = [(a, b) for a in MODES for b in MODES if a != b]
    parts += [EpisodePart("cross_mode", i, 50, 5, 2, 2, support_mode=a, query_mode=b)
              for i, (a, b) in enumerate(directed)]
    parts += [EpisodePart("same_mode", i, 100, 5, 2, 2, support_mode=m, query_mode=m) for i, m in enumerate(MODES)]
    parts.append(EpisodePart("mode_balanced", 0, 300, 5, 3, 3, balanced=True))
    parts.append(EpisodePart("random_mixed", 0, 300, 5, 5, 5))
    shifts = [("bw1", "bw8"), ("bw8", "bw1"), ("bw1", "bw2"), ("bw2", "bw1")]
    parts += [EpisodePart("cross_bandwidth", i, 75, 5, 2, 2, support_condition=a, query_condition=b)
              for i, (a, b) in enumerate(shifts)]
    if condition_matrix:
        levels = (1, 2, 4, 8)
        parts += [EpisodePart(f"bandwidth_{a}_to_{b}", 0, 300, 5, 2, 2, support_condition=f"bw{a}",
                              query_condition=f"bw{b}") for a in levels for b in levels]
    return parts


def identity_split(sessions: DataFrame, seed: int, counts: tuple[int, int, int] | None = None) -> DataFrame:
    """(identity, split): seeded permutation cut into train/validation/test.

    With ``counts`` the identity total must match exactly; otherwise half go to train and a fifth to validation.
    """
    identities = sessions.select("identity").distinct()
    ranked = rank_by_digest(identities.withColumn("_h", hash_text(seed, F.col("identity"))), [], "_h", "_rank")
    if counts is not None:
        if len(counts) != 3 or counts[0] < 1 or min(counts) < 0:
            raise ValueError("split counts need a positive train count and no negative count")
        found = identities.count()
        if found != sum(counts):
            raise ValueError(f"expected {sum(counts)} identities, found {found}")
        train, validation = F.lit(counts[0]), F.lit(counts[1])
    else:
        # The total is a single row, so this broadcast has a fixed size.
        total = identities.agg(F.count("*").alias("_total"))
        ranked = ranked.join(F.broadcast(total))
        train = F.greatest(F.lit(1), F.floor(F.col("_total") / 2))
        validation = F.floor(F.col("_total") / 5)
    split = (F.when(F.col("_rank") < train, "train")
             .when(F.col("_rank") < train + validation, "validation").otherwise("test"))
    return ranked.select("identity", split.alias("split"))


def _part_frame(spark: SparkSession, parts: list[EpisodePart]) -> DataFrame:
    """The scenario list as rows; its size is that of the catalogue."""
    rows, first = [], {}
    quote = lambda v: "cast(null as string)" if v is None else f"'{v}'"
    for number, p in enumerate(parts):
        filters = ", ".join(quote(v) for v in (p.support_mode, p.query_mode, p.support_condition, p.query_condition))
        rows.append(f"({number}, '{p.scenario}', {p.partition}, {p.count}, {p.ways}, {p.shots}, {p.queries}, {filters}, "
                    f"{str(p.balanced).lower()}, {first.get(p.scenario, 0)})")
        first[p.scenario] = first.get(p.scenario, 0) + p.count
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(part, scenario, partition, count, ways, shots, queries, "
                     "support_mode, query_mode, support_condition, query_condition, balanced, first_episode)")


def _pools(sessions: DataFrame, parts: list[EpisodePart]) -> DataFrame:
    """(part, identity, pool, only, session_id): each session in every pool it can be drawn from.

    Pools: ``a`` holds the support candidates, those that may also be queries first; ``b`` the query-only rows;
    balanced parts have one pool per mode.
    """
    def matches(mode, condition):
        test = F.lit(True)
        if mode is not None:
            test = test & (F.col("mode") == mode)
        if condition is not None:
            test = test & (F.col("condition") == condition)
        return test

    options = []
    for number, p in enumerate(parts):
        if p.balanced:
            pool, shared, keep = F.col("mode"), F.lit("0"), F.col("mode").isin(*MODES)
        else:
            in_a, in_b = matches(p.support_mode, p.support_condition), matches(p.query_mode, p.query_condition)
            pool = F.when(in_a, "a").otherwise("b")
            shared = F.when(in_a & ~in_b, "1").otherwise("0")
            keep = in_a | in_b
        options.append(F.when(keep, F.struct(F.lit(number).alias("part"), pool.alias("pool"), shared.alias("only"))))
    exploded = sessions.select("session_id", "identity", F.explode(F.array_compact(F.array(*options))).alias("o"))
    return exploded.select("session_id", "identity", "o.part", "o.pool", "o.only")


def _placed(pools: DataFrame) -> DataFrame:
    """Pool rows with their position in the pool; support candidates that may be queries come first."""
    keyed = pools.withColumn("_h", F.concat("only", hash_text(F.col("session_id"))))
    # The flag takes the first digit, so one more keeps 256 splits per flag.
    return rank_by_digest(keyed, ["part", "identity", "pool"], "_h", "place", digits=3).drop("_h")


def _pool_sizes(pools: DataFrame) -> DataFrame:
    size = lambda test: F.sum(F.when(test, 1).otherwise(0)).cast("bigint")
    return pools.groupBy("part", "identity").agg(
        size(F.col("pool") == "a").alias("n_a"), size(F.col("pool") == "b").alias("n_b"),
        size((F.col("pool") == "a") & (F.col("only") == "0")).alias("n_ab"),
        *[size(F.col("pool") == m).alias(f"n_{m}") for m in MODES])


def _eligible(sizes: DataFrame, spec: DataFrame) -> DataFrame:
    """Identities with enough rows for a part."""
    # The catalogue is a handful of literal rows.
    joined = sizes.join(F.broadcast(spec), "part")
    plain = ((F.col("n_a") >= F.col("shots")) & (F.col("n_ab") + F.col("n_b") >= F.col("queries")) &
             (F.col("n_a") + F.col("n_b") >= F.col("shots") + F.col("queries")))
    by_mode = F.least(*[F.col(f"n_{m}") for m in MODES]) >= 2
    return joined.where(F.when(F.col("balanced"), by_mode).otherwise(plain))


def ineligible_parts(sessions: DataFrame, parts: list[EpisodePart]) -> DataFrame:
    """Parts with fewer eligible identities than ways."""
    spec = _part_frame(sessions.sparkSession, parts)
    found = _eligible(_pool_sizes(_pools(sessions, parts)), spec).groupBy("part").agg(F.count("*").alias("eligible"))
    return (F.broadcast(spec).join(found, "part", "left")
            .where(F.coalesce(F.col("eligible"), F.lit(0)) < F.col("ways"))
            .select("scenario", "partition", "ways", F.coalesce("eligible", F.lit(0)).alias("eligible")))


def episode_members(sessions: DataFrame, parts: list[EpisodePart], seeds=(20260817,), strict: bool = True) -> DataFrame:
    """Episode rows (seed, scenario, partition, episode, role, identity, label, place, session_id).

    ``sessions`` has session_id, identity, mode, condition and is already restricted to one split. Queries are drawn
    before supports and use query-only rows first; supports come from what is left. A part with fewer eligible identities
    than ways is an error; with ``strict=False`` it has no rows.
    """
    spark = sessions.sparkSession
    if strict:
        require_empty(ineligible_parts(sessions, parts), "too few eligible identities")
    spec = _part_frame(spark, parts)
    pools = _pools(sessions, parts)
    eligible = _eligible(_pool_sizes(pools), spec)
    ranked = rank_by_digest(eligible.withColumn("_h", hash_text("identity", F.col("identity"))), ["part"], "_h",
                            "id_place").drop("_h")
    totals = eligible.groupBy("part").agg(F.count("*").alias("n_ids"))
    seeded = spec.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    episodes = (seeded.select("part", "scenario", "partition", "ways", "seed", "first_episode",
                              F.explode(F.expr("sequence(0, count - 1)")).alias("local"))
                .withColumn("episode", F.col("first_episode") + F.col("local"))
                .withColumn("key", F.concat_ws("|", "seed", "scenario", "partition", "local"))
                # One row per catalogue part.
                .join(F.broadcast(totals), "part"))
    drawn = (episodes.withColumn("ids", distinct_draws("n_ids", "ways", "concat(key, '|identity')"))
             .select("part", "seed", "scenario", "partition", "episode", "key",
                     F.posexplode("ids").alias("label", "id_place"))
             .join(ranked.select("part", "identity", "id_place", "shots", "queries", "balanced", "n_a", "n_b", "n_ab",
                                 *[f"n_{m}" for m in MODES]), ["part", "id_place"])
             .withColumn("key", F.concat_ws("|", "key", "identity")))
    keep = ["part", "seed", "scenario", "partition", "episode", "label", "identity"]
    plain, balanced = _plain_picks(drawn), _balanced_picks()
    wanted = (plain.select(*keep, F.explode(F.when(F.col("balanced"), balanced).otherwise(F.col("picks"))).alias("p"))
              .select(*keep, "p.role", "p.pool", F.explode("p.places").alias("place")))
    return (wanted.join(_placed(pools).select("part", "identity", "pool", "place", "session_id"),
                        ["part", "identity", "pool", "place"])
            .select("seed", "scenario", "partition", "episode", "role", "identity", "label", "session_id"))


def _pick(role: str, pool: str, places) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(pool).alias("pool"), places.alias("places"))


def _plain_picks(drawn: DataFrame) -> DataFrame:
    first = "least(n_b, cast(queries as bigint))"
    staged = (drawn.withColumn("q_only", distinct_draws("n_b", first, "concat(key, '|query')"))
              .withColumn("q_shared", distinct_draws("n_ab", f"if(balanced, 0, queries - {first})", "concat(key, '|shared')"))
              .withColumn("s_places", distinct_draws("n_a", "if(balanced, 0, shots)", "concat(key, '|support')", "q_shared")))
    return staged.withColumn("picks", F.array(_pick("query", "b", F.col("q_only")), _pick("query", "a", F.col("q_shared")),
                                              _pick("support", "a", F.col("s_places"))))


def _balanced_picks() -> Column:
    """Two rows per mode: the first is a support, the second a query."""
    picks = []
    for m in MODES:
        two = distinct_draws(f"n_{m}", "if(balanced, 2, 0)", f"concat(key, '|{m}')")
        picks += [_pick(role, m, F.slice(two, position, 1)) for role, position in (("support", 1), ("query", 2))]
    return F.array(*picks)


def protocol_manifest(members: DataFrame) -> DataFrame:
    """Episode and row counts per scenario."""
    per_episode = members.groupBy("seed", "scenario", "episode").agg(
        F.sum(F.when(F.col("role") == "support", 1).otherwise(0)).alias("s"),
        F.sum(F.when(F.col("role") == "query", 1).otherwise(0)).alias("q"))
    return per_episode.groupBy("seed", "scenario").agg(
        F.count("*").alias("episodes"), F.sum("s").alias("supports"), F.sum("q").alias("queries"))


def open_partitions(sessions: DataFrame, partitions: int = 5, known: int = 15, gallery: int = 5,
                    seed: int = 20260817) -> DataFrame:
    """(partition, identity, known, role, label, session_id): known/unknown identities, gallery and queries.

    Known labels follow the sorted identity order; unknown queries carry -1.
    """
    spark = sessions.sparkSession
    parts = spark.range(partitions).select(F.col("id").cast("int").alias("partition"))
    ids = sessions.groupBy("identity").agg(F.count("*").alias("n"))
    spread = ids.withColumn("partition", F.explode(F.array(*[F.lit(i) for i in range(partitions)])))
    spread = spread.withColumn("_h", hash_text(seed, "open", F.col("partition"), F.col("identity")))
    placed = rank_by_digest(spread, ["partition"], "_h", "_place")
    labelled = placed.withColumn("known", F.col("_place") < known).drop("_place", "_h")
    # At most partitions x known rows are labelled, whatever the cohort size.
    by_name = labelled.where("known").groupBy("partition").agg(F.sort_array(F.collect_list("identity")).alias("names"))
    labelled = (labelled.join(F.broadcast(by_name), "partition")
                .withColumn("label", F.when(F.col("known"), F.array_position("names", F.col("identity")) - 1)
                            .otherwise(F.lit(-1)).cast("int"))
                .drop("names")
                .withColumn("key", F.concat_ws("|", F.lit(str(seed)), F.lit("gallery"), "partition", "identity"))
                .withColumn("places", F.when(F.col("known"), distinct_draws("n", str(gallery), "key"))
                            .otherwise(F.expr("cast(array() as array<bigint>)"))))
    ranked = rank_by_digest(sessions.select("session_id", "identity").withColumn("_h", hash_text(F.col("session_id"))),
                            ["identity"], "_h", "place")
    joined = ranked.join(labelled, "identity")
    role = F.when(F.array_contains("places", F.col("place")), "support").otherwise("query")
    return joined.select("partition", "identity", "known", role.alias("role"), "label", "session_id")


def select_windows(valid: DataFrame, keys: list[str], take: int = 3, seed: int = 20260817) -> tuple[DataFrame, DataFrame]:
    """``take`` seeded rows per key and the keys with too few valid rows."""
    counts = valid.groupBy(*keys).agg(F.count("*").alias("n"))
    short = counts.where(F.col("n") < take)
    key = F.concat_ws("|", F.lit(str(seed)), *keys)
    draws = (counts.where(F.col("n") >= take).withColumn("key", key)
             .withColumn("places", distinct_draws("n", str(take), "key"))
             .select(*keys, F.posexplode("places").alias("slot", "place")))
    ranked = rank_by_digest(valid.withColumn("_h", hash_text(F.col("session_id"))), keys, "_h", "place").drop("_h")
    return ranked.join(draws, [*keys, "place"]).drop("place"), short
