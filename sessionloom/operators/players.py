"""Player step series sampled at fixed times, session mode features and the delivery frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stepping import carry_last, carry_sum, finite

# State names that start and stop playback, and the one marking a finished seek.
PLAYING = ("playbackPlaying", "playbackStarted")
STOPPED = ("playbackWaiting", "playbackPaused", "playbackEnded", "playbackStalled", "playbackSeeking")
SEEKED = "playbackSeeked"


def sample_steps(series: DataFrame, sessions: DataFrame, columns: dict[str, float | None], step: float = 2.0,
                 count: int = 30, max_initial_gap: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Backward as-of samples at the centres of ``count`` steps, and the sessions refused.

    ``series`` has session_id, t, seq and value columns; nulls are absent observations, later rows win ties. Before
    its first observation a column takes its constant from ``columns``; with None it takes its first value instead,
    provided that is at most ``max_initial_gap`` after the first target. Non-finite or missing series are refused.
    """
    first_target = step / 2
    facts = series.groupBy("session_id").agg(*[e for c in columns for e in (
        F.sum(F.when(F.col(c).isNotNull() & ~finite(F.col(c)), 1).otherwise(0)).alias(f"_bad_{c}"),
        F.min(F.when(F.col(c).isNotNull(), F.struct("t", "seq", F.col(c).alias("v")))).alias(f"_first_{c}"))])
    known = sessions.select("session_id").join(facts, "session_id", "left")
    refuse = F.lit(False)
    for c, initial in columns.items():
        refuse = refuse | F.col(f"_first_{c}").isNull() | (F.col(f"_bad_{c}") > 0)
        if initial is None:
            refuse = refuse | (F.col(f"_first_{c}.t") - F.lit(first_target) > F.lit(max_initial_gap))
    marked = known.withColumn("_refuse", F.coalesce(refuse, F.lit(True)))
    rejected = marked.where("_refuse").select("session_id", F.lit("missing_player_observations").alias("reason"))
    targets = (marked.where("not _refuse").drop("_refuse")
               .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
               .withColumn("t", (F.col("k") + 0.5) * F.lit(step)).withColumn("kind", F.lit(1))
               .withColumn("seq", F.lit(0).cast(series.schema["seq"].dataType)))
    # Observations at the target time count, so events sort before targets.
    events = series.select("session_id", "t", "seq", *columns).withColumn("kind", F.lit(0))
    merged = events.unionByName(targets, allowMissingColumns=True)
    carried = carry_last(merged, ["session_id"], "t", ["kind", "seq"], {c: f"_s_{c}" for c in columns},
                         width=step * count / 8).where("kind = 1")
    values = [F.coalesce(F.col(f"_s_{c}"), F.col(f"_first_{c}.v") if initial is None else F.lit(float(initial))).alias(c)
              for c, initial in columns.items()]
    return carried.select("session_id", "k", "t", *values), rejected


def _arrays(samples: DataFrame, columns: list[str]) -> DataFrame:
    """One row per session with its samples as arrays in target order; ``count`` entries each."""
    packed = samples.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("k", *columns))).alias("_p"))
    return packed.selectExpr("session_id", *[f"transform(_p, x -> x.{c}) AS {c}" for c in columns])


def _mean(expression: str, array: str) -> str:
    return f"aggregate(transform({array}, x -> {expression}), 0D, (s, x) -> s + x) / size({array})"


def _switch(array: str) -> str:
    return (f"aggregate(sequence(2, size({array})), 0D, (s, i) -> s + if({array}[i - 1] <> {array}[i - 2], 1D, 0D)) "
            f"/ (size({array}) - 1)")


def _deviation(array: str) -> str:
    mean = f"(aggregate({array}, 0D, (s, x) -> s + x) / size({array}))"
    return f"sqrt(aggregate({array}, 0D, (s, x) -> s + pow(x - {mean}, 2)) / size({array}))"


def _quantile(array: str, q: float) -> str:
    """Linear interpolation between the order statistics of a short array."""
    at = f"((size({array}) - 1) * {q}D)"
    low, high = f"array_sort({array})[cast(floor({at}) AS int)]", f"array_sort({array})[cast(ceil({at}) AS int)]"
    return f"({low} + ({high} - {low}) * ({at} - floor({at})))"


def bitrate_mode_features(samples: DataFrame, column: str = "quality") -> DataFrame:
    """(session_id, mode_features): log1p trajectory, mean, deviation, first, last, switch rate, low share, late deviation."""
    rows = _arrays(samples, [column]).selectExpr("session_id", f"transform({column}, x -> log1p(x)) AS q")
    tail = "slice(q, greatest(size(q) - 4, 1), 5)"
    low = f"aggregate(q, 0D, (s, x) -> s + if(x <= {_quantile('q', 0.25)}, 1D, 0D)) / size(q)"
    return rows.selectExpr("session_id", f"concat(q, array({_mean('x', 'q')}, {_deviation('q')}, q[0], q[size(q) - 1], "
                                         f"{_switch('q')}, {low}, {_deviation(tail)})) AS mode_features")


def playback_mode_features(samples: DataFrame) -> DataFrame:
    """(session_id, mode_features): stall share, empty-buffer share, median and late buffer, state share, low-quality
    share, mean log quality, switch rate (C7). Columns: quality, buffer, stalled, state."""
    rows = _arrays(samples, ["quality", "buffer", "stalled", "state"])
    tail = "slice(buffer, greatest(size(buffer) - 4, 1), 5)"
    return rows.selectExpr("session_id", "array(" + ", ".join([
        _mean("x", "stalled"), _mean("if(x < 1, 1D, 0D)", "buffer"), _quantile("buffer", 0.5), _mean("x", tail),
        _mean("x", "state"), _mean("if(x <= 360, 1D, 0D)", "quality"), _mean("log1p(x)", "quality"), _switch("quality")])
        + ") AS mode_features")


def delivery_frontier(sessions: DataFrame, states: DataFrame, rates: DataFrame, buffers: DataFrame, targets: list[float],
                      max_gap: float = 4.0, bucket: float = 15.0) -> DataFrame:
    """One row per session: ``reason`` it is refused (or null) and its ``frontier`` at the targets.

    Playback position is the running integral of rate x playing; one finished seek within two units of progress resets
    it to the start. The buffered amount as of each target (at most ``max_gap`` old) is added and the curve made
    monotone. States: session_id, t, seq, name; rates and buffers: session_id, t, seq, value; sessions: session_id, offset.
    """
    ordered = sorted(float(x) for x in targets)
    last_target = F.lit(ordered[-1])
    playing = F.when(F.col("name").isin(*PLAYING), 1.0).when(F.col("name").isin(*STOPPED), 0.0)
    grid = sessions.select("session_id", F.coalesce(F.col("offset").cast("double"), F.lit(0.0)).alias("offset"),
                           F.posexplode(F.array(*[F.lit(x) for x in ordered])).alias("k", "t")).select(
        "session_id", "t", F.col("k").cast("bigint").alias("seq"), F.lit(3).alias("kind"), "offset")
    # At equal times rates apply before states, and both before buffers and targets.
    merged = (rates.select("session_id", "t", "seq", F.lit(0).alias("kind"), F.col("value").alias("rate"))
              .unionByName(states.select("session_id", "t", "seq", F.lit(1).alias("kind"), playing.alias("playing"),
                                         (F.col("name") == SEEKED).alias("seek")), allowMissingColumns=True)
              .unionByName(buffers.select("session_id", "t", "seq", F.lit(2).alias("kind"), F.col("value").alias("buffer"),
                                          F.col("t").alias("buffer_t")), allowMissingColumns=True)
              .unionByName(grid, allowMissingColumns=True).withColumn("own_t", F.col("t")))
    order = ["kind", "seq"]
    held = carry_last(merged, ["session_id"], "t", order, {"rate": "seen_rate", "buffer": "seen_buffer", "buffer_t": "seen_buffer_t"},
                      bucket, before={"own_t": "past_t", "rate": "past_rate", "playing": "past_playing"})
    moved = (F.col("t") - F.col("past_t")) * F.coalesce("past_rate", F.lit(1.0)) * F.coalesce("past_playing", F.lit(0.0))
    summed = carry_sum(held.withColumn("step", F.coalesce(moved, F.lit(0.0))), ["session_id"], "t", order, "step", "progress", bucket)

    used = F.col("t") <= last_target
    legal = F.coalesce((F.col("rate") >= 0) & (F.col("rate") <= 4), F.lit(False))
    of_kind = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    point = F.struct(F.col("seq").alias("k"), F.col("t").alias("target"), "progress", "seen_rate", "seen_buffer", "seen_buffer_t")
    # The collected points are the targets of one session: a fixed short list.
    per = summed.groupBy("session_id").agg(
        of_kind(0).alias("n_rates"), of_kind(1).alias("n_states"), of_kind(2).alias("n_buffers"), F.max("offset").alias("offset"),
        F.sum(F.when(F.col("seek") & used, 1).otherwise(0)).alias("seeks"),
        F.min(F.when(F.col("seek") & used, F.struct("t", "kind", "seq", "progress"))).alias("first_seek"),
        F.max(F.when(used & F.col("rate").isNotNull() & ~legal, 1).otherwise(0)).alias("bad_rate"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == 3, point))).alias("points"))
    raw = ("transform(points, p -> offset * 60 + p.progress - if(first_seek.t <= p.target, first_seek.progress, 0D) + p.seen_buffer)")
    curve = per.where("size(points) > 0").withColumn("raw", F.expr(raw))
    gap = f"exists(points, p -> p.seen_buffer_t is null or p.target - p.seen_buffer_t > {float(max_gap)!r}D or p.seen_buffer < 0)"
    drop = "size(raw) > 1 and exists(sequence(1, greatest(size(raw) - 1, 1)), i -> coalesce(raw[i] - raw[i - 1] < -2, false))"
    reason = (F.when(F.expr("n_rates < 2 or n_buffers < 2 or n_states < 1"), "insufficient_dynamics")
              .when(F.col("bad_rate") > 0, "invalid_playback_rate")
              .when((F.col("seeks") > 1) | (F.col("first_seek.progress") > 2), "unannotated_seek")
              .when(F.expr(gap), "buffer_gap").when(F.expr("exists(points, p -> p.seen_rate is null)"), "no_rate_before_window")
              .when(F.expr(drop), "nonmonotone_frontier"))
    highest = F.expr("transform(sequence(1, size(raw)), i -> array_max(slice(raw, 1, i)))")
    return curve.select("session_id", reason.alias("reason"), highest.alias("frontier")).withColumn(
        "frontier", F.when(F.col("reason").isNull(), F.col("frontier")))


def media_intervals(frontiers: DataFrame) -> DataFrame:
    """(session_id, media_start, media_end, reason): span of each curve; a zero span is refused too."""
    start, end = F.element_at("frontier", 1), F.element_at("frontier", -1)
    reason = F.coalesce("reason", F.when(end <= start, "zero_media_span"))
    return frontiers.select("session_id", start.alias("media_start"), end.alias("media_end"), reason.alias("reason"))
