"""Multi-scale bin features, train-only normalisation and training-free fingerprints.

Bins are kept sparse: an empty bin is a known constant after normalisation, so the moments and the token sums add it
by count instead of storing it. Only :func:`bin_features` itself writes the dense grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS, DataConfig
from ..functions.stepping import finite

VALUES = [f"c{i}" for i in range(len(CHANNELS))]


def split_packets(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable packets, and the rest with a reason."""
    reason = (F.when(~finite(F.col("t")) | ~finite(F.col("length")) | (F.col("length") < 0), "invalid_packet_value")
              .when(F.col("direction").isNull() | ~F.col("direction").isin(0, 1), "invalid_direction"))
    marked = packets.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def observed_bins(config: DataConfig, scale: int, until: float | None = None) -> int:
    """Bins whose centre is at or before ``until`` (B4); a prefix of the bins, found without rounding trouble."""
    until = config.window if until is None else until
    return sum(1 for b in range(config.bins(scale)) if (b + 0.5) * scale / 1000 <= until)


def _visible(packets: DataFrame, config: DataConfig, until: float | None, start: float) -> DataFrame:
    until = config.window if until is None else until
    if not 0 <= until <= config.window:
        raise ValueError("the observation horizon must lie inside the window")
    shifted = packets.withColumn("t", F.col("t") - F.lit(float(start)))
    return shifted.where((F.col("t") >= 0) & (F.col("t") < F.lit(float(until))))


def _bin(scale: Column) -> Column:
    return F.floor(F.col("t") * 1000 / scale + F.lit(1e-9))


def _bin_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    down, up = F.col("direction") == 0, F.col("direction") == 1
    total = lambda test, value: F.sum(F.when(test, value).otherwise(0.0))
    sums = rows.groupBy(*keys).agg(total(down, F.col("length")).alias("c0"), total(up, F.col("length")).alias("c1"),
                                   total(down, F.lit(1.0)).alias("c2"), total(up, F.lit(1.0)).alias("c3"))
    return sums.withColumn("c4", F.when(F.col("c2") > 0, F.col("c0") / F.col("c2")).otherwise(0.0))


def sparse_bins(packets: DataFrame, config: DataConfig, until: float | None = None, start: float = 0.0) -> DataFrame:
    """(session_id, scale, bin, c0..c4) of non-empty bins: one shuffle of map-side combined sums."""
    scales = F.array(*[F.lit(s) for s in config.scales])
    rows = (_visible(packets, config, until, start)
            .select("session_id", "t", "direction", F.col("length").cast("double").alias("length"),
                    F.explode(scales).alias("scale"))
            .select("session_id", "scale", _bin(F.col("scale")).alias("bin"), "direction", "length"))
    return _bin_sums(rows, ["session_id", "scale", "bin"])


def bin_features(packets: DataFrame, config: DataConfig, until: float | None = None, start: float = 0.0,
                 sessions: DataFrame | None = None) -> DataFrame:
    """Dense (session_id, scale, bin, c0..c4, mask) including empty bins.

    A session's non-empty bins are collected, at most as many as its grid has, and the others are filled in behind the shuffle: the
    empty grid is neither shuffled nor aggregated.
    """
    sessions = packets.select("session_id").distinct() if sessions is None else sessions.select("session_id")
    known = [F.coalesce(f"c{i}", F.lit(0.0)).alias(f"c{i}") for i in range(2)]
    sums = sparse_bins(packets, config, until, start).select("session_id", "scale", "bin", *known, "c2", "c3", F.coalesce("c4", F.lit(0.0)).alias("c4"))
    cells = fill_grid(sums, sessions, config)
    centre = (F.col("bin") + 0.5) * F.col("scale") / 1000
    horizon = config.window if until is None else until
    return cells.withColumn("mask", F.when(centre <= F.lit(float(horizon)), 1).otherwise(0))


def fill_grid(bins: DataFrame, sessions: DataFrame, config: DataConfig) -> DataFrame:
    """(session_id, scale, bin, c0..c4): ``bins`` and, for every session of ``sessions``, the empty bins of its grid with zeros."""
    cell = F.struct(F.col("scale").cast("int").alias("scale"), F.col("bin").cast("bigint").alias("bin"), *VALUES)
    found = bins.select("session_id", cell.alias("cell"), F.lit(False).alias("listed"))
    listed = sessions.select("session_id", F.lit(None).cast(found.schema["cell"].dataType).alias("cell"), F.lit(True).alias("listed"))
    held = found.unionByName(listed).groupBy("session_id").agg(F.collect_list("cell").alias("cells"), F.max("listed").alias("listed"))
    # A bin's place in the grid: the bins of the scales before its own, and its number.
    sizes = [config.bins(s) for s in config.scales]
    firsts = {s: sum(sizes[:i]) for i, s in enumerate(config.scales)}
    place = lambda scale, number: F.element_at(F.create_map(*[F.lit(x) for pair in firsts.items() for x in pair]), scale) + number
    inside = F.filter("cells", lambda c: c["bin"] < F.element_at(F.create_map(*[F.lit(x) for pair in zip(config.scales, sizes) for x in pair]), c["scale"]))
    empty = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(sum(sizes) - 1).cast("bigint")), F.transform(inside, lambda c: place(c["scale"], c["bin"])))

    def zeros(p: Column) -> Column:
        scale = F.lit(config.scales[0])
        for s in config.scales[1:]:
            scale = F.when(p >= firsts[s], F.lit(s)).otherwise(scale)
        first = F.lit(0)
        for s in config.scales[1:]:
            first = F.when(p >= firsts[s], F.lit(firsts[s])).otherwise(first)
        return F.struct(scale.alias("scale"), (p - first).alias("bin"), *[F.lit(0.0).alias(c) for c in VALUES])

    filled = F.when(F.col("listed"), F.concat("cells", F.transform(empty, zeros))).otherwise(F.col("cells"))
    return held.select("session_id", F.inline(filled))


def observation_mask(config: DataConfig, sessions: DataFrame, until: Column) -> DataFrame:
    """(session_id, scale, bin, centre, mask) with a per-session horizon column."""
    grid = F.array(*[F.struct(F.lit(s).alias("scale"), F.sequence(F.lit(0), F.lit(config.bins(s) - 1)).alias("bins"))
                     for s in config.scales])
    rows = (sessions.withColumn("_until", until).select("session_id", "_until", F.explode(grid).alias("g"))
            .select("session_id", "_until", F.col("g.scale").alias("scale"), F.explode("g.bins").alias("bin")))
    centre = (F.col("bin") + 0.5) * F.col("scale") / 1000
    return rows.select("session_id", "scale", F.col("bin").cast("bigint").alias("bin"), centre.alias("centre"),
                       F.when(centre <= F.col("_until"), 1).otherwise(0).alias("mask"))


def norm_stats(packets: DataFrame, training: DataFrame, config: DataConfig) -> DataFrame:
    """(scale, channel, mean, std) of log1p features over the observed bins of training sessions.

    ``training`` lists the training session_ids (held-out conditions already removed). Moments of the non-empty bins
    are combined with the number of empty ones; population deviation, below 1e-6 replaced by one.
    """
    bins = sparse_bins(packets.join(training.select("session_id"), "session_id", "left_semi"), config)
    observed = F.create_map(*[F.lit(x) for s in config.scales for x in (s, observed_bins(config, s))])
    last_seen = bins.where(F.col("bin") < F.element_at(observed, F.col("scale")))
    moments = last_seen.groupBy("scale").agg(
        F.count("*").alias("n1"), *[F.avg(F.log1p(c)).alias(f"m_{c}") for c in VALUES],
        *[F.var_pop(F.log1p(c)).alias(f"s_{c}") for c in VALUES])
    size = training.agg(F.countDistinct("session_id").alias("sessions"))
    # One row; the scales are a handful.
    joined = moments.join(F.broadcast(size)).withColumn("n", F.col("sessions") * F.element_at(observed, F.col("scale")))
    share = F.col("n1") / F.col("n")
    rows = joined.select("scale", F.explode(F.array(*[
        F.struct(F.lit(i).alias("channel"), (F.col(f"m_{c}") * share).alias("mean"),
                 F.sqrt(F.col(f"s_{c}") * share + F.col(f"m_{c}") * F.col(f"m_{c}") * share * (1 - share)).alias("std"))
        for i, c in enumerate(VALUES)])).alias("r"))
    return rows.select("scale", "r.channel", "r.mean",
                       F.when(F.col("r.std") < 1e-6, 1.0).otherwise(F.col("r.std")).alias("std"))


def _wide_stats(stats: DataFrame) -> DataFrame:
    """One row per scale with m0..m4 and d0..d4."""
    pick = lambda name, i: F.max(F.when(F.col("channel") == i, F.col(name)))
    return stats.groupBy("scale").agg(*[pick("mean", i).alias(f"m{i}") for i in range(len(VALUES))],
                                      *[pick("std", i).alias(f"d{i}") for i in range(len(VALUES))])


def normalized_bins(dense: DataFrame, stats: DataFrame) -> DataFrame:
    """(session_id, scale, bin, x0..x4, mask): z-scores of log1p features, masked bins exactly zero."""
    # Statistics are one row per configured scale.
    joined = dense.join(F.broadcast(_wide_stats(stats)), "scale")
    z = [F.when(F.col("mask") > 0, (F.log1p(c) - F.col(f"m{i}")) / F.col(f"d{i}")).otherwise(0.0).alias(f"x{i}")
         for i, c in enumerate(VALUES)]
    return joined.select("session_id", "scale", "bin", *z, "mask")


def token_span(length: int, tokens: int, token: int) -> tuple[int, int]:
    """Half-open bin range of one token; neighbouring ranges may overlap (F1)."""
    return token * length // tokens, -(-(token + 1) * length // tokens)


def _layout(config: DataConfig, until: float | None, scales: tuple[int, ...]):
    """Per token: (scale, width, observed bins of the token, reliability, fusion weight)."""
    table = []
    for token in range(config.tokens):
        cells = []
        for scale in scales:
            begin, end = token_span(config.bins(scale), config.tokens, token)
            seen = max(0, min(end, observed_bins(config, scale, until)) - begin)
            cells.append((scale, end - begin, seen, seen / (end - begin)))
        total = sum(c[3] for c in cells) + 1e-8
        table.append([(s, w, n, r, r / total) for s, w, n, r in cells])
    return table


def token_sums(bins: DataFrame, stats: DataFrame, config: DataConfig, until: float | None = None) -> DataFrame:
    """(session_id, scale, token, x0..x4): pooled sums of log1p/std over non-empty observed bins."""
    lengths = F.create_map(*[F.lit(x) for s in config.scales for x in (s, config.bins(s))])
    observed = F.create_map(*[F.lit(x) for s in config.scales for x in (s, observed_bins(config, s, until))])
    m = config.tokens
    seen = (bins.withColumn("_len", F.element_at(lengths, F.col("scale")))
            .where(F.col("bin") < F.element_at(observed, F.col("scale"))))
    first = F.expr(f"bin * {m} div _len")
    last = F.expr(f"((bin + 1) * {m} + _len - 1) div _len - 1")
    spread = seen.withColumn("token", F.explode(F.sequence(first, last)))
    # Statistics are one row per configured scale.
    joined = spread.join(F.broadcast(_wide_stats(stats)), "scale")
    return joined.groupBy("session_id", "scale", "token").agg(
        *[F.sum(F.log1p(c) / F.col(f"d{i}")).alias(f"x{i}") for i, c in enumerate(VALUES)])


def fingerprints(packets: DataFrame, stats: DataFrame, config: DataConfig, until: float | None = None,
                 start: float = 0.0, sessions: DataFrame | None = None, local: str = "fused", bins: DataFrame | None = None) -> DataFrame:
    """(session_id, z, u, v, r) without learned weights (F2, F8-F11); ``bins`` replaces the sparse bins of ``packets`` where they are known.

    ``u`` fuses the pooled scales by reliability, ``v`` is ``u`` (or the pooled finest scale with ``local='finest'``)
    normalised per token, ``r`` is the best reliability over the scales, ``z`` the weighted mean and maximum of ``u``
    over valid tokens, normalised.
    """
    if local not in ("fused", "finest"):
        raise ValueError(f"unknown local token source {local}")
    sessions = packets.select("session_id").distinct() if sessions is None else sessions.select("session_id").distinct()
    sums = token_sums(sparse_bins(packets, config, until, start) if bins is None else bins, stats, config, until)
    fused = _layout(config, until, config.scales)
    finest = _layout(config, until, config.scales[:1])

    layouts = {"f": fused} if local == "fused" else {"f": fused, "n": finest}
    width = len(VALUES)
    names = [f"{tag}{i}" for tag in layouts for i in range(width)]
    scaled = sums.selectExpr("*", *[f"coalesce(element_at({_weight_map(layout, False)}, scale)[cast(token AS int)], 0D) AS _{tag}"
                                    for tag, layout in layouts.items()])
    per_token = scaled.groupBy("session_id", "token").agg(*[
        F.expr(f"sum(x{i} * _{tag})").alias(f"{tag}{i}") for tag in layouts for i in range(width)])
    # At most ``tokens`` entries per session.
    packed = per_token.groupBy("session_id").agg(F.expr(
        f"map_from_entries(collect_list(struct(cast(token AS int), array({', '.join(names)}))))").alias("_tokens"))
    # One row of tokens x channels constants.
    joined = sessions.join(packed, "session_id", "left").join(F.broadcast(_empty_shift(stats, layouts, config)))
    r = [max(c[3] for c in cells) for cells in fused]
    total = sum(r)
    zeros = f"array_repeat(0D, {len(names)})"
    every = f"sequence(0, {config.tokens - 1})"
    filled = (f"transform({every}, t -> zip_with(coalesce(element_at(_tokens, t), {zeros}), _shift[t], (x, s) -> x - s))")
    full = joined.selectExpr("session_id", f"{filled} AS _all", f"{_doubles(r)} AS r")
    v_source = "x" if local == "fused" else f"slice(x, {width + 1}, {width})"
    length = f"greatest(sqrt(aggregate({v_source}, 0D, (s, y) -> s + y * y)), 1e-12D)"
    split = full.selectExpr("session_id", "r", f"transform(_all, x -> slice(x, 1, {width})) AS u",
                            f"transform(_all, x -> transform({v_source}, y -> y / {length})) AS v")
    channels = f"sequence(0, {width - 1})"
    if total == 0:
        raw = f"array_repeat(0D, {2 * width})"
    else:
        mean = (f"transform({channels}, i -> aggregate(zip_with(u, r, (p, w) -> p[i] * w), 0D, (s, y) -> s + y) "
                f"/ {total + 1e-8!r}D)")
        best = f"transform({channels}, i -> array_max(transform(filter(arrays_zip(u, r), p -> p.r > 0), p -> p.u[i])))"
        raw = f"concat({mean}, {best})"
    return (split.selectExpr("*", f"{raw} AS _raw")
            .selectExpr("session_id", "transform(_raw, y -> y / greatest(sqrt(aggregate(_raw, 0D, (s, x) -> s + x * x)), 1e-12D)) AS z",
                        "u", "v", "r"))


def _doubles(values) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def _weight_map(layout, with_observed: bool) -> str:
    """SQL map: scale -> per token fusion weight over token width, optionally times the observed bins."""
    table = {}
    for cells in layout:
        for scale, width, seen, _, weight in cells:
            table.setdefault(scale, []).append(weight / width * (seen if with_observed else 1))
    return "map(" + ", ".join(f"{scale}, {_doubles(values)}" for scale, values in table.items()) + ")"


def _empty_shift(stats: DataFrame, layouts: dict, config: DataConfig) -> DataFrame:
    """One row: per token and channel, the mean/std contribution of all observed bins, subtracted from the sums."""
    wide = stats.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("scale") * 16 + F.col("channel"), F.col("mean") / F.col("std")))).alias("_q"))
    cells = []
    for layout in layouts.values():
        factors = _weight_map(layout, True)
        for i in range(len(VALUES)):
            cells.append(" + ".join(f"coalesce(element_at(_q, {s} * 16 + {i}), 0D) * element_at({factors}, {s})[t]"
                                    for s in {c[0]: None for cells_ in layout for c in cells_}))
    return wide.selectExpr(f"transform(sequence(0, {config.tokens - 1}), t -> array({', '.join(cells)})) AS _shift")


def token_pool(dense: DataFrame, config: DataConfig) -> DataFrame:
    """(session_id, scale, token, x0..x4, r): adaptive mean pooling of normalised bins and their mask (F1, F2)."""
    lengths = F.create_map(*[F.lit(x) for s in config.scales for x in (s, config.bins(s))])
    m = config.tokens
    spread = (dense.withColumn("_len", F.element_at(lengths, F.col("scale")))
              .withColumn("token", F.explode(F.sequence(F.expr(f"bin * {m} div _len"),
                                                        F.expr(f"((bin + 1) * {m} + _len - 1) div _len - 1")))))
    return spread.groupBy("session_id", "scale", "token").agg(
        *[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(VALUES))], F.avg("mask").alias("r"))
