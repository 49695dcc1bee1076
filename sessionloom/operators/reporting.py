"""Seed summaries, completeness-checked tables, selection and plot series over report rows.

Report rows number runs x scenarios, never sessions; grouping keys here are configurations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import cut_points, running_totals
from ..runtime import require_empty

# Display names by model kind, and by alignment for the fingerprint model.
KIND_NAMES = {"protonet": "ProtoNet", "deepmetric": "DeepMetric", "coda": "CoDA", "cl_metaflow": "CL-MetaFlow",
              "transformer": "Enhanced Transformer", "global_amp": "Global AMP + SupportMax"}
ALIGNMENT_NAMES = {"diagonal": "AMP + Diagonal", "soft_dtw": "AMP + Soft-DTW", "pma": "AMP + PMA"}


def configuration_key(fields: list[str], ignore=("seed", "device", "threads")) -> Column:
    """Hash of the settings that define a configuration; runs differing only in ignored fields share it."""
    kept = [f for f in fields if f not in ignore]
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in kept]), {"ignoreNullFields": "false"}), 256)


def display_method(kind: str = "kind", alignment: str = "alignment") -> Column:
    """Readable method name."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, name in KIND_NAMES.items():
        out = out.when(F.col(kind) == key, name)
    for key, name in ALIGNMENT_NAMES.items():
        out = out.when(F.col(alignment) == key, name)
    return out


def ablation_name() -> Column:
    """Which part a configuration leaves out; columns kind, fusion, prefix_probability, warp_probability, lambda_ali, lambda_sup."""
    return (F.when(F.col("kind") == "global_amp", "Global-only matching").when(F.col("fusion") == "uniform", "Uniform scale fusion")
            .when(F.col("prefix_probability") == 0, "Without prefix").when(F.col("warp_probability") == 0, "Without progress warp")
            .when(F.col("lambda_ali") == 0, "Without Lali").when(F.col("lambda_sup") == 0, "Without Lsup").otherwise("Full"))


def conflicting_reports(reports: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys reported with different values."""
    return reports.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high")


def seed_summary(reports: DataFrame, keys: list[str], expected: int = 3, value: str = "accuracy", strict: bool = False) -> DataFrame:
    """Mean and sample deviation in percent over seeds, completeness and the per-seed values."""
    if strict:
        require_empty(conflicting_reports(reports, [*keys, "seed"], value), "conflicting results for one configuration and seed")
    once = reports.groupBy(*keys, "seed").agg(F.max(value).alias("_v"))
    return once.groupBy(*keys).agg(
        F.count("*").alias("seeds"), (F.avg("_v") * 100).alias("mean_percent"), (F.stddev_samp("_v") * 100).alias("sample_std_percent"),
        (F.count("*") == expected).alias("complete"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("seed").cast("string"), "_v")))).alias("per_seed"))


def open_set_summary(records: DataFrame, keys: list[str], expected: int = 15) -> DataFrame:
    """AUROC and FPR95 over seeds and partitions (C20)."""
    return records.groupBy(*keys).agg(
        F.count("*").alias("evaluations"), (F.count("*") == expected).alias("complete"),
        *[e for m in ("auroc", "fpr95") for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sample_std"))])


def diagnostics_summary(reports: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, measurements, mean, sample_std); null metrics are skipped."""
    pairs = ", ".join(f"'{m}', cast({m} AS double)" for m in metrics)
    long = reports.select(*keys, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)")).where("value is not null")
    return long.groupBy(*keys, "metric").agg(F.count("*").alias("measurements"), F.avg("value").alias("mean"),
                                             F.stddev_samp("value").alias("sample_std"))


def completeness_table(expected: DataFrame, measured: DataFrame, cell: list[str], unit: list[str], value: str = "value",
                       strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per table cell: mean, deviation, measurements against expectations; and the missing units.

    ``expected`` lists every (cell, unit) that should exist, ``measured`` those that do with their value.
    """
    joined = expected.select(*cell, *unit).distinct().join(measured.select(*cell, *unit, F.col(value).alias("_v")), [*cell, *unit], "left")
    missing = joined.where("_v is null").select(*cell, *unit)
    if strict:
        require_empty(missing, "tables need every expected measurement")
    done = F.count("_v")
    table = joined.groupBy(*cell).agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sample_std"), done.alias("measurements"),
                                      F.count("*").alias("expected_measurements"), (done == F.count("*")).alias("complete"))
    return table, missing


def checked_reports(reports: DataFrame, matrix: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reports joined to their expected configuration by run name: (matching, mismatching, missing)."""
    joined = matrix.select("run", F.col("config_hash").alias("want")).join(reports, "run", "left")
    missing = joined.where("config_hash is null").select("run")
    wrong = joined.where("config_hash is not null and config_hash <> want").select("run")
    if strict:
        require_empty(wrong, "report configuration differs from the matrix")
    return joined.where("config_hash = want").drop("want"), wrong, missing


def best_parameter(results: DataFrame, keys: list[str], parameter: str, grid: list[float], seeds: list[int],
                   value: str = "accuracy") -> DataFrame:
    """Winning parameter per key: highest mean over all seeds, smallest on ties; incomplete grids give no row."""
    means = results.groupBy(*keys, parameter).agg(F.countDistinct("seed").alias("_s"), F.avg(value).alias("mean_value"))
    full = means.where(F.col("_s") == len(seeds))
    ranked = full.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.struct(F.col("mean_value"), (-F.col(parameter)).alias("minus"))).alias("_b"))
    return ranked.where(F.col("_n") == len(grid)).select(*keys, (-F.col("_b.minus")).alias(parameter), F.col("_b.mean_value").alias("mean_value"))


def retag(runs: DataFrame, winners: DataFrame, keys: list[str], parameter: str, analyses: list[str]) -> DataFrame:
    """Grid runs keep ``analyses`` only when they carry the winning parameter."""
    joined = runs.join(winners.select(*keys, F.col(parameter).alias("_win")), keys, "left")
    wanted = F.array(*[F.lit(a) for a in analyses])
    tags = F.when(F.col(parameter) == F.col("_win"), F.sort_array(F.array_union("analyses", wanted))).otherwise(F.array_except("analyses", wanted))
    return joined.withColumn("analyses", F.when(F.col(parameter).isNull() | F.col("_win").isNull(), F.col("analyses")).otherwise(tags)).drop("_win")


def matched_seed_series(reports: DataFrame, keys: list[str], x: str, seeds: list[int], value: str = "accuracy") -> DataFrame:
    """Plot series over ``x`` from the named seeds only, complete points only."""
    picked = reports.where(F.col("seed").isin(*seeds)).groupBy(*keys, x, "seed").agg(F.max(value).alias("_v"))
    return picked.groupBy(*keys, x).agg((F.avg("_v") * 100).alias("mean_percent"), (F.stddev_samp("_v") * 100).alias("sample_std_percent"),
                                        F.count("*").alias("_n")).where(F.col("_n") == len(seeds)).drop("_n")


def condition_matrix(results: DataFrame, conditions: list[str], value: str = "mean_percent") -> DataFrame:
    """Support condition rows, query condition columns."""
    return results.groupBy("support_condition").pivot("query_condition", conditions).agg(F.max(value))


def matrix_delta(left: DataFrame, right: DataFrame, value: str = "mean_percent") -> DataFrame:
    """Cell-wise values of two methods and their difference."""
    keys = ["support_condition", "query_condition"]
    other = right.select(*keys, F.col(value).alias("other"))
    return left.select(*keys, F.col(value).alias("value")).join(other, keys, "left").withColumn("delta", F.col("value") - F.col("other"))


def empirical_cdf(errors: DataFrame, column: str) -> DataFrame:
    """(column, cdf): share of rows at or below each distinct value."""
    counted = errors.groupBy(column).agg(F.count("*").alias("_n"))
    run = running_totals(counted, [], column, {"_n": "_cum"}, cut_points(errors, column))
    total = errors.agg(F.count("*").alias("_total"))  # one row
    return run.join(F.broadcast(total)).select(column, (F.col("_cum") / F.col("_total")).alias("cdf"))


def storage_footprint(fingerprints: DataFrame, columns: list[str], bytes_per_value: int = 8) -> DataFrame:
    """Stored bytes per component and in total over a fingerprint table."""
    def values(c):
        nested = dict(fingerprints.dtypes)[c].startswith("array<array")
        return F.aggregate(F.transform(c, lambda t: F.size(t)), F.lit(0), lambda s, n: s + n) if nested else F.size(c)

    sums = [F.sum(values(c) * F.lit(bytes_per_value)).cast("bigint").alias(f"{c}_bytes") for c in columns]
    out = fingerprints.agg(F.count("*").alias("fingerprints"), *sums)
    return out.withColumn("kib_per_fingerprint", sum(F.col(f"{c}_bytes") for c in columns) / F.col("fingerprints") / 1024)


def parameter_grid(spark: SparkSession, entries: list[tuple[dict, str]]) -> DataFrame:
    """(config_hash, parameters..., tags): equal settings listed under several tags become one row."""
    names = sorted({n for parameters, _ in entries for n in parameters})
    rows = [tuple(float(p[n]) for n in names) + (tag,) for p, tag in entries]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", tag string")
    key = F.sha2(F.concat_ws("|", *[F.format_number(n, 6) for n in names]), 256)
    return frame.groupBy(key.alias("config_hash"), *names).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def select_runs(runs: DataFrame, names: list[str] | None = None, analyses: list[str] | None = None, max_runs: int | None = None) -> DataFrame:
    """Runs limited by name, by analysis and to the first ``max_runs`` in name order."""
    out = runs if names is None else runs.where(F.col("run").isin(*names))
    if analyses is not None:
        out = out.where(F.arrays_overlap("analyses", F.array(*[F.lit(a) for a in analyses])))
    return out if max_runs is None else out.orderBy("run").limit(max_runs)


def sweep_scores(pairs: DataFrame, grid: DataFrame, group: list[str], beta_similarity=1.0, beta_overlap=1.0) -> DataFrame:
    """Compatibility class scores of already scored pairs for every (tau_c, tau_s) of a parameter grid."""
    # The grid is a handful of literal settings.
    spread = pairs.join(F.broadcast(grid.select("config_hash", "tau_c", "tau_s")))
    keys = ["config_hash", *group, "query_id", "label"]
    c = (F.lit(beta_similarity) * F.col("local") + F.lit(beta_overlap) * F.col("overlap")) / F.col("tau_c")
    both = c + F.col("score") / F.col("tau_s")
    window = Window.partitionBy(*keys)
    shifted = spread.select(*keys, "tau_s", c.alias("c"), both.alias("b")).select(
        *keys, "tau_s", "c", "b", F.max("c").over(window).alias("mc"), F.max("b").over(window).alias("mb"))
    sums = shifted.groupBy(*keys).agg(F.max("tau_s").alias("tau_s"), F.max("mc").alias("mc"), F.max("mb").alias("mb"),
                                      F.sum(F.exp(F.col("c") - F.col("mc"))).alias("sc"), F.sum(F.exp(F.col("b") - F.col("mb"))).alias("sb"))
    return sums.select(*keys, (F.col("tau_s") * (F.col("mb") + F.log("sb") - F.col("mc") - F.log("sc"))).alias("candidate"))
