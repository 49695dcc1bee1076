"""Integrity checks as anti-joins and counts; every check names itself and should count zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import require_empty


def split_leaks(sessions: DataFrame) -> DataFrame:
    """Identities present in more than one split."""
    return sessions.groupBy("identity").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")


def fit_outside_training(fit_ids: DataFrame, sessions: DataFrame, exclude_condition: str | None = None) -> DataFrame:
    """Sessions used to fit a transform that are not training rows."""
    allowed = sessions.where("split = 'train'")
    if exclude_condition is not None:
        allowed = allowed.where(F.col("condition") != exclude_condition)
    return fit_ids.select("session_id").join(allowed.select("session_id"), "session_id", "left_anti")


def repeated_signatures(sessions: DataFrame, columns=("exact_signature", "near_signature")) -> DataFrame:
    """Signatures carried by more than one retained session."""
    keyed = sessions.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("signature")) for c in columns])).alias("s"))
    return keyed.groupBy("s.kind", "s.signature").agg(F.count("*").alias("rows")).where("rows > 1")


def episode_violations(members: DataFrame, sessions: DataFrame, parts, group=None, split: str | None = None) -> dict[str, DataFrame]:
    """Named violation frames of episodes: unknown ids, repeats, overlaps, identity, mode, condition and split mismatches."""
    group = group or ["seed", "scenario", "partition", "episode"]
    known = sessions.select("session_id", F.col("identity").alias("true_identity"), "mode", "condition",
                            *(["split"] if split else []))
    joined = members.join(known, "session_id")
    per_session = members.groupBy(*group, "session_id").agg(F.count("*").alias("n"), F.min("role").alias("a"), F.max("role").alias("b"))
    spec = members.sparkSession.createDataFrame(
        [(p.scenario, p.partition, role, mode, condition) for p in parts
         for role, mode, condition in (("support", p.support_mode, p.support_condition), ("query", p.query_mode, p.query_condition))],
        "scenario string, `partition` int, role string, want_mode string, want_condition string")
    # The scenario list is a fixed handful of rows.
    wanted = joined.join(F.broadcast(spec), ["scenario", "partition", "role"])
    found = {
        "unknown_session": members.join(known, "session_id", "left_anti"),
        "identity_mismatch": joined.where("identity <> true_identity"),
        "role_overlap": per_session.where("a <> b"),
        "repeated_record": per_session.where("n > 1 and a = b"),
        "label_conflict": members.groupBy(*group, "label").agg(F.min("identity").alias("a"), F.max("identity").alias("b")).where("a <> b"),
        "mode_mismatch": wanted.where("want_mode is not null and mode <> want_mode"),
        "condition_mismatch": wanted.where("want_condition is not null and condition <> want_condition")}
    if split:
        found["split_mismatch"] = joined.where(F.col("split") != split)
    return found


def open_set_violations(partitions: DataFrame) -> dict[str, DataFrame]:
    """Violations of open-set partitions: labels against the known flag, roles of unknown identities, repeated rows."""
    repeated = partitions.groupBy("partition", "session_id").agg(F.count("*").alias("n")).where("n > 1")
    return {"open_label_mismatch": partitions.where("known <> (label >= 0)"),
            "open_unknown_support": partitions.where("role = 'support' and not known"), "open_repeated": repeated}


def audit_report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) for all named checks, zeros included."""
    report = None
    for name, frame in checks.items():
        row = frame.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        report = row if report is None else report.unionByName(row)
    return report


def audit_summary(sessions: DataFrame, members: DataFrame) -> DataFrame:
    """(item, key, value): sessions and identities per split, sessions per mode, episodes checked."""
    by_split = sessions.groupBy("split").agg(F.countDistinct("identity").alias("value")).select(
        F.lit("identities").alias("item"), F.col("split").alias("key"), "value")
    by_mode = sessions.groupBy("mode").agg(F.count("*").alias("value")).select(F.lit("mode").alias("item"), F.col("mode").alias("key"), "value")
    episodes = members.select("seed", "scenario", "episode").distinct().groupBy("scenario").agg(F.count("*").alias("value")).select(
        F.lit("episodes").alias("item"), F.col("scenario").alias("key"), "value")
    return by_split.unionByName(by_mode).unionByName(episodes)


def require_provenance(table: DataFrame, expected: dict[str, str]) -> None:
    """Raise unless the fingerprint columns of every row carry the expected values."""
    wrong = F.lit(False)
    for column, value in expected.items():
        wrong = wrong | ~F.col(column).eqNullSafe(F.lit(value))
    require_empty(table.select(*expected).where(wrong), "table was made by another dataset or configuration")
