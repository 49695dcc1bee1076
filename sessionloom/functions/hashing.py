"""Portable hashing: canonical ids, derived seeds, draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def session_key(dataset, source) -> Column:
    """First 24 hex digits of the SHA-256 of the JSON array [dataset, source]."""
    parts = F.concat(F.lit("["), _json_string(dataset), F.lit(","), _json_string(source), F.lit("]"))
    return F.substring(F.sha2(parts, 256), 1, 24)


def seed_from(seed, *parts) -> Column:
    """First 32 bits of the hash of the JSON array [seed, "part", ...] as BIGINT."""
    items = [F.col(seed).cast("string") if isinstance(seed, str) else F.lit(str(seed))]
    items += [_json_string(p) for p in parts]
    text = F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def hash_text(*parts) -> Column:
    """Hex digest of the parts joined by '|', used as a seeded random order."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def uniform(*parts) -> Column:
    """Deterministic uniform in [0, 1) from the first 48 bits of the digest."""
    return F.conv(F.substring(hash_text(*parts), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def distinct_draws(count: str, take: str, key: str, prior: str = "cast(array() as array<bigint>)") -> Column:
    """``take`` distinct positions out of ``count``, in draw order, without ``prior`` ones.

    Arguments are SQL expressions. Each draw picks uniformly among the positions left: the hash gives an index
    into the free positions, and stepping over the taken ones (ascending) maps it to a real position. The arrays
    are as long as the draw, so nothing here grows with the data.
    """
    number = f"cast(conv(substr(sha2(concat({key}, '|', cast(i as string)), 256), 1, 12), 16, 10) as bigint)"
    step = (f"aggregate(array_sort(acc), {number} % ({count} - size(acc)), "
            "(x, e) -> if(x >= e, x + 1, x))")
    taken = (f"aggregate(sequence(0, greatest({take}, 1) - 1), {prior}, "
             f"(acc, i) -> array_append(acc, {step}))")
    fresh = f"slice({taken}, size({prior}) + 1, {take})"
    return F.expr(f"case when {take} <= 0 then cast(array() as array<bigint>) else {fresh} end")


def _json_string(value) -> Column:
    """JSON string literal of a column or constant (quotes and backslashes escaped)."""
    column = value if isinstance(value, Column) else F.lit(str(value))
    one_field = F.to_json(F.struct(column.cast("string").alias("v")))
    return F.regexp_extract(one_field, r'^\{"v":(.*)\}$', 1)
