"""Vector algebra on ARRAY<DOUBLE> columns and vector means by partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a) -> Column:
    """L2-normalised vector; vectors shorter than 1e-12 are divided by 1e-12, so zeros stay zeros."""
    # The length is bound to a lambda variable, so it is computed once per vector and not once per element.
    length = F.array(F.greatest(norm(a), F.lit(1e-12)))
    return F.get(F.transform(length, lambda n: F.transform(_col(a), lambda x: x / n)), F.lit(0))


def vector_means(df: DataFrame, keys: list[str], vector: str, dim: int, out: str) -> DataFrame:
    """Element-wise mean per key as ``dim`` plain averages: map-side combined, no group is ever collected."""
    means = df.groupBy(*keys).agg(*[F.avg(F.col(vector)[i]).alias(f"_d{i}") for i in range(dim)],
                                  F.count("*").alias("members"))
    return means.select(*keys, "members", F.array(*[f"_d{i}" for i in range(dim)]).alias(out))


def vector_dim(df: DataFrame, vector: str) -> int:
    """Length of the vector column, read from one row."""
    row = df.select(F.size(vector).alias("n")).limit(1).collect()
    if not row:
        raise ValueError("no vectors to take the dimension from")
    return int(row[0]["n"])


def _col(a) -> Column:
    return a if isinstance(a, Column) else F.col(a)
