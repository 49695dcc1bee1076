"""Table functions for SQL: token alignment of pairs without leaving the query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..config import MatchConfig
from ..operators.alignment import align_stack
from ..runtime import ship_package

#: Pairs aligned at once; a partition of any size is taken in such pieces.
PIECE = 256
NEEDED = ("g", "q_v", "q_r", "s_v", "s_r")


class Align:
    """``align(TABLE(pairs) PARTITION BY (...), alignment => 'pma')``: every pair with ``local``, ``overlap`` and ``score``.

    Polymorphic: the table needs g, q_v, q_r, s_v and s_r (product of the global vectors, token vectors of length one, reliabilities); all
    other columns pass through with their types. Overlap is null for alignments without one.
    """

    @staticmethod
    def analyze(pairs: AnalyzeArgument, alignment: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not pairs.isTable:
            raise Exception("align needs a table argument")
        kinds = {f.name: f.dataType for f in pairs.dataType.fields}
        missing = [c for c in NEEDED if c not in kinds]
        if missing:
            raise Exception(f"align needs the columns {', '.join(missing)}")
        if not isinstance(kinds["q_v"], ArrayType) or not isinstance(kinds["s_v"], ArrayType):
            raise Exception("q_v and s_v must be arrays of token vectors")
        MatchConfig(alignment=alignment.value if alignment is not None else "pma")
        kept = [f for f in pairs.dataType.fields if f.name not in NEEDED]
        return AnalyzeResult(StructType([*kept, *[StructField(c, DoubleType()) for c in ("local", "overlap", "score")]]))

    def __init__(self):
        self.rows: list = []
        self.config: MatchConfig | None = None

    def eval(self, pairs, alignment: str = "pma"):
        self.config = self.config or MatchConfig(alignment=alignment)
        self.rows.append(pairs)
        if len(self.rows) >= PIECE:
            yield from self._aligned()

    def terminate(self):
        if self.rows:
            yield from self._aligned()

    def _aligned(self):
        rows, self.rows = self.rows, []
        q_v, q_r, s_v, s_r = (np.array([r[c] for r in rows], dtype=float) for c in NEEDED[1:])
        names = [c for c in rows[0].asDict() if c not in NEEDED]
        g = np.array([r["g"] for r in rows], dtype=float)
        if self.config.alignment == "none":
            local, overlap, score = np.zeros(len(rows)), None, g
        else:
            local, overlap, _ = align_stack(np.einsum("pik,pjk->pij", q_v, s_v), q_r, s_r, self.config)
            score = self.config.lambda_z * g + (1 - self.config.lambda_z) * local
        for i, row in enumerate(rows):
            yield (*[row[c] for c in names], float(local[i]), None if overlap is None else float(overlap[i]), float(score[i]))


def register(spark: SparkSession) -> None:
    """Makes ``align`` known to SQL."""
    from pyspark.sql.functions import udtf

    ship_package(spark)
    spark.udtf.register("align", udtf(Align))
