"""Latest-wins projections of append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders of the reference projections; text timestamps compare as text, the place in the log breaks ties.
COVERAGE_SELECT, COVERAGE_REPORT = ("retrieved_at", "line"), ("retrieved_at", "attempt_id", "line")
FRONTIER, ATTEMPT, ATTEMPT_REPORT = ("event_at", "line"), ("finished_at", "attempt_no", "attempt_id", "line"), ("finished_at", "attempt_no", "attempt_id")


def latest(df: DataFrame, keys: list[str], order: tuple[str, ...] | list[Column], first: bool = False) -> DataFrame:
    """The last (or first) row of each key by order; partial aggregation, so no key is gathered. Extra columns stay."""
    pick = F.min_by if first else F.max_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
