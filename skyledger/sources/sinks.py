"""A5 latest-state tables and A6 JSON replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest_by(df: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """A5 in batch: the row with the greatest ``order_col`` per key (last
    write wins).  Partial aggregation keeps one candidate per key per task."""
    others = [c for c in df.columns if c not in keys]
    agg = F.max_by(F.struct(*others), F.col(order_col)).alias("_latest")
    return df.groupBy(*keys).agg(agg).select(*keys, "_latest.*")


def to_json_rows(df: DataFrame, cols: list[str | Column] | None = None,
                 alias: str = "json") -> DataFrame:
    """One JSON object per row; null fields stay present as ``null``."""
    cols = cols or df.columns
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(alias))
