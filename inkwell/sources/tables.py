"""Table access: one parquet dataset per table under a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def first_per_key(df: DataFrame, key: str, order: str | None = "received_at") -> DataFrame:
    """One row per non-null key: the earliest by `order` (late duplicates are equal otherwise).

    Partial aggregation keeps at most one row per key and map task, so a hot key never piles up.
    """
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    kept = F.min_by(row, F.col(order)) if order and order in df.columns else F.any_value(row)
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.coalesce(kept, F.any_value(row)).alias("_row"))
        .select(key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
    )
