"""Order-dependent operators that also hold for a group with a third of all rows.

A plain window puts a whole group into one task. These sort the table by range over (group, order),
so that a hot group lies in several ranges of about equal size; each range is worked through by
itself, and what goes over from range to range comes from a summary of one row per group and range.
The ranges are written to the shared folder once: their limits come from a sample, and a second
reading must see the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from inkwell.plans.cut import cut


def _ranges(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with its range in _b; ranges are in the order of (group, order), nulls first."""
    return cut(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*group, *order]]).withColumn("_b", F.spark_partition_id()))


def _inside(group: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy("_b", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order])


def _place(order: list[str]) -> Column:
    """A value that sorts as the rows of a group do, nulls first."""
    return F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])


def _carried(d: DataFrame, group: list[str], **aggregates: Column) -> DataFrame:
    """d with what `aggregates` give over the ranges of its group before its own."""
    tops = d.groupBy(*group, "_b").agg(*[c.alias(n) for n, c in aggregates.items()])
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(g).alias(f"_g{k}") for k, g in enumerate(group)]
    carried = tops.select(*names, F.col("_b").alias("_gb"), *[(F.sum(n) if n == "_rows" else F.last(n, ignorenulls=True)).over(before).alias(f"{n}_before") for n in aggregates])
    same = F.col("_b") == F.col("_gb")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return d.join(carried, same, "left").drop("_gb", *[f"_g{k}" for k in range(len(group))])


def carry_forward(df: DataFrame, group: str, order: list[str], value: Column, name: str, initial: str) -> DataFrame:
    """`name` = the last non-null `value` at or before each row of its group, `initial` before the first.

    Rows are ordered by `order`, nulls first; it must tell the rows of a group apart. Null groups are one group.
    """
    d = _ranges(df.withColumn("_v", value), [group], order)
    inside = _inside([group], order)
    top = F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), _place(order)))
    d = _carried(d.withColumn("_in", F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))), [group], _top=top)
    return d.withColumn(name, F.coalesce("_in", "_top_before", F.lit(initial))).drop("_v", "_b", "_in", "_top_before")


def previous(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """`name` = `value` of the row before in its group; null for the first. Ordered as in carry_forward."""
    d = _ranges(df, group, order)
    inside = _inside(group, order)
    d = d.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_in", F.lag(value).over(inside))
    d = _carried(d, group, _last=F.max_by(F.struct(F.col(value).alias("v")), _place(order)))
    return d.withColumn(name, F.when(F.col("_first"), F.col("_last_before.v")).otherwise(F.col("_in"))).drop("_b", "_first", "_in", "_last_before")


def numbered(df: DataFrame, group: list[str], order: list[str], value: str, number: str, before: str) -> DataFrame:
    """`number` = 1, 2, ... in its group, `before` = `value` of the row before. Ordered as in carry_forward."""
    d = _ranges(df, group, order)
    inside = _inside(group, order)
    d = d.withColumn("_at", F.row_number().over(inside)).withColumn("_in", F.lag(value).over(inside))
    d = _carried(d, group, _rows=F.count("*"), _last=F.max_by(F.struct(F.col(value).alias("v")), _place(order)))
    d = d.withColumn(number, (F.coalesce("_rows_before", F.lit(0)) + F.col("_at")).cast("int"))
    return d.withColumn(before, F.when(F.col("_at") == 1, F.col("_last_before.v")).otherwise(F.col("_in"))).drop("_b", "_at", "_in", "_rows_before", "_last_before")
