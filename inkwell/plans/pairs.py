"""Expanding groups into pairs without putting a hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one side of a group that one salt value takes at most.
BLOCK = 2000


def salted_self_pairs(members: DataFrame, group: list[str], key: str, differ: str | None = None, block: int = BLOCK) -> DataFrame:
    """All pairs (left, right) of `key` within a group, left < right, each once.

    `differ`: only pairs whose values of that column differ. A group of n rows is cut into
    s = ceil(n / block) blocks; every two blocks meet under a key of their own, so a join key holds at
    most `block` rows of either side whatever the group's size, and each row is repeated s times a side.
    Null keys or groups make no pair.
    """
    own = members.select(*group, F.col(key), *([differ] if differ else [])).dropna(subset=[*group, key]).distinct()
    size = own.groupBy(*group).agg(F.count("*").alias("_n"), *([F.min(differ).alias("_lo"), F.max(differ).alias("_hi")] if differ else []))
    size = size.where("_n > 1" + (" and _lo <> _hi" if differ else "")).select(*group, F.ceil(F.col("_n") / block).cast("int").alias("_s"))
    placed = own.join(size, group).withColumn("_x", F.pmod(F.xxhash64(key), F.col("_s")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_s") - 1))
    left = placed.select(*group, F.col(key).alias("left"), *([F.col(differ).alias("_dl")] if differ else []), F.col("_x").alias("_xl"), other.alias("_xr"))
    right = placed.select(*group, F.col(key).alias("right"), *([F.col(differ).alias("_dr")] if differ else []), F.col("_x").alias("_xr"), other.alias("_xl"))
    cond: Column = F.col("left") < F.col("right")
    if differ:
        cond = cond & (F.col("_dl") != F.col("_dr"))
    return left.join(right, [*group, "_xl", "_xr"]).where(cond).select(*group, "left", "right")


def expand_class_pairs(pairs: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of keys from pairs of classes (a, b) and the membership (class, key).

    The larger classes are split in blocks of `block` keys on both sides before the join; the result
    has (left, right) with left < right in string order and no pair twice if `pairs` has none twice.
    """
    size = members.groupBy("class").agg(F.ceil(F.count("*") / block).cast("int").alias("_s"))
    p = pairs.select("a", "b").join(size.select(F.col("class").alias("a"), F.col("_s").alias("_sa")), "a").join(size.select(F.col("class").alias("b"), F.col("_s").alias("_sb")), "b")
    p = p.withColumn("_xa", F.explode(F.sequence(F.lit(0), F.col("_sa") - 1))).withColumn("_xb", F.explode(F.sequence(F.lit(0), F.col("_sb") - 1)))
    m = members.join(size, "class").select("class", "key", F.pmod(F.xxhash64("key"), F.col("_s")).cast("int").alias("_x"))
    a = m.select(F.col("class").alias("a"), F.col("_x").alias("_xa"), F.col("key").alias("_ka"))
    b = m.select(F.col("class").alias("b"), F.col("_x").alias("_xb"), F.col("key").alias("_kb"))
    out = p.select("a", "b", "_xa", "_xb").join(a, ["a", "_xa"]).join(b, ["b", "_xb"])
    return out.where(F.col("_ka") != F.col("_kb")).select(F.least("_ka", "_kb").alias("left"), F.greatest("_ka", "_kb").alias("right"))
