"""Digests, exact duplicates, deltas, coverage and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.ordered import numbered


def exact_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """(digest, first_key, copies) per distinct content; null content is left out.

    Aggregates on the map side, so a content with a third of all rows is no hot group.
    """
    return df.where(content.isNotNull()).groupBy(F.sha2(content.cast("binary"), 256).alias("digest")).agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))


def new_content(incoming: DataFrame, known: DataFrame, key: str, content: str) -> DataFrame:
    """(digest, first_key): content of `incoming` that `known` does not hold, each once."""
    old = known.where(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).distinct()
    return exact_groups(incoming, key, F.col(content)).join(old, "digest", "left_anti").select("digest", "first_key")


def ordered_fingerprint(parts: Column) -> Column:
    """SHA-256 over the sorted parts, one a line; of the parts of one key only, never of a whole table."""
    return F.sha2(F.array_join(F.array_sort(parts), "\n"), 256)


def revision_ledger(df: DataFrame, group: list[str], order: str, content: str) -> DataFrame:
    """Versions of each group in order: version, digest, previous digest and what changed.

    A group with a third of all rows is numbered in ranges (operators.ordered); null content counts as empty.
    """
    d = df.select(*group, order, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("digest"))
    d = numbered(d, group, [order], "digest", "version", "previous")
    kind = F.when(F.col("previous").isNull(), "initial").when(F.col("previous") != F.col("digest"), "content_changed").otherwise("unchanged")
    return d.select(*group, order, "version", "digest", "previous", kind.alias("change"))


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, state, expected_rows, actual_rows): matched, missing, extra or duplicate. Null keys are left out."""
    e = expected.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("expected_rows"))
    a = actual.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("actual_rows"))
    d = e.join(a, key, "full_outer").na.fill(0, ["expected_rows", "actual_rows"])
    state = F.when(F.col("actual_rows") == 0, "missing").when(F.col("expected_rows") == 0, "extra").when((F.col("expected_rows") > 1) | (F.col("actual_rows") > 1), "duplicate").otherwise("matched")
    return d.select(key, state.alias("state"), "expected_rows", "actual_rows")


def receipt(recorded: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, valid): a key is valid if both sides have it with equal digests (both null counts as equal)."""
    r = recorded.select(key, F.col(digest).alias("_r"), F.lit(True).alias("_in"))
    f = found.select(key, F.col(digest).alias("_f"), F.lit(True).alias("_has"))
    d = r.join(f, key, "full_outer")
    return d.select(key, (F.col("_in").isNotNull() & F.col("_has").isNotNull() & F.col("_r").eqNullSafe(F.col("_f"))).alias("valid"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of either side the other lacks, duplicates counted."""
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))


def exact_roles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, later) of files(ord, path, digest, role, size). kept(digest, path, role, size, copies, conflict):
    the first file by `ord`, then path, stands for a content and keeps its role; conflict: the copies name
    different roles ('auto' agrees with any). later(digest, path, first_path): the other files, one row each,
    so that a content with a third of all rows is no array. Null digests are left out.
    """
    d = files.where("digest is not null").select("ord", "path", "digest", "role", "size")
    role = F.when(F.col("role") != "auto", F.col("role"))
    g = d.groupBy("digest").agg(F.min(F.struct("ord", "path", "role", "size")).alias("_f"), F.count("*").alias("copies"), F.min(role).alias("_lo"), F.max(role).alias("_hi"))
    kept = g.select("digest", "_f.path", "_f.role", "_f.size", "copies", F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)).alias("conflict"))
    first = g.where("copies > 1").select("digest", F.col("_f.ord").alias("_o"), F.col("_f.path").alias("first_path"))
    later = d.join(first, "digest").where(~(F.col("ord").eqNullSafe(F.col("_o")) & F.col("path").eqNullSafe(F.col("first_path")))).select("digest", "path", "first_path")
    return kept, later


def ordered_coverage(expected: DataFrame, actual: DataFrame, group: str, key: str, position: str) -> DataFrame:
    """(group, same): whether the keys of a group stand in `actual` exactly as in `expected`, in the same
    order of `position` and as often. A full join of ranks; groups that only one side has are not the same."""

    def ranked(d: DataFrame, name: str) -> DataFrame:
        d = d.where(F.col(group).isNotNull()).select(group, position, key)
        return numbered(d, [group], [position], key, "_r", "_p").select(group, "_r", F.struct(F.col(key).alias("k")).alias(name))

    both = ranked(expected, "_e").join(ranked(actual, "_a"), [group, "_r"], "full_outer")
    alike = F.col("_e").isNotNull() & F.col("_a").isNotNull() & F.col("_e.k").eqNullSafe(F.col("_a.k"))
    return both.groupBy(group).agg(F.bool_and(alike).alias("same"))
