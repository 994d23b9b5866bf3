"""Problem 1: all pairs of records whose sets of values are alike (extended-prefix join).

Two different sets r, s with |r & s| / |r | s| >= theta share at least t members, t >= ceil(theta * |r|)
and t >= ceil(theta * |s|). Order all members by rarity; then for every l up to t the first l members
that they share stand among the first |r| - ceil(theta * |r|) + l of r, and likewise of s. So the first
shared member alone is a key to join on, and where that member is in too many sets, it is replaced by
the first two shared members, and these by the first three: each key's prefix is as long as its own
frequency asks for. Both sides decide by the same counts, so they always meet; any counts give the
same result, all candidates are verified.

Members are 64-bit hashes from the start, so that no text but the records' keys is shuffled. How rare a
member is comes from a histogram by hash, so each set finds its keys alone. Where keys meet, sizes and
64-bit signatures leave out pairs that cannot be alike before anything is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.arrays import mix64
from inkwell.plans.cut import cut
from inkwell.plans.pairs import expand_class_pairs, salted_self_pairs

#: A key that more sets may have is extended by another shared member, up to three; one of two members also where
#: its rarer member is in more than OFTEN sets (parameters of cost; results don't depend on them).
FREQUENT, OFTEN = 24, 4096
#: Sets of a key that meet each other in one task, twice at most; a key with more is split on both sides.
BLOCK = 4096
#: Entries of either half of the histogram (members, sets): eight a record, within these bounds (powers of two).
#: Beyond the upper one entries are shared: the order is less sharp, and results are the same.
LEAST, MOST = 1 << 16, 1 << 24
#: Entries of the histogram that travel as one row.
PART = 1 << 14


def normal_set(col: Column) -> Column:
    """Members trimmed of all white space and lower-cased; null and blank ones dropped; sorted, once each."""
    trimmed = F.transform(col, lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))))


def hashes(items: Column) -> Column:
    """The different members as sorted 64-bit numbers; null ones dropped."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(members of all rows, each row's first place; length rows + 1)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def _of_sets(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set; no set is empty."""
    return mix64(np.add.reduceat(mix64(h), offsets[:-1])) if len(h) else h


def _at(h: np.ndarray, entries: int) -> np.ndarray:
    return (mix64(h) & np.uint64(entries - 1)).astype(np.int64)


def _histogram(rows: DataFrame, entries: int) -> np.ndarray:
    """In how many rows(t) each entry's members stand, and behind these how many rows have each entry's sets; null and empty sets don't count."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * entries, np.uint32)
        for b in it:
            h, offsets = _flat(b.filter(pc.greater(pc.list_value_length(b.column(0)), 0)).column(0))
            for own in (_at(h, entries), _at(_of_sets(h, offsets), entries) + entries):
                at, n = np.unique(own, return_counts=True)
                total[at] += n.astype(np.uint32)
        full = np.flatnonzero(total)
        edge = np.flatnonzero(np.r_[True, np.diff(full // PART) > 0, True]) if len(full) else [0]
        parts = [full[a:b] for a, b in zip(edge[:-1], edge[1:])]
        cols = [pa.array([int(x[0]) // PART for x in parts], pa.int64()), pa.array([(x % PART).astype(np.uint16).tobytes() for x in parts], pa.binary()), pa.array([total[x].tobytes() for x in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["part", "places", "counts"])

    def add(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PART, np.int64)
        np.add.at(total, np.frombuffer(b"".join(p["places"]), np.uint16), np.frombuffer(b"".join(p["counts"]), np.uint32))
        return pd.DataFrame({"part": [key[0]], "counts": [np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()]})

    got = rows.select("t").mapInArrow(count, "part long, places binary, counts binary").groupBy("part").applyInPandas(add, "part long, counts binary").collect()  # 8 * MOST bytes at most
    out = np.zeros(2 * entries, np.uint32)
    for r in got:
        out[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.uint32)
    return out


def _after(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): each place i of at with every place j behind it and before its to."""
    w = np.maximum(to - at - 1, 0)
    i = np.repeat(np.arange(len(at)), w)
    return i, at[i] + 1 + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)


def _set_keys(h: np.ndarray, offsets: np.ndarray, counts: np.ndarray, total: int, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count of the key's rarest member) of sets whose members have these counts."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    o = np.lexsort((h, counts, row))
    h, c = h[o], counts[o].astype(np.int64)
    n = np.diff(offsets)
    least = np.ceil(n * theta - 1e-9).astype(np.int64)
    ends = lambda l: offsets[:-1] + np.minimum(n, n - least + l)  # noqa: E731  where the prefix for l shared members ends
    at = np.flatnonzero((np.arange(len(h)) < ends(1)[row]) & (c > 1))  # a member of one set only meets none
    rows, keys, first = [], [], []

    def add(at: np.ndarray, k: np.ndarray, c1: np.ndarray) -> None:
        rows.append(row[at])
        keys.append(k)
        first.append(c1)

    k, c1 = h[at], c[at]
    # A set of which some like one shares fewer than l + 1 members keeps its key beside the longer ones.
    open_ = c1 > FREQUENT
    done = ~open_ | (least[row[at]] <= 1)
    add(at[done], k[done], c1[done])
    at, k, c1 = at[open_], k[open_], c1[open_]
    i, at = _after(at, ends(2)[row[at]])
    k, c1 = mix64(k[i] ^ mix64(h[at])), c1[i]
    open_ = (c1 > OFTEN) | (c1 * c[at] > FREQUENT * total)
    done = ~open_ | (least[row[at]] <= 2)
    add(at[done], k[done], c1[done])
    at, k, c1 = at[open_], k[open_], c1[open_]
    i, at = _after(at, ends(3)[row[at]])
    add(at, mix64(k[i] ^ mix64(h[at])), c1[i])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(first)


def _possible(i: np.ndarray, j: np.ndarray, own: np.ndarray, n: np.ndarray, sig: np.ndarray, theta: float) -> np.ndarray:
    """Pairs (a, b), a < b, whose sizes and signatures allow theta: each bit of one set that the other lacks is a member that it lacks."""
    a, b, x, y = n[i], n[j], sig[i], sig[j]
    both = np.minimum(a - np.bitwise_count(x & ~y).astype(np.int64), b - np.bitwise_count(y & ~x).astype(np.int64))
    ok = (both >= theta * (a + b - both) - 1e-9) & (own[i] != own[j])
    p, q = own[i[ok]], own[j[ok]]
    return np.stack([np.minimum(p, q), np.maximum(p, q)], 1)


def _candidates(sets: DataFrame, rank: np.ndarray, theta: float) -> DataFrame:
    """(a, b): ids of sets(id, t) that share a key and may be alike, each pair once."""
    entries = len(rank) // 2
    total = int(rank[entries:].sum(dtype=np.int64))
    known = sets.sparkSession.sparkContext.broadcast(rank[:entries])

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            h, offsets = _flat(b.column(1))
            row, k, c1 = _set_keys(h, offsets, known.value[_at(h, entries)], max(1, total), theta)
            sig = np.bitwise_or.reduceat(np.uint64(1) << (mix64(h) >> np.uint64(58)), offsets[:-1]) if len(h) else h
            n = np.diff(offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.view(np.int64), b.column(0).to_numpy()[row], n[row], sig[row].view(np.int64), c1)], ["k", "id", "n", "sig", "c"])

    d = sets.select("id", "t").mapInArrow(keys, "k long, id long, n int, sig long, c long")
    if int(rank[:entries].max(initial=0)) > BLOCK:
        hot = d.where(F.col("c") > BLOCK).groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("s")).where("s > 1")
        d = d.join(cut(hot), "k", "left").withColumn("x", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))
        d = d.withColumn("y", F.explode_outer(F.when(F.col("s").isNotNull(), F.sequence(F.lit(0), F.col("s") - 1))))
        d = d.withColumn("k", F.when(F.col("s").isNull(), F.col("k")).otherwise(F.xxhash64("k", F.least("x", "y"), F.greatest("x", "y"))))
    d = d.select("k", "id", "n", "sig")

    def joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        found: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            p = np.unique(np.concatenate(found), axis=0)
            found.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal size
            t = pa.Table.from_batches(rest)
            k, own, n = (t.column(c).to_numpy() for c in ("k", "id", "n"))
            n, sig = n.astype(np.int64), t.column("sig").to_numpy().view(np.uint64)
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            to = np.repeat(edge[1:], np.diff(edge))
            meets = np.cumsum(to - np.arange(len(k)) - 1)
            s = 0
            while s < len(k):  # about a million pairs at once, and one row at least
                e = max(s + 1, int(np.searchsorted(meets, (meets[s - 1] if s else 0) + 1_000_000, "right")))
                i, j = _after(np.arange(s, e), to[s:e])
                p = _possible(i + s, j, own, n, sig, theta)
                s = e
                if len(p):
                    found.append(p)
                    size += len(p)
                if size > 1_000_000:
                    yield flush()

        for b in it:
            if not b.num_rows:
                continue
            k = b.column(0).to_numpy()
            last = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
            if last:
                rest.append(b.slice(0, last))
                yield from done()
                rest = [b.slice(last)]
            elif rest and rest[0].column(0)[0].as_py() != k[0]:
                yield from done()
                rest = [b]
            else:
                rest.append(b)
        if rest:
            yield from done()
        if found:
            yield flush()

    return d.repartition("k").sortWithinPartitions("k").mapInArrow(joined, "a long, b long").distinct()


def similar_pairs(records: DataFrame, theta: float = 0.6, counted: DataFrame | None = None) -> DataFrame:
    """(left, right): all pairs of keys of records(key string, items) with Jaccard similarity >= theta, equal sets included.

    items are strings, or what hashes() makes of them. Null keys, null and empty sets take no part; repeated rows
    count once. counted: rows to take the members' frequencies from, which hold all sets of records (default:
    records). Equal sets of several keys are one class, named by its smallest id, and stay one row in the join.
    """

    def sets_of(d: DataFrame) -> DataFrame:
        t = F.col("items") if dict(d.dtypes)["items"] == "array<bigint>" else hashes(F.col("items"))
        return d.where(F.col("key").isNotNull()).select("key", t.alias("t"))

    counted = records if counted is None else counted
    entries = min(MOST, max(LEAST, 1 << (8 * max(1, counted.count()) - 1).bit_length()))
    rank = _histogram(sets_of(counted), entries)
    known = records.sparkSession.sparkContext.broadcast(rank[entries:] > 1)

    def marked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether other rows may have the set."""
        for b in it:
            h, offsets = _flat(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(known.value[_at(_of_sets(h, offsets), entries)])], ["key", "t", "more"])

    rec = cut(sets_of(records).where(F.size("t") > 0).mapInArrow(marked, "key string, t array<bigint>, more boolean").withColumn("id", F.monotonically_increasing_id()))
    several = rec.where("more")
    classes = cut(several.groupBy("t").agg(F.min("id").alias("id"), F.min("key").alias("key"), F.max("key").alias("last")))
    members = cut(several.select("t", "key").join(classes.where("key < last").select("t", F.col("id").alias("class")), "t").select("class", "key").distinct())
    sets = rec.where("not more").select("id", "key", "t").unionByName(classes.select("id", F.when(F.col("key") == F.col("last"), F.col("key")).alias("key"), "t"))

    side = lambda k: sets.select(F.col("id").alias(k), F.col("key").alias(f"k{k}"), F.col("t").alias(f"t{k}"))
    checked = _candidates(sets, rank, theta).join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    pairs = cut(checked.where(both >= theta * (F.size("ta") + F.size("tb") - both) - 1e-9).select("a", "b", "ka", "kb"))
    one = pairs.where("ka <> kb").select(F.least("ka", "kb").alias("left"), F.greatest("ka", "kb").alias("right"))
    wide = pairs.where("ka is null or kb is null")
    alone = wide.where("ka is not null").select(F.col("a").alias("class"), F.col("ka").alias("key")).unionByName(wide.where("kb is not null").select(F.col("b").alias("class"), F.col("kb").alias("key"))).distinct()
    same = salted_self_pairs(members, ["class"], "key").select("left", "right")
    return same.unionByName(one).unionByName(expand_class_pairs(wide, members.unionByName(alone)))
