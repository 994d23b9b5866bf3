"""Problem 7: evaluation texts leaking into training text.

Texts are compared by their letters and digits in one case. A first pass counts, for all n-grams of
the test items, the documents that hold them; of each stretch of an item the n-gram that the fewest
documents hold is its seed, so seeds are rare, and a second pass looks up seeds only. A run of the required length always covers a whole stretch and therefore a
seed: documents and items that share a seed are all candidates. Each candidate is extended from its
seeds to its longest unbroken run, and aligned with the item (Smith-Waterman).

Edited copies need no long run. copies() aligns every document and item but those that cannot reach
the score: an alignment with so few errors leaves so many short grams of the item whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.arrays import code_points, mix64, strings
from inkwell.plans.cut import cut

#: Length of an n-gram; an item whose required run is shorter uses the next smaller one that fits.
GRAMS = (16, 8, 4, 2, 1)
#: Bits of the filter of the items' n-grams: BITS_PER for each n-gram, within these bounds (powers of two). A
#: filter only saves work; beyond the upper bound it passes more, and the join that follows decides alone.
BITS_PER, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28
#: Grams that a task gathers before it counts them.
GATHERED = 1 << 20
MATCH, MISMATCH, GAP = 2, -3, -4
#: Lengths of the short grams that copies() counts; documents, and items, that one task compares; signs that are aligned at once.
SHORT = (3, 4)
DOCS, ITEMS, WIDTH = 4096, 256, 1 << 15


_REST = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Letters and digits in one case."""
    return _REST.sub("", (text or "").casefold())


def _gram_hashes(cps: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that begins at each code point (n a power of two): a polynomial in an odd factor, by
    doubling, over mixed code points. Equal hashes only make candidates; texts decide."""
    h = mix64(cps.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    size, factor = 1, 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        while size < n:
            h = h[:-size] * np.uint64(factor) + h[size:] if len(h) > size else h[:0]
            size, factor = size * 2, factor * factor % 2**64
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(n)


def _plain_points(texts) -> tuple[np.ndarray, np.ndarray]:
    return code_points([plain(t) for t in texts])


def item_grams(items: DataFrame, share: float) -> DataFrame:
    """(item_id, len, need, n, stretch, pos, gram) of items(item_id, text); items without a letter have none."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for i, t in zip(p["item_id"], p["text"]):
                t = plain(t)
                need = -(-len(t) * share // 1)
                need = max(1, int(need))
                if not t:
                    continue
                n = next(g for g in GRAMS if g <= max(1, (need + 1) // 2))
                h = _gram_hashes(code_points([t])[0], n).view(np.int64)
                width = max(1, (need - n + 2) // 2)  # any need - n + 1 starts in a row cover one whole stretch
                pos = np.arange(len(h))
                yield pd.DataFrame({"item_id": i, "len": len(t), "need": need, "n": n, "stretch": pos // width, "pos": pos, "gram": h})

    kind = items.schema["item_id"].dataType.simpleString()
    return items.where("item_id is not null and text is not null").mapInPandas(run, f"item_id {kind}, len int, need int, n int, stretch int, pos int, gram long")


def _filter(grams: DataFrame) -> tuple[np.ndarray, int]:
    """(bit field, number of bits - 1) of grams(gram): a bit for each, built in parts of 4 KB on the executors."""
    n = grams.agg(F.approx_count_distinct("gram")).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(BITS_PER * max(1, n) - 1).bit_length()))

    def part(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(4096, np.uint8)
        at = p["b"].to_numpy(np.int64) & 32767
        np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pd.DataFrame({"part": [key[0]], "bits": [own.tobytes()]})

    buckets = grams.select(F.col("gram").bitwiseAND(bits - 1).alias("b")).distinct().withColumn("part", F.shiftright("b", 15))
    out = np.zeros(max(4096, bits // 8), np.uint8)
    for r in buckets.groupBy("part").applyInPandas(part, "part long, bits binary").collect():  # MOST_BITS / 8 bytes at most
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out, bits - 1


def _hits(field: np.ndarray, mask: int, sizes: list[int], texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, hash, position) of the n-grams that pass the filter, size by size."""
    cps, offsets = _plain_points(texts)
    for n in sizes:
        h = _gram_hashes(cps, n).view(np.int64)
        at = h & mask
        ok = np.flatnonzero(field[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        doc = np.searchsorted(offsets, ok, "right") - 1
        inside = ok + n <= offsets[doc + 1]
        ok, doc = ok[inside], doc[inside]
        yield doc, h[ok], (ok - offsets[doc]).astype(np.int32)


def document_frequencies(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """(gram, df): in how many of docs(text) each of grams(gram) occurs, counted within tasks first; a task
    sends each gram about once, however many documents have it."""
    field, mask = _filter(grams)
    known = docs.sparkSession.sparkContext.broadcast(field)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(part), return_counts=True)
            part.clear()
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], ["gram", "n"])

        for b in it:
            for doc, h, _ in _hits(known.value, mask, sizes, b.column(0).to_pylist()):
                if len(h):
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    part.append(h[np.r_[True, (np.diff(h) != 0) | (np.diff(doc) != 0)]])
                    size += len(part[-1])
            if size > GATHERED:
                size = 0
                yield flush()
        if part:
            yield flush()

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("df")).join(grams.select("gram").distinct(), "gram", "left_semi")


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, align: bool = True) -> DataFrame:
    """(doc_id, item_id, run, item_len, score): documents(doc_id, text) that share with an item of
    items(item_id, text) an unbroken run of at least `share` of the item's letters and digits.

    run is the longest such run; score the Smith-Waterman score over its greatest possible value, 1
    for a whole copy (null if align is off). Null ids, null and empty texts take no part. One row per
    pair, whatever the number of copies of a passage in a document. The seeds are chosen from counts
    over all documents; only then are the places of the seeds looked up.
    """
    spark = documents.sparkSession
    grams = cut(item_grams(items.select("item_id", "text"), share))
    sizes = [r["n"] for r in grams.select("n").distinct().collect()]  # at most len(GRAMS) rows
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    df = document_frequencies(docs, grams, sizes)
    # A gram that no document has would be the rarest of its stretch, and the stretch then stands nowhere.
    seeds = grams.join(df, "gram", "left").groupBy("item_id", "stretch").agg(F.min_by(F.struct("gram", "pos", "len", "need", "n", "df"), F.struct(F.coalesce("df", F.lit(0)), "pos")).alias("s")).select("item_id", "s.*").where("df is not null").drop("df")
    seeds = cut(seeds)
    field, mask = _filter(seeds)
    known = spark.sparkContext.broadcast(field)

    def hits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for doc, h, at in _hits(known.value, mask, sizes, b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(h), pa.array(at)], ["doc_id", "gram", "at"])

    met = docs.mapInArrow(hits, f"doc_id {kind}, gram long, at int")
    cand = met.join(seeds, "gram").groupBy("doc_id", "item_id", "need").agg(F.collect_set(F.struct("pos", "at")).alias("seeds"))  # at most the text's own size
    own_kind = items.schema["item_id"].dataType.simpleString()

    def verify(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, tuple[str, np.ndarray]] = {}

        def points(t: str) -> tuple[str, np.ndarray]:
            if t not in kept:
                if len(kept) > 4096:
                    kept.clear()
                kept[t] = (plain(t), code_points([plain(t)])[0])
            return kept[t]

        for p in it:
            rows = []
            for doc, item, need, seeds_, text, passage in zip(p["doc_id"], p["item_id"], p["need"], p["seeds"], p["text"], p["passage"]):
                (a, x), (b, y) = points(passage), points(text)
                best, best_at = 0, 0
                done: dict[int, int] = {}
                half = need // 2  # of a run through a seed that is long enough, one side is at least this long
                for i, j in sorted((s["pos"], s["at"]) for s in seeds_):
                    if done.get(j - i, -1) > i:
                        continue
                    ahead = len(a) - i >= half and a[i : i + half] == b[j : j + half]
                    if not ahead and not (i >= half and j >= half and a[i - half : i] == b[j - half : j]):
                        continue
                    m = min(len(x) - i, len(y) - j)
                    d = np.flatnonzero(x[i : i + m] != y[j : j + m])
                    end = int(d[0]) if len(d) else m
                    m = min(i, j)
                    d = np.flatnonzero(x[i - m : i][::-1] != y[j - m : j][::-1])
                    back = int(d[0]) if len(d) else m
                    done[j - i] = i + end
                    if back + end > best:
                        best, best_at = back + end, j - i
                if best >= need:
                    lo, hi = max(0, best_at - len(x) // 4), min(len(y), best_at + len(x) + len(x) // 4)
                    rows.append((doc, item, best, len(x), align_score(x, y[lo:hi]) if align else None))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "item_len", "score"])

    full = cut(cand).join(docs, "doc_id").join(items.select("item_id", F.col("text").alias("passage")).where("text is not null"), "item_id")
    return full.select("doc_id", "item_id", "need", "seeds", "text", "passage").mapInPandas(verify, f"doc_id {kind}, item_id {own_kind}, run int, item_len int, score double").groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("item_len").alias("item_len"), F.max("score").alias("score"))


def align_score(x: np.ndarray, y: np.ndarray) -> float:
    """Best local alignment of x in y (linear gaps), over the score of x with itself; row by row."""
    if not len(x) or not len(y):
        return 0.0
    h = np.zeros(len(y) + 1, np.int32)
    step = -GAP * np.arange(len(y) + 1, dtype=np.int32)
    best = 0
    for c in x:
        diag = h[:-1] + np.where(y == c, MATCH, MISMATCH)
        row = np.maximum(np.r_[0, np.maximum(diag, h[1:] + GAP)], 0)
        h = (np.maximum.accumulate(row + step) - step).astype(np.int32)
        best = max(best, int(h.max()))
    return best / (MATCH * len(x))


def least_grams(size: int, share: float, q: int) -> float:
    """At how many places of an item of `size` signs the q-gram also stands in a text whose alignment
    with it scores `share` or more, at least.

    M matches and E errors leave M - (q - 1) * (E + 1) grams whole. A mismatch uses up MATCH - MISMATCH of
    the 2 * size * (1 - share) that the score may lack, a gap -GAP or more; M pays for both.
    """
    lost = max(0, (q - 1 + MISMATCH / MATCH) / (MATCH - MISMATCH), (q - 1 + GAP / MATCH) / -GAP)
    return share * size - lost * MATCH * size * (1 - share) - (q - 1)


def _edits(x: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """For each text at most the number of edits that lead from x to its nearest passage (it may begin
    in the text before); bit-parallel along the texts (Myers), the bits in whole numbers of any length."""
    y = np.concatenate(texts)
    full = (1 << len(y)) - 1
    up, down = 0, 0  # where the distance grows, or falls, from one sign of the texts to the next
    at = {c: int.from_bytes(np.packbits(y == c, bitorder="little").tobytes(), "little") for c in np.unique(x).tolist()}
    for c in x.tolist():
        eq = at[c]
        flat = (((eq & up) + up) ^ up) | eq | down
        plus, minus = ((down | (full & ~(flat | up))) << 1) | 1, (up & flat) << 1
        up, down = (minus | (full & ~(flat | plus))) & full, plus & flat & full
    size = -(-len(y) // 8)
    up_, down_ = (np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), np.uint8), bitorder="little")[: len(y)].astype(np.int64) for v in (up, down))
    return np.minimum.reduceat(len(x) + np.cumsum(up_ - down_), np.cumsum([0, *map(len, texts[:-1])]))


def _best_alignments(x: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    return _side_by_side(x, texts, False)


def _longest_runs(x: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    return _side_by_side(x, texts, True)


def _side_by_side(x: np.ndarray, texts: list[np.ndarray], runs: bool) -> np.ndarray:
    """For each text its best local alignment score with x, or the longest run it shares with x.

    The texts stand in one row with a wall before each that no alignment crosses.
    """
    wall = MATCH * len(x) + 1
    start = np.cumsum([0, *(len(t) + 1 for t in texts)])
    y = np.zeros(start[-1], np.int64)
    for t, s in zip(texts, start):
        y[s + 1 : s + 1 + len(t)] = t
    edge = np.zeros(len(y), bool)
    edge[start[:-1]] = True
    step = (-GAP * np.arange(len(y)) + wall * np.cumsum(edge)).astype(np.int64)
    h = np.zeros(len(y), np.int32 if runs else np.int64)
    best = h.copy()
    kept: dict[int, np.ndarray] = {}
    for c in x.tolist():
        if c not in kept:
            same = (y == c) & ~edge
            kept[c] = same if runs else np.where(edge, -wall, np.where(same, MATCH, MISMATCH))
        row = np.empty_like(h)
        row[0] = 0
        if runs:
            np.add(h[:-1], 1, out=row[1:])
            row *= kept[c]
        else:
            np.add(h[:-1], kept[c][1:], out=row[1:])
            h += GAP
            np.maximum(row, h, out=row)
            np.maximum(row, 0, out=row)
            row += step
            np.maximum.accumulate(row, out=row)
            row -= step
            np.maximum(row, 0, out=row)
            row[edge] = 0
        h = row
        np.maximum(best, h, out=best)
    return np.maximum.reduceat(best, start[:-1])


def _each(f, x: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """f(x, texts) for any number of texts, WIDTH signs at once (or one text)."""
    out, part, size = [np.empty(0, np.int64)], [], 0
    for t in texts:
        if part and size + len(t) > WIDTH:
            out.append(f(x, part))
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        out.append(f(x, part))
    return np.concatenate(out)


def _copies(docs: pd.DataFrame, items: pd.DataFrame, share: float) -> pd.DataFrame:
    """The documents of one block against the items of one block; a part of copies()."""
    columns = ["doc_id", "item_id", "run", "item_len", "score"]
    if not len(docs) or not len(items):
        return pd.DataFrame(columns=columns)
    xs, ys = ([code_points([plain(t)])[0] for t in d["text"]] for d in (items, docs))
    ok = np.array([len(y) for y in ys])[:, None] >= share * np.array([len(x) for x in xs])[None, :] - 1e-9
    ok &= np.array([len(x) > 0 for x in xs])[None, :]

    def grams(c: np.ndarray, q: int) -> np.ndarray:
        n = max(0, len(c) - q + 1)
        h = np.zeros(n, np.uint64)
        for i in range(q):
            h = (h << np.uint64(21)) | c[i : i + n].astype(np.uint64) if i < 3 else mix64(h) ^ c[i : i + n].astype(np.uint64)
        return h

    for q in SHORT:
        own = [grams(x, q) for x in xs]
        known = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
        if not len(known):
            continue
        at = np.zeros((len(known), len(xs)), np.int32)  # how often each gram stands in each item
        for k, g in enumerate(own):
            np.add.at(at[:, k], np.searchsorted(known, g), 1)
        least = np.array([least_grams(len(x), share, q) for x in xs]) - 1e-6
        for d in np.flatnonzero(ok.any(1)):
            g = np.unique(grams(ys[d], q))
            k = np.minimum(np.searchsorted(known, g), len(known) - 1)
            ok[d] &= at[k[known[k] == g]].sum(0) >= least
    rows = []
    for k, x in enumerate(xs):
        d = np.flatnonzero(ok[:, k])
        d = d[_each(_edits, x, [ys[i] for i in d]) <= (1 - share) * len(x) + 1e-9]  # M matches and G gaps of the item leave len(x) - M + G edits, and M >= share * len(x) + 2 * G
        score = _each(_best_alignments, x, [ys[i] for i in d])
        kept = score >= share * MATCH * len(x) - 1e-9
        d, score = d[kept], score[kept]
        for i, s, r in zip(d, score, _each(_longest_runs, x, [ys[i] for i in d])):
            rows.append((docs["doc_id"].iloc[i], items["item_id"].iloc[k], int(r), len(x), s / (MATCH * len(x))))
    return pd.DataFrame(rows, columns=columns)


def copies(documents: DataFrame, items: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, item_id, run, item_len, score): documents(doc_id, text) that hold a whole or an edited copy
    of an item of items(item_id, text): the best local alignment (Smith-Waterman, letters and digits)
    scores at least `share` of a whole copy.

    A run of `share` of the item scores as much, so every pair of leaks() is among them; run is the
    longest one, however short. Exact over all documents and items: short grams (least_grams) and
    the number of edits leave out only pairs that cannot reach the score. Null ids, null and empty texts take no part; one row per pair.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    own = items.where("item_id is not null and text is not null").select("item_id", "text")

    def blocks(d: DataFrame, name: str, most: int) -> DataFrame:
        return d.agg(F.greatest(F.ceil(F.count("*") / most), F.lit(1)).cast("int").alias(name))

    sizes = blocks(docs, "_nd", DOCS).crossJoin(blocks(own, "_ni", ITEMS))  # one row

    def placed(d: DataFrame, mine: str, other: str, key) -> DataFrame:
        """Each row in its block, once for every block of the other side."""
        d = d.crossJoin(sizes).withColumn(f"_{mine}", F.pmod(key, F.col(f"_n{mine}")).cast("int"))
        return d.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))).drop("_nd", "_ni")

    left, right = placed(docs, "d", "i", F.xxhash64("doc_id")), placed(own, "i", "d", F.xxhash64("item_id"))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {own.schema['item_id'].dataType.simpleString()}, run int, item_len int, score double"
    found = left.groupBy("_d", "_i").cogroup(right.groupBy("_d", "_i")).applyInPandas(lambda a, b: _copies(a, b, share), kinds)
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("item_len").alias("item_len"), F.max("score").alias("score"))
