"""Problem 8: mixing sources to target weights (capped water-filling).

Sizes are tokens of a public tokenizer. A source can give at most max_repeats times its tokens. The
total is shared out by target weight; a source that can't give its part is clamped at its most, and
what it lacks goes to the others in proportion to their weights, until no more is clamped. Every
document of a source is taken floor(e) times, e being the source's epochs, and a seeded part of its
documents once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.plans.cut import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Slots of the seeded order in which documents are taken once more: a fixed number per source.
SLOTS = 4096


def source_name(col: Column) -> Column:
    """One spelling of a source: trimmed, lower case, words joined by one underscore; blank becomes null."""
    name = F.regexp_replace(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")), r"[\s-]+", "_")
    return F.when(name != "", name)


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """documents(doc_id, text, ...) with n_tokens instead of text; null text counts 0.

    The vocabulary file is read once on the driver and broadcast; its size doesn't depend on the data.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in documents.columns if c != "text"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(vocabulary.value)
        t.encode_special_tokens = True
        for p in it:
            texts = [x or "" for x in p["text"]]
            n = [len(e.ids) for s in range(0, len(texts), 256) for e in t.encode_batch(texts[s : s + 256], add_special_tokens=False)]
            yield p[rest].assign(n_tokens=n)

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    return documents.mapInPandas(run, schema + ", n_tokens long")


def water_fill(tokens: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float) -> dict[str, float]:
    """Tokens that each source gives: share of the total, clamped at repeats x tokens, the excess shared on."""
    most = {s: max(0, repeats[s]) * tokens.get(s, 0) for s in share}
    given = {s: 0.0 for s in share}
    open_ = {s for s in share if share[s] > 0 and most[s] > 0}
    left = min(float(total), float(sum(most[s] for s in open_)))
    while open_ and left > 1e-9:
        weight = sum(share[s] for s in open_)
        clamped = {s for s in open_ if left * share[s] / weight >= most[s] - 1e-9}
        for s in clamped or open_:
            given[s] = float(most[s]) if clamped else left * share[s] / weight
        if not clamped:
            break
        left -= sum(most[s] for s in clamped)
        open_ -= clamped
    return given


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of documents(doc_id, source, text) and targets(source, target_share, max_repeats).

    selection(doc_id, source, n_tokens, copies): the documents taken, copies >= 1. shares(source,
    target_share, max_repeats, documents, tokens, epochs, selected_tokens, actual_share): one row per
    target, also for sources without documents. total: tokens wanted, by default those of all
    documents of the target sources. Null ids and sources without a target are left out; null and
    empty texts have no tokens and are never taken. The same seed takes the same documents.
    """
    spark = documents.sparkSession
    goals = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).dropna()
    goals = goals.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    docs = documents.where("doc_id is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text").join(goals.select("source"), "source", "left_semi")
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(SLOTS)).cast("int")
    counted = cut(token_counts(docs, tokenizer).where("n_tokens > 0").withColumn("slot", slot))
    bins = counted.groupBy("source", "slot").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")).toPandas()  # at most SLOTS rows a target
    wanted = goals.toPandas().sort_values("source")
    have = bins.groupby("source")["tokens"].sum().to_dict()
    given = water_fill(have, dict(zip(wanted["source"], wanted["target_share"])), dict(zip(wanted["source"], wanted["max_repeats"])), sum(have.values()) if total is None else total)
    rows, report = [], []
    for s, share, most in wanted.itertuples(index=False):
        own = bins[bins["source"] == s].sort_values("slot")
        tokens = int(have.get(s, 0))
        epochs = given[s] / tokens if tokens else 0.0
        whole = min(int(epochs + 1e-9), int(most))
        rest = given[s] - whole * tokens
        ahead = own["tokens"].cumsum()
        n = int((ahead - own["tokens"] / 2 <= rest).sum()) if rest > 0 else 0  # the last slot if that comes nearer
        limit = int(own["slot"].iloc[n - 1]) if n else -1
        rows.append((s, whole, limit))
        report.append((s, float(share), int(most), int(own["documents"].sum()), tokens, float(epochs), whole * tokens + int(own["tokens"].iloc[:n].sum())))
    plan = F.broadcast(spark.createDataFrame(rows or [("", 0, -1)], "source string, whole int, last_slot int"))  # one row per target
    taken = counted.join(plan, "source").withColumn("copies", F.col("whole") + (F.col("slot") <= F.col("last_slot")).cast("int")).where("copies > 0")
    shares = spark.createDataFrame(report, "source string, target_share double, max_repeats int, documents long, tokens long, epochs double, selected_tokens long")
    everything = sum(r[6] for r in report)
    return taken.select("doc_id", "source", "n_tokens", "copies"), shares.withColumn("actual_share", F.col("selected_tokens") / F.lit(float(max(1, everything))))
