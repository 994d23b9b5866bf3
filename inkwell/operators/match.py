"""Weighted search over cards, and matching questions with cards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import compact

#: What a match in a field counts (fixed values).
WEIGHTS = {"id": 100, "title": 80, "tags": 50, "body": 20}
#: Questions, and cards, of a module that one task compares.
BLOCK = 4096


def weighted_search(cards: DataFrame, fields: dict[str, Column], query: str, key: str = "card_id", statuses: tuple[Column, list[str]] | None = None, modules: tuple[Column, list[str]] | None = None) -> DataFrame:
    """(key, score, matched) of rows whose compact fields hold the compact query; the empty query
    gives all rows with score 0. Order by score, highest first, then key.

    statuses and modules are (column, wanted values) and keep rows whose status is wanted, or that
    have a wanted module; an empty list of wanted values keeps all.
    """
    if statuses and statuses[1]:
        cards = cards.where(statuses[0].isin(statuses[1]))
    if modules and modules[1]:
        cards = cards.where(F.arrays_overlap(modules[0], F.array(*map(F.lit, modules[1]))))
    needle = compact(F.lit(query or ""))
    hit = {n: (needle != "") & F.coalesce(compact(c).contains(needle), F.lit(False)) for n, c in fields.items()}
    score = reduce(lambda a, b: a + b, [F.when(hit[n], F.lit(WEIGHTS[n])).otherwise(0) for n in fields])
    matched = F.array_join(F.array_compact(F.array(*[F.when(hit[n], F.lit(n)) for n in fields])), ",")
    return cards.select(key, score.alias("score"), matched.alias("matched")).where((needle == "") | (F.col("score") > 0))


def _tokens(t: str | None) -> set[str]:
    """Search tokens of a text as in functions.text.tokens, with case folded."""
    t = re.sub(r"\s+", "", t or "").casefold()
    return {*re.findall(r"[a-z0-9_]+|[\u4e00-\u9fff]{2,}", t), *(t[i : i + 4] for i in range(len(t) - 3))}


def _labels(values) -> set[str]:
    return {v for v in ([] if values is None else values) if v}


#: Why a pair is as it is: code and text (fixed values).
REASONS = {
    "other_module": "板块不一致，记录为不适用；不得迁移具体答案或评分口径。",
    "single_label": "仅有单一表面标签相同，未达到方法适用门槛。",
    "unrelated": "未发现核心任务、证据结构或成组标签的一致性。",
}
DIMENSIONS = ["question_type", "ability", "actual_task", "evidence_structure"]


def _hits(q: pd.DataFrame, c: pd.DataFrame) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """For each question of one block the cards of one block that it meets in each dimension."""
    sides = {
        "question_type": ([_labels([v]) for v in q["question_type"]], (_labels(v) for v in c["question_types"])),
        "ability": ([_labels(v) for v in q["abilities"]], (_labels(v) for v in c["abilities"])),
        "actual_task": ([_tokens(v) for v in q["statement"]], (_tokens(v) for v in c["statement"])),
        "evidence_structure": ([_tokens(v) for v in q["evidence"]], (_tokens(v) for v in c["evidence"])),
    }
    at: dict[str, dict[str, np.ndarray]] = {}
    for d, (asked, held) in sides.items():
        lists: dict[str, list[int]] = {v: [] for values in asked for v in values}
        for k, values in enumerate(held):
            for v in values & lists.keys():
                lists[v].append(k)
        at[d] = {v: np.array(l) for v, l in lists.items() if l}
    for i in range(len(q)):
        hit = {}
        for d, (asked, _) in sides.items():
            hit[d] = np.zeros(len(c), bool)
            for v in asked[i] & at[d].keys():
                hit[d][at[d][v]] = True
        yield i, hit


def _judged(hit: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(applicable, score, number of dimensions) of one question and all cards of a block."""
    core = hit["actual_task"].astype(int) + hit["evidence_structure"]
    labels = hit["question_type"].astype(int) + hit["ability"]
    return (core > 0) | (labels == 2), 10 * core + core + labels, core + labels


def _best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    """The questions of one block against the cards of one block; a part of best_matches."""
    c = c.sort_values("card_id", ignore_index=True)
    rows = []
    for i, hit in _hits(q, c):
        ok, score, dims = _judged(hit)
        best = int(np.where(ok, score, -1).argmax()) if ok.any() else None
        rows.append((q["question_id"].iloc[i], int(ok.sum()), int((~ok & (dims > 0)).sum()), int((dims == 0).sum()), None if best is None else int(score[best]), None if best is None else c["card_id"][best]))
    return pd.DataFrame(rows, columns=["question_id", "applicable", "single_label", "unrelated", "best_score", "best_card"]).astype({"best_score": "Int32"})


def _pairs(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
    """Every pair of one block with a dimension in common; a part of match_pairs."""
    rows = []
    for i, hit in _hits(q, c):
        ok, score, dims = _judged(hit)
        for k in np.flatnonzero(dims):
            rows.append((q["question_id"].iloc[i], c["card_id"].iloc[k], [d for d in DIMENSIONS if hit[d][k]], int(score[k]), bool(ok[k])))
    return pd.DataFrame(rows, columns=["question_id", "card_id", "dimensions", "score", "applicable"])


def _blocked(questions: DataFrame, cards: DataFrame, work, schema: str) -> DataFrame:
    """work(questions of a block, cards of a block) for every two blocks of one module.

    The texts have so many tokens in common that a join on tokens would make each pair many times over.
    So a module's questions and cards are cut into blocks of BLOCK rows, and a task looks up the tokens
    of one block of questions in one block of cards; a hot module is many blocks.
    """
    q = questions.where("question_id is not null and module is not null").select("question_id", "module", "question_type", "abilities", "statement", "evidence")
    c = cards.where("card_id is not null").select("card_id", F.explode(F.array_distinct("modules")).alias("module"), "question_types", "abilities", "statement", "evidence").where("module is not null")

    def blocks(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("module").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    sizes = blocks(q, "_nq").join(blocks(c, "_nc"), "module")

    def placed(d: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row in its block, once for every block of the other side."""
        d = d.join(sizes, "module").withColumn(f"_{own}", F.pmod(F.xxhash64(key), F.col(f"_n{own}")).cast("int"))
        return d.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"_n{other}") - 1))).drop("_nq", "_nc")

    keys = ["module", "_q", "_c"]
    kinds = f"question_id {q.schema['question_id'].dataType.simpleString()}, {schema.format(card=c.schema['card_id'].dataType.simpleString())}"
    return placed(q, "question_id", "q", "c").groupBy(*keys).cogroup(placed(c, "card_id", "c", "q").groupBy(*keys)).applyInPandas(work, kinds)


def best_matches(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """(question_id, applicable, single_label, unrelated, other_module, best_score, best_card): per question
    how many cards are applicable, share but one label, share nothing, or are of another module; the
    best score of the applicable ones and the first card with it. Every question with every card.

    questions(question_id, module, question_type, abilities, statement, evidence) and cards(card_id,
    modules, question_types, abilities, statement, evidence), ids not repeated. Only cards of the
    question's module are compared, in four dimensions: question type, an ability, a token of the
    statements (actual_task) and one of the evidence (evidence_structure). A card is applicable if one
    of the last two meets, or both labels do; the score is 10 for each of the last two and 1 for each
    dimension. A question without module meets no card; null ids take no part, null and blank values
    match nothing.
    """
    parts = _blocked(questions, cards, _best, "applicable long, single_label long, unrelated long, best_score int, best_card {card}")
    first = F.min_by("best_card", F.when(F.col("best_score").isNotNull(), F.struct(-F.col("best_score"), F.col("best_card"))))
    g = parts.groupBy("question_id").agg(*[F.sum(n).alias(n) for n in ("applicable", "single_label", "unrelated")], F.max("best_score").alias("best_score"), first.alias("best_card"))
    all_cards = cards.where("card_id is not null").agg(F.count("*").alias("_all"))  # one row
    out = questions.where("question_id is not null").select("question_id").join(g, "question_id", "left").crossJoin(F.broadcast(all_cards)).na.fill(0, ["applicable", "single_label", "unrelated"])
    other = F.col("_all") - F.col("applicable") - F.col("single_label") - F.col("unrelated")
    return out.select("question_id", "applicable", "single_label", "unrelated", other.alias("other_module"), "best_score", "best_card")


def match_pairs(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """(question_id, card_id, dimensions, score, applicability, reason): every pair with a dimension in common.

    Pairs with none are counted by best_matches and have no row here: their score is 0 and their reason
    one of two. Order by question_id, applicable first, score downwards, card_id.
    """
    d = _blocked(questions, cards, _pairs, "card_id {card}, dimensions array<string>, score int, applicable boolean")
    met = F.concat(F.lit("题目与知识卡在"), F.array_join("dimensions", "、"), F.lit("维度达到保守适用门槛；仍须核对本题证据与评分边界。"))
    state = F.when(F.col("applicable"), "applicable").otherwise("not_applicable")
    return d.select("question_id", "card_id", "dimensions", "score", state.alias("applicability"), F.when(F.col("applicable"), met).otherwise(F.lit(REASONS["single_label"])).alias("reason"))


def pre_decisions(pairs: DataFrame, questions: DataFrame, cards: DataFrame, withheld: list[str]) -> DataFrame:
    """(question_id, decision, card_ids): the applicable cards of each question in order, without cards of a
    withheld status(card_id, status); 'not_applicable' where none is left."""
    open_ = cards.where(~F.coalesce(F.col("status").isin(withheld), F.lit(False))).select("card_id")
    own = pairs.where("applicability = 'applicable'").join(open_, "card_id", "left_semi").groupBy("question_id").agg(F.array_sort(F.collect_set("card_id")).alias("card_ids"))
    d = questions.select("question_id").distinct().join(own, "question_id", "left")
    return d.select("question_id", F.when(F.col("card_ids").isNull(), "not_applicable").otherwise("applicable").alias("decision"), F.coalesce("card_ids", F.array().cast("array<string>")).alias("card_ids"))
