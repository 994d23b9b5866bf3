import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkwell.functions import text
from inkwell.operators import match


def tokens(*values):
    c = re.sub(r"\s+", "", " ".join(v for v in values if v)).casefold()
    return set(re.findall(r"[a-z0-9_]+|[一-鿿]{2,}", c)) | {c[i : i + 4] for i in range(max(0, len(c) - 3))}


def sections(body):
    m = list(re.finditer(r"(?m)^## ([^\n]+?)\s*$", body or ""))
    return {x[1].strip(): body[x.end() : m[i + 1].start() if i + 1 < len(m) else len(body)].strip() for i, x in enumerate(m)}


def brute(questions, cards):
    """Every pair: questions (id, module, type, abilities, task, evidence), cards (id, modules, types, abilities, task, evidence)."""
    out = {}
    for q, module, kind, abilities, task, evidence in questions:
        scores = {}
        for c, modules, kinds, own, statement, support in cards:
            if module in (modules or []):
                labels = [bool({kind} & set(kinds or []) - {None, ""}), bool(set(abilities or []) & set(own or []) - {None, ""})]
                core = [bool(tokens(task) & tokens(statement)), bool(tokens(evidence) & tokens(support))]
                if any(core) or all(labels):
                    scores[c] = 10 * sum(core) + sum(core) + sum(labels)
        if scores:
            out[q] = (len(scores), max(scores.values()), min(c for c in scores if scores[c] == max(scores.values())))
    return out


@pytest.mark.parametrize("block", [4096, 2])
def test_best_matches_by_text_and_by_label(spark, monkeypatch, block):
    monkeypatch.setattr(match, "BLOCK", block)
    q = [("q1", "m", "t1", ["a"], "概括段落", "第3段"), ("q2", "m", None, None, None, None), ("q3", "n", "t1", ["b"], "Ab x", ""), ("q4", "m", "t1", ["z"], "x", "y"), ("q5", "m", "t1", ["a"], None, None), ("q6", "m", "", [""], "", "第3 段的话")]
    c = [("c1", ["m", "m"], ["t1", ""], ["a", None, ""], "概括段落大意", "无"), ("c2", ["n", "m"], ["t1"], ["c"], "别的 AB", "第3段"), ("c3", ["m"], [], None, None, "第3段的话"), ("c4", None, ["t1"], ["a"], "概括段落", "第3段"), ("c5", ["m", None], ["t2"], ["a"], "", "")]
    want = brute(q, c)
    assert want["q1"] == (3, 13, "c1") and "q4" not in want and want["q5"] == (1, 2, "c1") and want["q6"] == (2, 11, "c2")
    questions = spark.createDataFrame([*q, ("q7", None, "t1", ["a"], "概括段落", "第3段"), (None, *q[0][1:])], "question_id string, module string, question_type string, abilities array<string>, statement string, evidence string")
    cards = spark.createDataFrame([*c, (None, *c[0][1:])], "card_id string, modules array<string>, question_types array<string>, abilities array<string>, statement string, evidence string")
    assert {r.question_id: (r.applicable, r.best_score, r.best_card) for r in match.best_matches(questions, cards).collect() if r.applicable} == want
    all_ = {r.question_id: r for r in match.best_matches(questions, cards).collect()}
    assert set(all_) == {f"q{k}" for k in range(1, 8)} and all(r.applicable + r.single_label + r.unrelated + r.other_module == 5 for r in all_.values()) and all_["q7"].other_module == 5
    assert match.best_matches(questions, cards.limit(0)).agg(F.sum("other_module")).first()[0] == 0 and match.best_matches(questions.limit(0), cards).count() == 0


@pytest.mark.parametrize("body", ["## 支持证据\n\n一\n二\n\n## 反例\n三", "前\n##  支持证据 \n一", "## 支持证据\n旧\n## 甲\n## 支持证据\n新 ## 乙\n### 丙", "## 支持证据", "无", "", None])
def test_section(spark, body):
    got = spark.createDataFrame([(body,)], "body string").select(text.section(F.col("body"), "支持证据")).first()[0]
    assert (got or "").strip() == sections(body).get("支持证据", "")


def test_query_equals_brute_force(spark, data):
    def first(name, key):
        return {r[key]: r for r in spark.read.parquet(f"{data}/{name}.parquet").orderBy(F.desc("received_at")).collect() if r[key] is not None}.values()

    q = [(r.question_id, r.module, r.question_type, r.abilities, r.task_statement, " ".join(v for v in [r.evidence_anchor, *(r.retrieval_queries or [])] if v)) for r in first("question_knowledge", "question_id")]
    c = [(r.card_id, r.metadata.modules, r.metadata.question_types, r.metadata.abilities, sections(r.body).get("知识表述"), sections(r.body).get("支持证据")) for r in first("knowledge_cards", "card_id")]
    got = {r.question_id: (r.applicable, r.best_score, r.best_card) for r in entry.queries()["question_card_match"](spark, data).collect() if r.applicable}
    assert got == brute(q, c) and got
