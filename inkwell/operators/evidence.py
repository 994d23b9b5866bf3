"""Declared questions against what a Markdown text holds for them: blocks, options, fields, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import field_values, fenced_json, heading_name, strip, substantive
from inkwell.operators.outline import direct_lines, first_headings, heading_outline

INVENTORY = "题目清单"
CHOICE, SUBJECTIVE = "选择题", "主观题"
KINDS = ["choice", "subjective", "composition", "other"]
_QUESTION = "id string, kind string, score double, options array<string>"
_SCORE = "schema_version int, question_id string, total double, mode string, components array<struct<id string, label string, points double>>, cap struct<points double, rule string>, substitution_groups array<struct<component_ids array<string>, rule string>>, holistic_rule string, bands array<struct<min double, max double, rule string>>"


def _bodies(docs: DataFrame, headings: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """headings(key, line, ...) with the text that stands directly under each, in `name`; empty where there is none."""
    own = direct_lines(docs, key, text).groupBy(key, F.col("head").alias("line")).agg(F.array_sort(F.collect_list(F.struct(F.col("line").alias("l"), F.col("text").alias("t")))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["t"]), "\n")
    return headings.join(own, [key, "line"], "left").withColumn(name, F.coalesce(body, F.lit(""))).drop("_l")


def question_inventory(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(questions, issues). questions(key, ord, id, kind, score, options): valid records of the JSON object
    under the heading 题目清单; issues(key, code, ord): missing_question_inventory,
    invalid_question_inventory (ord null for the whole object).

    A record is valid if its trimmed id is new and not blank, its kind known, its score absent or
    positive, and its options, without blanks or repeats, are there for a choice and only for one.
    Null texts have no inventory.
    """
    known = docs.where(F.col(key).isNotNull())
    h = heading_outline(known, key, text)
    at = first_headings(h, key, [INVENTORY])
    raw = _bodies(known, at.select(key, "line"), key, text, "_b").select(key, fenced_json(F.col("_b")).alias("_j"))
    names = F.json_object_keys("_j")
    version = F.get_json_object("_j", "$.schema_version")
    rows = F.from_json(F.get_json_object("_j", "$.questions"), f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in _QUESTION.split(', '))}>>")
    sound = F.coalesce((F.array_sort(names) == F.array(F.lit("questions"), F.lit("schema_version"))) & version.isin("1", "1.0") & F.get_json_object("_j", "$.questions").startswith("[") & rows.isNotNull(), F.lit(False))
    raw = raw.select(key, sound.alias("_ok"), F.when(sound, rows).alias("_q"))
    each = raw.where("_ok").select(key, F.posexplode("_q").alias("ord", "q"))
    options = F.transform(F.coalesce("q.options", F.array().cast("array<string>")), strip)
    each = each.select(key, "ord", strip(F.col("q.id")).alias("id"), F.col("q.kind").alias("kind"), F.col("q.score").alias("score"), options.alias("options"))
    score_ok = F.col("score").isNull() | ((F.col("score") > 0) & (F.col("score") < float("inf")))
    option_ok = F.forall("options", lambda o: o.isNotNull() & (o != "")) & (F.size(F.array_distinct("options")) == F.size("options")) & ((F.col("kind") == "choice") == (F.size("options") > 0))
    valid = F.coalesce((F.col("id") != "") & F.col("kind").isin(KINDS) & score_ok & option_ok, F.lit(False))
    each = each.withColumn("_v", valid)
    first = each.where("_v").groupBy(key, "id").agg(F.min("ord").alias("_first"))
    each = each.join(first, [key, "id"], "left").withColumn("_v", F.col("_v") & (F.col("ord") == F.col("_first")))
    missing = known.where(F.col(text).isNotNull()).select(key).join(at.select(key), key, "left_anti").select(key, F.lit("missing_question_inventory").alias("code"), F.lit(None).cast("int").alias("ord"))
    broken = raw.where("not _ok").select(key, F.lit("invalid_question_inventory").alias("code"), F.lit(None).cast("int").alias("ord"))
    invalid = each.where("not _v").select(key, F.lit("invalid_question_inventory").alias("code"), "ord")
    return each.where("_v").drop("_v", "_first"), missing.unionByName(broken).unionByName(invalid)


def question_blocks(headings: DataFrame, key: str) -> DataFrame:
    """(key, kind, id, line, level, end): headings 'kind：id' of heading_outline; of one id the last counts."""
    d = headings.withColumn("_m", F.regexp_extract_all(heading_name(F.col("title")), F.lit(rf"(?U)^({CHOICE}|{SUBJECTIVE})\s*[：:]\s*(\S.*)$"), F.lit(0))).where(F.size("_m") > 0)
    name = F.get("_m", F.lit(0))
    d = d.select(key, "line", "level", "end", F.substring(name, 1, 3).alias("kind"), strip(F.regexp_extract(name, r"(?U)^.{3}\s*[：:]\s*(\S.*)$", 1)).alias("id"))
    return d.groupBy(key, "kind", "id").agg(F.max_by(F.struct("line", "level", "end"), "line").alias("_b")).select(key, "kind", "id", "_b.*")


def option_sections(headings: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, block, option, line): headings A项 to D项 directly under a block, upper case; of one option the last counts."""
    name = heading_name(F.col("title"))
    o = headings.where(name.rlike(r"(?U)^[A-Da-d]\s*项(?:[：:].*)?$")).select(key, "line", "level", F.upper(F.substring(name, 1, 1)).alias("option"), F.col("parent").alias("block"))
    b = blocks.select(key, F.col("line").alias("block"), (F.col("level") + 1).alias("level"))
    return o.join(b, [key, "block", "level"]).groupBy(key, "block", "option").agg(F.max("line").alias("line"))


def _missing(body: Column, fields: dict[str, list[str]]) -> Column:
    """Names of the fields that a text gives no value, in the order of `fields`."""
    have = lambda names: F.exists(field_values(body, names), lambda v: substantive(v) > 0)
    return F.array_compact(F.array(*[F.when(~have(names), F.lit(n)) for n, names in fields.items()]))


def choice_evidence(docs: DataFrame, questions: DataFrame, key: str, text: str, fields: dict[str, list[str]]) -> DataFrame:
    """(key, code, id, option, missing): declared choices without a block (missing_option_evidence, option null),
    blocks that no question declares (unexpected_question_block), and options without their fields,
    missing joined by 、. An option without a section lacks every field."""
    h = heading_outline(docs.where(F.col(key).isNotNull()), key, text)
    blocks = question_blocks(h, key).where(F.col("kind") == CHOICE)
    asked = questions.where("kind = 'choice'").select(key, "id", "options")
    none = F.lit(None).cast("string")
    own = option_sections(h, blocks, key)
    own = _bodies(docs, own, key, text, "_b").select(key, "block", "option", _missing(F.col("_b"), fields).alias("_m"))
    want = asked.join(blocks.select(key, "id", F.col("line").alias("block")), [key, "id"]).select(key, "id", "block", F.explode("options").alias("option"))
    lacks = want.join(own, [key, "block", "option"], "left").withColumn("_m", F.coalesce("_m", F.array(*map(F.lit, fields)))).where(F.size("_m") > 0)
    absent = asked.join(blocks, [key, "id"], "left_anti").select(key, F.lit("missing_option_evidence").alias("code"), "id", none.alias("option"), none.alias("missing"))
    extra = blocks.join(asked, [key, "id"], "left_anti").select(key, F.lit("unexpected_question_block").alias("code"), "id", none.alias("option"), none.alias("missing"))
    return absent.unionByName(extra).unionByName(lacks.select(key, F.lit("missing_option_evidence").alias("code"), "id", "option", F.array_join("_m", "、").alias("missing")))


def subjective_chains(docs: DataFrame, questions: DataFrame, key: str, text: str, steps: dict[str, list[str]]) -> DataFrame:
    """(key, code, id, missing): missing_subjective_chain, unexpected_question_block and missing_subjective_step, as in choice_evidence."""
    h = heading_outline(docs.where(F.col(key).isNotNull()), key, text)
    blocks = question_blocks(h, key).where(F.col("kind") == SUBJECTIVE)
    asked = questions.where("kind = 'subjective'").select(key, "id")
    none = F.lit(None).cast("string")
    own = _bodies(docs, blocks.join(asked, [key, "id"], "left_semi").select(key, "id", "line"), key, text, "_b").select(key, "id", _missing(F.col("_b"), steps).alias("_m"))
    absent = asked.join(blocks, [key, "id"], "left_anti").select(key, F.lit("missing_subjective_chain").alias("code"), "id", none.alias("missing"))
    extra = blocks.join(asked, [key, "id"], "left_anti").select(key, F.lit("unexpected_question_block").alias("code"), "id", none.alias("missing"))
    return absent.unionByName(extra).unionByName(own.where(F.size("_m") > 0).select(key, F.lit("missing_subjective_step").alias("code"), "id", F.array_join("_m", "、").alias("missing")))


def bands_follow(bands: Column) -> Column:
    """Whether bands(min, max, rule) begin at 0, follow each other by 1, don't run backwards and each have a rule."""
    k = F.sequence(F.lit(0), F.size(bands) - 1)
    before = lambda i: F.when(i == 0, F.lit(0.0)).otherwise(F.get(bands, i - 1)["max"] + 1)
    ok = lambda i: (F.get(bands, i)["min"] == before(i)) & (F.get(bands, i)["max"] >= F.get(bands, i)["min"]) & (strip(F.get(bands, i)["rule"]) != "")
    return F.coalesce((F.size(bands) > 0) & F.forall(k, lambda i: F.coalesce(ok(i), F.lit(False))), F.lit(False))


def score_code(s: Column, question: Column, score: Column) -> Column:
    """Why an allocation s (struct as in _SCORE) does not give the question's score, or null if it does.

    The points of an additive one count once each, those of a group of substitutes by their greatest; the
    bands of a holistic one must follow each other up to the score.
    """
    ids = F.transform(s["components"], lambda c: c["id"])
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    bad_component = F.exists(s["components"], lambda c: blank(c["id"]) | blank(c["label"]) | F.coalesce(c["points"] <= 0, F.lit(True)))
    repeated = F.size(F.array_distinct(ids)) != F.size(ids)
    grouped = F.flatten(F.transform(s["substitution_groups"], lambda g: g["component_ids"]))
    bad_group = F.exists(s["substitution_groups"], lambda g: F.coalesce((F.size(g["component_ids"]) < 2) | (F.size(F.array_distinct(g["component_ids"])) != F.size(g["component_ids"])) | ~F.forall(g["component_ids"], lambda i: F.array_contains(ids, i)), F.lit(True)) | blank(g["rule"]))
    shared = F.size(F.array_distinct(grouped)) != F.size(grouped)
    alone = F.aggregate(F.filter(s["components"], lambda c: ~F.array_contains(grouped, c["id"])), F.lit(0.0), lambda a, c: a + c["points"])
    best = lambda g: F.array_max(F.transform(F.filter(s["components"], lambda c: F.array_contains(g["component_ids"], c["id"])), lambda c: c["points"]))
    total = alone + F.aggregate(s["substitution_groups"], F.lit(0.0), lambda a, g: a + best(g))
    holistic = s["mode"] == "holistic"
    no = lambda c: F.coalesce(~c, F.lit(True))
    return (
        F.when(s.isNull() | s["cap"].isNull() & s["total"].isNull() | no(s["schema_version"] == 1) | s["mode"].isNull() | s["components"].isNull() | s["substitution_groups"].isNull(), "invalid_score_allocation")
        .when(no((s["question_id"] == question) & (s["total"] == score)), "score_total_mismatch").when(no(s["cap"]["points"] == score) | blank(s["cap"]["rule"]), "invalid_score_cap")
        .when(holistic & (no((F.size(s["components"]) == 0) & (F.size(s["substitution_groups"]) == 0)) | blank(s["holistic_rule"]) | ~bands_follow(s["bands"])), "invalid_holistic_allocation")
        .when(holistic, F.when(no(F.element_at(s["bands"], -1)["max"] == score), "score_total_mismatch"))
        .when(no(s["mode"] == "additive") | (F.size(s["components"]) == 0) | bad_component | repeated, "invalid_score_allocation").when(bad_group | shared, "invalid_substitution_group").when(total != score, "score_total_mismatch")
    )


def score_allocations(docs: DataFrame, questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, id): questions with a score whose text has no allocation, or more than one, or one that
    is wrong (score_code), and allocations of no such question."""
    known = docs.where(F.col(key).isNotNull())
    title = strip(F.regexp_replace("title", "[*_`]+", ""))
    form = r"(?U)^【(?:官方|建议)分值构成】\s*[：:]\s*(\S.*)$"
    h = heading_outline(known, key, text).where(title.rlike(form)).select(key, "line", strip(F.regexp_extract(title, form, 1)).alias("id"))
    counts = h.groupBy(key, "id").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    scored = questions.where("score is not null").select(key, "id", "score")
    d = scored.join(counts, [key, "id"], "full_outer")
    one = _bodies(known, d.where("score is not null and n = 1"), key, text, "_b").withColumn("_s", F.from_json(fenced_json(F.col("_b")), _SCORE))
    wrong = one.select(key, score_code(F.col("_s"), F.col("id"), F.col("score")).alias("code"), "id")
    code = F.when(F.col("score").isNull(), "unexpected_score_allocation").when(F.col("n").isNull(), "missing_score_allocation").when(F.col("n") > 1, "duplicate_score_allocation")
    return d.select(key, code.alias("code"), "id").unionByName(wrong).where("code is not null")
