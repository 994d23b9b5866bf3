"""What a library's cards must be, as one issue table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import escapes_root, is_absolute_locator, normal_identifier, section, strip

# Fixed values of the card contract.
VERSION = 1
STATUSES = ["candidate", "verified", "stable", "review_required", "deprecated"]
RISKS = ["normal", "high"]
MODULES = ["reading_1", "reading_2", "classical_chinese", "poetry", "language_use", "composition"]
PREFIXES = {"overview": "OV", "question_type": "QT", "method": "MT", "case": "CS"}
REQUIRED_SECTIONS = ["知识表述", "适用条件", "禁止越界", "支持证据", "反例与冲突"]
SOURCE_KINDS = ["formal_exam", "formal_answer", "text_inference", "official_publication", "original_example"]
#: Kinds of source that may carry a kind of evidence.
EVIDENCE = {"formal_exam": ["formal_exam"], "formal_answer": ["formal_answer"], "text_inference": ["text_inference", "original_example"]}


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def _no_list(c: Column) -> Column:
    """Whether an array is null, empty or holds a null or blank member."""
    return F.coalesce(F.size(c) <= 0, F.lit(True)) | F.exists(c, _blank)


def _unknown(c: Column, values: list[str]) -> Column:
    return ~F.coalesce(c.isin(values), F.lit(False))


def _source_codes(s: Column) -> list[Column]:
    own = normal_identifier(s["id"])
    code = lambda c, n: F.when(c, F.lit(n))
    blank = _blank(s["id"]) | _blank(s["kind"]) | _blank(s["name"]) | _blank(s["locator"])
    return [
        F.when(own.isNull(), F.lit("invalid_source_id")).when(own != s["id"], F.lit("noncanonical_source_id")),
        code(blank, "invalid_source"),
        code(_unknown(s["kind"], SOURCE_KINDS), "invalid_source"),
        F.when(_blank(s["locator"]), F.lit("invalid_source")).when(is_absolute_locator(strip(s["locator"])), F.lit("absolute_path")).when(escapes_root(s["locator"]), F.lit("path_escape")),
    ]


def card_issues(cards: DataFrame) -> DataFrame:
    """(card_id, path, code, n): rules that each of cards(card_id, path, metadata, body) breaks, n times each.

    Rules are tested within the row, sources by array functions, so nothing is shuffled. A null metadata or
    field breaks the field's rule; duplicates of a source id within a card count from the second one on.
    """
    m = F.col("metadata")
    prefix = F.create_map(*[F.lit(x) for p in PREFIXES.items() for x in p])
    sources = F.coalesce(m["sources"], F.filter(m["sources"], lambda s: F.lit(False)))
    good = F.filter(F.transform(m["sources"], lambda s: s["id"]), lambda i: F.coalesce(normal_identifier(i) == i, F.lit(False)))
    repeats = F.coalesce(F.size(good) - F.size(F.array_distinct(good)), F.lit(0))
    one = lambda c, n: F.when(c, F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    codes = F.concat(
        *[one(m[f].isNull(), "missing_metadata") for f in ("schema_version", "title", "card_type", "status", "risk_level", "modules", "question_types", "abilities", "sources")],
        one(F.col("card_id").isNull(), "missing_metadata"), one(F.coalesce(m["schema_version"] != VERSION, F.lit(True)), "unsupported_schema_version"), one(_blank(m["title"]), "invalid_title"),
        one(_unknown(m["card_type"], list(PREFIXES)), "invalid_card_type"),
        one(~_unknown(m["card_type"], list(PREFIXES)) & ~F.coalesce(F.regexp(F.col("card_id"), F.concat(F.lit("^"), prefix[m["card_type"]], F.lit(r"-[0-9]{4}$"))), F.lit(False)), "invalid_id"),
        one(_unknown(m["status"], STATUSES), "invalid_status"), one(_unknown(m["risk_level"], RISKS), "invalid_risk_level"),
        one(_no_list(m["modules"]) | F.exists(m["modules"], lambda x: _unknown(x, MODULES)), "invalid_module"), one(_no_list(m["question_types"]), "invalid_question_types"), one(_no_list(m["abilities"]), "invalid_abilities"),
        *[one(_blank(section(F.col("body"), t)), "missing_section") for t in REQUIRED_SECTIONS],
        one(F.coalesce(F.size(m["sources"]) <= 0, F.lit(True)), "missing_source"),
        F.coalesce(F.flatten(F.transform(sources, lambda s: F.array_compact(F.array(*_source_codes(s))))), F.array().cast("array<string>")),
        F.array_repeat(F.lit("duplicate_source_id"), repeats),
    )
    return cards.select("card_id", "path", F.explode(codes).alias("code")).groupBy("card_id", "path", "code").agg(F.count("*").alias("n"))


def duplicate_cards(cards: DataFrame) -> DataFrame:
    """(card_id, path, code, n): cards whose id other cards have too, one row for each path."""
    n = cards.where("card_id is not null").groupBy("card_id").agg(F.count("*").alias("n")).where("n > 1")
    return cards.join(n, "card_id").select("card_id", "path", F.lit("duplicate_id").alias("code"), "n").distinct()


def evidence_binding(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, ord, state): cases(key, ord, source_id, evidence_kind) against sources(key, source_id, kind) of the
    same key: bound, unknown_verification_source or verification_source_kind_mismatch."""
    s = sources.where("source_id is not null").groupBy("key", "source_id").agg(F.collect_set("kind").alias("kinds"))
    may = F.create_map(*[x for k, v in EVIDENCE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fits = F.coalesce(F.arrays_overlap("kinds", may[F.col("evidence_kind")]), F.lit(False))
    state = F.when(F.col("kinds").isNull(), "unknown_verification_source").when(fits, "bound").otherwise("verification_source_kind_mismatch")
    return cases.join(s, ["key", "source_id"], "left").select("key", "ord", state.alias("state"))


def library_issues(cards: DataFrame, parse_errors: DataFrame, index: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(path, code): issues of parsing, of the cards and of their ids; where these have none, index_out_of_sync
    if the index is not the rebuilt one row for row."""
    own = parse_errors.select("path", F.lit("card_parse_error").alias("code")).unionByName(card_issues(cards).select("path", "code")).unionByName(duplicate_cards(cards).select("path", "code")).distinct()
    clean = own.agg((F.count("*") == 0).alias("clean"))  # one row
    differ = index.exceptAll(rebuilt).unionByName(rebuilt.exceptAll(index)).agg((F.count("*") > 0).alias("differ"))
    late = clean.crossJoin(differ).where("clean and differ").select(F.lit("index.json").alias("path"), F.lit("index_out_of_sync").alias("code"))
    return own.unionByName(late)
