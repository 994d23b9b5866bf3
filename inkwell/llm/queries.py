"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import encoding, leak, lookalike, mix, near, residue, scan, sets, spam
from inkwell.sources.tables import first_per_key, table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    def named(name: str, source: str, key: str, column: str) -> DataFrame:
        """Key and members carry the set's name, so that one join serves all sets."""
        items = F.transform(sets.normal_set(F.col(column)), lambda x: F.concat(F.lit(name + "="), x))
        return table(spark, root, source).where(F.col(key).isNotNull()).select(F.concat(F.lit(name + "="), F.col(key)).alias("key"), sets.hashes(items).alias("items"), "received_at")

    own = [named("abilities", "question_knowledge", "question_id", "abilities"), named("abilities", "knowledge_cards", "card_id", "metadata.abilities"), named("question_types", "knowledge_cards", "card_id", "metadata.question_types")]
    records, counted = (reduce(DataFrame.unionByName, parts) for parts in ([first_per_key(d, "key") for d in own], own))
    pairs = sets.similar_pairs(records, 0.6, counted)
    return pairs.select(F.substring_index("left", "=", 1).alias("set_name"), F.expr("substr(left, instr(left, '=') + 1)").alias("left_id"), F.expr("substr(right, instr(right, '=') + 1)").alias("right_id"))


def p3_records(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "page_texts").select(F.lit("page_texts").alias("name"), F.col("page_key").alias("key"), F.col("doc_id").alias("doc"), F.col("page_no").alias("page"), "text", F.lit(False).alias("inside"))
    questions = table(spark, root, "question_candidates").select(F.lit("question_candidates").alias("name"), F.col("candidate_key").alias("key"), F.col("doc_id").alias("doc"), F.col("page_start").alias("page"), "text", F.lit(True).alias("inside"))
    return pages.unionByName(questions)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return scan.scan_noise(p3_records(spark, root)).select(F.col("name").alias("table_name"), F.col("key").alias("record_key"), F.col("kind").alias("noise_kind"))


def p3_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Every page and question in continuous paragraphs."""
    fixed = scan.repaired_texts(p3_records(spark, root)).select(F.col("name").alias("table_name"), F.col("key").alias("record_key"), "text", "changed")
    return fixed.distinct()


def p4_records(spark: SparkSession, root: str) -> DataFrame:
    rows = first_per_key(table(spark, root, "candidate_knowledge").select("candidate_id", "title", "statement", "received_at"), "candidate_id")
    text = F.concat(F.coalesce("title", F.lit("")), F.coalesce("statement", F.lit("")))
    return rows.select(F.col("candidate_id").alias("key"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "").alias("text"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return near.near_pairs(p4_records(spark, root), 0.6).select(F.col("left").alias("left_id"), F.col("right").alias("right_id"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return encoding.repair_encoding(table(spark, root, "page_texts"), "page_key", "text").select(F.col("key").alias("page_key")).distinct()


def p5_restored(spark: SparkSession, root: str) -> DataFrame:
    pages = first_per_key(table(spark, root, "page_texts").select("page_key", "text", "received_at"), "page_key")
    return encoding.repair_encoding(pages, "page_key", "text").withColumnRenamed("key", "page_key")


def p2_records(spark: SparkSession, root: str) -> DataFrame:
    """(name, key, text) of the three tables; late duplicates are equal, so any one of them will do."""
    out = None
    for name, key, text in (("page_texts", "page_key", "text"), ("question_candidates", "candidate_key", "text"), ("knowledge_cards", "card_id", "body")):
        own = table(spark, root, name).select(F.lit(name).alias("name"), F.col(key).alias("key"), F.col(text).alias("text"))
        out = own if out is None else out.unionByName(own)
    return out


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return lookalike.look_alike_pairs(p2_records(spark, root)).select(F.col("name").alias("table_name"), F.col("left").alias("left_key"), F.col("right").alias("right_key"))


def p2_canonical(spark: SparkSession, root: str) -> DataFrame:
    """Each text of the three tables in its one form, and whether that differs from what is stored."""
    out = None
    for name, key, text in (("page_texts", "page_key", "text"), ("question_candidates", "candidate_key", "text"), ("knowledge_cards", "card_id", "body")):
        own = first_per_key(table(spark, root, name).select(key, text, "received_at"), key).select(F.lit(name).alias("table_name"), F.col(key).alias("record_key"), F.col(text).alias("text"))
        out = own if out is None else out.unionByName(own)
    one = out.withColumn("canonical", lookalike.canonical_text("text"))
    return one.select("table_name", "record_key", "canonical", (~F.col("text").eqNullSafe(F.col("canonical"))).alias("changed"))


def p6_records(spark: SparkSession, root: str) -> DataFrame:
    cards = table(spark, root, "knowledge_cards").select(F.lit("knowledge_cards").alias("name"), F.col("card_id").alias("key"), F.col("body").alias("text"))
    return cards.unionByName(table(spark, root, "blocks").select(F.lit("blocks").alias("name"), F.col("block_key").alias("key"), "text"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue_records(p6_records(spark, root)).select(F.col("name").alias("table_name"), F.col("key").alias("record_key")).distinct()


def p7_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Whole and edited copies; p7_found has those with an unbroken run of half the item."""
    return leak.copies(table(spark, root, "documents"), table(spark, root, "eval_items")).withColumn("score", F.round("score", 4))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leak.leaks(table(spark, root, "documents"), table(spark, root, "eval_items"), align=False).select("doc_id", "item_id")


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of each source, counted over the selection itself."""
    taken, shares = mix.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))
    real = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("most_copies"))
    return shares.join(real, "source", "left").select(
        "source", "target_share", "max_repeats", "documents", "tokens", F.round("epochs", 6).alias("epochs"), F.coalesce("taken_tokens", F.lit(0)).alias("taken_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round("actual_share", 6).alias("actual_share")
    )


def p8_selection(spark: SparkSession, root: str) -> DataFrame:
    return mix.mix(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0]


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, root, "documents")).select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_canonical": p2_canonical,
    "p3_found": p3_found,
    "p3_repaired": p3_repaired,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_restored": p5_restored,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}
_SPACE = "[\\s\\x{3000}\\x{a0}\\x{85}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}]+"
#: The exact pairs by joining on single members; the other queries have no form that SQL can express.
SQL: dict[str, str] = {
    "p1_found": f"""
with r as (select 'abilities' as s, question_id as k, unnest(any_value(abilities)) as m from question_knowledge group by question_id
  union all select 'abilities', card_id, unnest(any_value(metadata.abilities)) from knowledge_cards group by card_id
  union all select 'question_types', card_id, unnest(any_value(metadata.question_types)) from knowledge_cards group by card_id),
 t as (select distinct s, k, lower(regexp_replace(m, '^{_SPACE}|{_SPACE}$', '', 'g')) as m from r where m is not null), n as (select * from t where m <> ''), c as (select s, k, count(*) as n from n group by s, k),
 b as (select x.s, x.k as l, y.k as r, count(*) as both_ from n x join n y on x.s = y.s and x.m = y.m and x.k < y.k group by all)
select b.s as set_name, l as left_id, r as right_id from b join c x on x.s = b.s and x.k = l join c y on y.s = b.s and y.k = r where 10 * both_ >= 6 * (x.n + y.n - both_)""",
    "p4_found": """
with t as (select candidate_id as k, regexp_replace(lower(coalesce(any_value(title), '') || coalesce(any_value(statement), '')), '[^\\p{L}\\p{N}]', '', 'g') as t from candidate_knowledge group by 1),
 g as (select distinct k, substr(t, i, 3) as m from (select k, t, unnest(range(1, length(t) - 1)) as i from t where length(t) > 2)), c as (select k, count(*) as n from g group by k),
 b as (select x.k as l, y.k as r, count(*) as both_ from g x join g y on x.m = y.m and x.k < y.k group by all)
select l as left_id, r as right_id from b join c x on x.k = l join c y on y.k = r where 10 * both_ >= 6 * (x.n + y.n - both_)""",
}
