"""Questions, sections and heading outlines of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import blanked_comments, digits, heading_name, strip
from inkwell.operators.ordered import carry_forward, previous

#: Section names and the headings that begin them (fixed values).
SECTIONS = {
    "reading_1": r"(?:信息类文本|非连续性文本)阅读",
    "reading_2": r"(?:文学类文本|小说|散文)阅读",
    "classical_chinese": r"文言文阅读|阅读\s*[ⅢIII三]",
    "poetry": r"古代诗歌阅读|阅读\s*[ⅣIV四]",
    "language_use": r"语言文字运用",
    "composition": r"(?:^|\n)\s*(?:三、)?写作",
}
_MARK = "\u0001"
_NUMBER = r"\s*(\d{1,3})[.．、]"


def _parts(text: str) -> Column:
    """What stands before a page's first question, and each question from its number on."""
    return F.split(F.regexp_replace(text, rf"(?mdU)^{_NUMBER}", rf"{_MARK}$0"), _MARK)


def _number(part: Column) -> Column:
    return digits(F.regexp_extract(part, rf"(?U)^{_NUMBER}", 1)).cast("int")


def question_segments(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, number, segment): the numbered questions of each page's text, in order.

    A line that begins with one to three digits of any script and a dot or 、 begins a question, which
    goes to the next one or the end of the page and keeps its number; what stands before the first is
    left out. Null texts have none.
    """
    d = pages.select(key, F.posexplode(_parts(text)).alias("ord", "part")).where("ord > 0")
    return d.select(key, "ord", _number(F.col("part")).alias("number"), strip(F.col("part")).alias("segment"))


def last_section(text: Column) -> Column:
    """Name of the section whose heading stands last in a text, of several at one place the last by name; else null."""
    at = [F.when(text.rlike(p), F.struct(F.length(F.regexp_extract(text, rf"(?s)^(.*)(?:{p})", 1)).alias("at"), F.lit(n).alias("name"))) for n, p in SECTIONS.items()]
    return F.element_at(F.array_sort(F.array_compact(F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("name")), *at))), -1)["name"]


def question_candidates(pages: DataFrame, doc: str, page: str, key: str, text: str) -> DataFrame:
    """(doc, page, key, ord, number, section, segment, warning) of the questions of pages(doc, page, key, text).

    section is the last heading before the question in its document, on any page, or 'unclassified';
    warning says where a number doesn't follow the one before it in the document. Pages are in the
    order of `page`, nulls first, then of `key`. Null texts are empty pages.
    """
    d = pages.select(doc, page, key, _parts(F.coalesce(F.col(text), F.lit(""))).alias("_p"))
    # The heading that counts for part k stands in part k - 1; a last row takes a page's own last one on.
    steps = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda k: F.struct(k.alias("ord"), F.get("_p", k - 1).alias("behind"), F.get("_p", k).alias("part")))
    d = d.select(doc, page, key, F.explode(steps).alias("s")).select(doc, page, key, "s.ord", last_section(F.col("s.behind")).alias("_h"), "s.part")
    d = carry_forward(d, doc, [page, key, "ord"], F.col("_h"), "section", "unclassified").where("part is not null")
    d = d.select(doc, page, key, "ord", _number(F.col("part")).alias("number"), "section", strip(F.col("part")).alias("segment"))
    d = previous(d, [doc], [page, key, "ord"], "number", "_before")
    return d.withColumn("warning", F.when(F.col("number") != F.col("_before") + 1, F.format_string("题号从 %d 跳至 %d", "_before", "number"))).drop("_before")


def text_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, line, text, level, title): lines of Markdown texts, numbered from 1, of n; level and title of headings.

    Comments are no text but keep their lines, closed or not. Code fences are not known: headings in them count.
    """
    lines = F.split(blanked_comments(F.col(text)), "\n")
    d = docs.select(key, F.size(lines).alias("n"), F.posexplode(lines).alias("_at", "text"))
    heading = r"^(#{1,6})[ \t]+([^\n]+)$"
    level = F.when(F.col("text").rlike(heading), F.length(F.regexp_extract("text", heading, 1)))
    return d.select(key, "n", (F.col("_at") + 1).alias("line"), "text", level.alias("level"), F.when(level.isNotNull(), strip(F.regexp_extract("text", heading, 2))).alias("title"))


def _by_level(level: Column, values: list[Column]) -> Column:
    out = F.lit(None)
    for k, v in enumerate(values, 1):
        out = F.when(level == k, v).otherwise(out)
    return out


def heading_outline(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, level, title, line, direct_end, end, parent): headings of Markdown texts.

    line is 1-based; direct_end is the line of the next heading, end that of the next one of the same
    or a higher level; both are one beyond the last line where there is none. parent is the line of the
    heading that the heading stands under. Every frame runs from one end of a text, so the work grows
    with the number of headings, not with its square.
    """
    d = text_lines(docs, key, text).where("level is not null").drop("text")
    down, up = Window.partitionBy(key).orderBy("line"), Window.partitionBy(key).orderBy(F.desc("line"))
    later, before = up.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda k: F.when(F.col("level") <= k, F.col("line"))
    end = _by_level(F.col("level"), [F.last(at(k), ignorenulls=True).over(later) for k in range(1, 7)])
    parent = _by_level(F.col("level"), [F.lit(None).cast("int"), *[F.last(at(k), ignorenulls=True).over(before) for k in range(1, 6)]])
    beyond = F.col("n") + 1
    return d.select(key, F.row_number().over(down).alias("ord"), "level", "title", "line", F.coalesce(F.lead("line").over(down), beyond).alias("direct_end"), F.coalesce(end, beyond).alias("end"), parent.alias("parent"))


def direct_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, head, line, text): each line that is no heading, with the line of the heading it stands under (null before the first)."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = text_lines(docs, key, text).withColumn("head", F.last(F.when(F.col("level").isNotNull(), F.col("line")), ignorenulls=True).over(w))
    return d.where("level is null").select(key, "head", "line", "text")


def first_headings(headings: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, name, line): the first heading of each text that is `name` or begins with it and a colon."""
    own = heading_name(F.col("title"))
    hits = F.array_compact(F.array(*[F.when((own == n) | own.startswith(n + "：") | own.startswith(n + ":"), F.lit(n)) for n in names]))
    return headings.select(key, "line", F.explode(hits).alias("name")).groupBy(key, "name").agg(F.min("line").alias("line"))


def section_map(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, body) of the '## ' sections; of sections with one title the last counts. Comments are text here."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"(?U)\n## (?=[^\n])")
    d = docs.select(key, F.posexplode(parts).alias("_at", "_part")).where("_at > 0")
    d = d.withColumn("title", strip(F.substring_index("_part", "\n", 1))).withColumn("body", strip(F.expr("substr(_part, length(substring_index(_part, '\n', 1)) + 1)")))
    return d.groupBy(key, "title").agg(F.max_by("body", "_at").alias("body"))
