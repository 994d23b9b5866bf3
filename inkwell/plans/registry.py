"""Registered queries of the core operators, each beside the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import hostpath, markdown, text, udfs
from inkwell.operators import audit, match, ordered, outline, release
from inkwell.operators.cards import REQUIRED_SECTIONS, SOURCE_KINDS
from inkwell.operators import sets as setops
from inkwell.plans import cases
from inkwell.sources.tables import first_per_key, table
from inkwell.streaming import audit_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# Suffixes of the kinds of material, words that tell answers and papers apart.
KINDS = {"video": [".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v"], "audio": [".mp3", ".m4a", ".wav", ".aac", ".flac", ".ogg"], "image": [".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp"], "document": [".md", ".txt", ".docx"]}
ANSWER, EXAM = "参考答案|答案|评分标准|评分参考", "试卷|试题|考试|题号|选择题"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _first(name: str, key: str) -> str:
    """SQL of first_per_key."""
    return f"(select * from {name} where {key} is not null qualify row_number() over (partition by {key} order by received_at) = 1)"


PAGES, QUESTIONS, CARDS, BLOCKS = _first("page_texts", "page_key"), _first("question_candidates", "candidate_key"), _first("knowledge_cards", "card_id"), _first("blocks", "block_key")
MATERIALS, KNOWLEDGE, CANDIDATES = _first("materials", "doc_id"), _first("question_knowledge", "question_id"), _first("candidate_knowledge", "candidate_id")


def _unique(s, d, name, key, *columns):
    """The table's rows, one a key; only the columns asked for are read."""
    t = table(s, d, name)
    return first_per_key(t.select(*dict.fromkeys([key, *(columns or t.columns), "received_at"])), key)


def _pages(s, d, *columns):
    return _unique(s, d, "page_texts", "page_key", *(columns or ("doc_id", "page_no", "text")))


def _questions(s, d, *columns):
    return _unique(s, d, "question_candidates", "candidate_key", *columns)


def _cards(s, d, *columns):
    return _unique(s, d, "knowledge_cards", "card_id", *columns)


def _blocks(s, d, *columns):
    return _unique(s, d, "blocks", "block_key", *columns)


def _materials(s, d, *columns):
    return _unique(s, d, "materials", "doc_id", *columns)


# --- sources and extraction -----------------------------------------------------------------------


@query(f"""
with t as (select m.doc_id, lower(regexp_extract(m.archived_path, '[^/\\\\.](\\.[^./\\\\]+)$', 1)) as suffix,
    bool_or(regexp_matches(p.text, '{ANSWER}')) as answer, bool_or(regexp_matches(p.text, '{EXAM}')) as exam
  from {MATERIALS} m left join (select * from {PAGES} where page_no <= 2) p using (doc_id) group by all)
select doc_id, suffix, case {' '.join(f"when suffix in ({', '.join(map(repr, v))}) then '{k}'" for k, v in KINDS.items())}
  when suffix <> '.pdf' then 'unsupported' when answer then 'answer_candidate' when exam then 'exam_candidate' else 'document_unknown' end as kind from t
""")
def classify_material(s, d):
    # The first two pages only, chosen before any text is grouped; a repeated page says the same again.
    p = table(s, d, "page_texts").where("page_no <= 2 and page_key is not null").select("doc_id", "text")
    head = p.groupBy("doc_id").agg(F.bool_or(F.col("text").rlike(ANSWER)).alias("answer"), F.bool_or(F.col("text").rlike(EXAM)).alias("exam"))
    m = _materials(s, d, "archived_path").select("doc_id", text.suffix(F.col("archived_path")).alias("suffix")).join(head, "doc_id", "left")
    x, kind = F.col("suffix"), F
    for name, suffixes in KINDS.items():
        kind = kind.when(x.isin(suffixes), name)
    kind = kind.when(x != ".pdf", "unsupported").when(F.col("answer"), "answer_candidate").when(F.col("exam"), "exam_candidate").otherwise("document_unknown")
    return m.select("doc_id", "suffix", kind.alias("kind"))


@query(f"""select page_key, cast(length(regexp_replace(coalesce(text,''), '[^A-Za-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) as bigint) as readable,
  length(regexp_replace(coalesce(text,''), '[^A-Za-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) < 80 as sparse from {PAGES}""")
def sparse_pages(s, d):
    n = text.readable_count(F.coalesce("text", F.lit(""))).cast("bigint")
    return _pages(s, d, "text").select("page_key", n.alias("readable"), (n < 80).alias("sparse"))


@query(f"""select doc_id, count(*) as pages, cast(count_if(n < 80) as bigint) as sparse_pages, case when count_if(n < 80) = 0 then 'text_layer' when count_if(n < 80) = count(*) then 'ocr' else 'hybrid' end as mode
  from (select doc_id, length(regexp_replace(coalesce(text,''), '[^A-Za-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) as n from {PAGES}) group by doc_id""")
def extraction_mode(s, d):
    sparse = text.readable_count(F.coalesce("text", F.lit(""))) < 80
    g = _pages(s, d).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(sparse).alias("sparse_pages"))
    return g.withColumn("mode", F.when(F.col("sparse_pages") == 0, "text_layer").when(F.col("sparse_pages") == F.col("pages"), "ocr").otherwise("hybrid"))


@query(f"""select doc_id, count(*) as page_rows, cast(max(page_no) as bigint) as last_page, max(page_no) - count(distinct page_no) as missing, count(*) - count(distinct page_no) as repeated,
  cast(count_if(text is null or regexp_matches(text, '^\\s*$')) as bigint) as empty_pages from {PAGES} group by doc_id""")
def page_inventory(s, d):
    blank = F.col("text").isNull() | F.col("text").rlike(r"^\s*$")
    g = _pages(s, d).groupBy("doc_id").agg(F.count("*").alias("page_rows"), F.max("page_no").cast("bigint").alias("last_page"), F.count_distinct("page_no").alias("_n"), F.count_if(blank).alias("empty_pages"))
    return g.select("doc_id", "page_rows", "last_page", (F.col("last_page") - F.col("_n")).alias("missing"), (F.col("page_rows") - F.col("_n")).alias("repeated"), "empty_pages")


WIDE = "translate({}, '０１２３４５６７８９', '0123456789')"
_ALL_PAGES = f"(select page_key, doc_id, page_no, text from {PAGES} union all select * from {cases.values_sql(cases.PAGES, 'page_key, doc_id, page_no, text')})"
#: Parts of each page: what stands before the first question, then each question from its number on.
_PARTS = f"(select page_key, doc_id, page_no, string_split(regexp_replace(coalesce(text, ''), '(?m)^(\\s*[0-9０-９]{{1,3}}[.．、])', chr(1) || '\\1', 'g'), chr(1)) as parts from {_ALL_PAGES})"
_ENDS = "regexp_replace({}, '^[\\s\\x{{3000}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{85}}]+|[\\s\\x{{3000}}\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{85}}]+$', '', 'g')"


def _all_pages(s, d):
    return _pages(s, d).select("page_key", "doc_id", "page_no", "text").unionByName(cases.rows(s, cases.PAGES, "page_key string, doc_id string, page_no int, text string"))


@query(f"""with e as (select page_key, unnest(range(1, len(parts))) as ord, parts from {_PARTS}), q as (select page_key, ord, parts[ord + 1] as part from e)
select page_key, cast(ord as int) as ord, cast({WIDE.format("regexp_extract(part, '^\\s*([0-9０-９]{1,3})', 1)")} as int) as number, length({_ENDS.format('part')}) as chars, sha256({_ENDS.format('part')}) as digest from q""")
def question_segments(s, d):
    q = outline.question_segments(_all_pages(s, d), "page_key", "text")
    return q.select("page_key", "ord", "number", F.length("segment").cast("bigint").alias("chars"), F.sha2("segment", 256).alias("digest"))


@query(f"""with p as (select doc_id, page_no, page_key, unnest(range(0, len(parts))) as k, parts from {_PARTS}),
 h as (select doc_id, page_no, page_key, k, parts[k + 1] as part, coalesce((select max(s) from (values {', '.join(f"('{n}', '{p}')" for n, p in outline.SECTIONS.items())}) x(n, p), lateral (select case when regexp_matches(parts[k + 1], p) then struct_pack(at := length(regexp_extract(parts[k + 1], '(?s)^(.*)(?:' || p || ')', 1)), name := n) end as s)).name, null) as head from p),
 c as (select *, last_value(head ignore nulls) over (partition by doc_id order by page_no nulls first, page_key, k rows between unbounded preceding and 1 preceding) as section from h),
 q as (select *, cast({WIDE.format("regexp_extract(part, '^\\s*([0-9０-９]{1,3})', 1)")} as int) as number from c where k > 0),
 w as (select *, lag(number) over (partition by doc_id order by page_no nulls first, page_key, k) as previous from q)
select doc_id, page_no, page_key, cast(k as int) as ord, number, coalesce(section, 'unclassified') as section, case when number <> previous + 1 then '题号从 ' || previous || ' 跳至 ' || number end as warning from w""")
def question_candidates(s, d):
    """Questions of all pages with the section they stand in, over page ends, and gaps in their numbers."""
    return outline.question_candidates(_all_pages(s, d), "doc_id", "page_no", "page_key", "text").drop("segment")


@query(f"""select candidate_key, coalesce(last_value(nullif(section, 'unclassified') ignore nulls) over (partition by doc_id order by page_start nulls first, number nulls first, candidate_key rows unbounded preceding), 'unclassified') as section
  from {QUESTIONS}""")
def section_carry(s, d):
    own = F.when(F.col("section") != "unclassified", F.col("section"))
    q = ordered.carry_forward(_questions(s, d, "doc_id", "page_start", "number", "section"), "doc_id", ["page_start", "number", "candidate_key"], own, "carried", "unclassified")
    return q.select("candidate_key", F.col("carried").alias("section"))


@query(f"""select candidate_key, number, previous, case when previous is not null and number <> previous + 1 then '题号从 ' || previous || ' 跳至 ' || number end as warning from
  (select candidate_key, number, lag(number) over (partition by doc_id order by page_start nulls first, number nulls first, candidate_key) as previous from {QUESTIONS})""")
def sequence_warnings(s, d):
    q = ordered.previous(_questions(s, d, "doc_id", "page_start", "number"), ["doc_id"], ["page_start", "number", "candidate_key"], "number", "previous")
    warn = F.when(F.col("number") != F.col("previous") + 1, F.format_string("题号从 %d 跳至 %d", "previous", "number"))
    return q.select("candidate_key", "number", "previous", warn.alias("warning"))


_VISIBLE = "array_to_string(list_transform(range(1, len(string_split_regex({0}, '(?s)<!--.*?(?:-->|\\z)')) + 1), lambda i: string_split_regex({0}, '(?s)<!--.*?(?:-->|\\z)')[i] || coalesce(regexp_replace(regexp_extract_all({0}, '(?s)<!--.*?(?:-->|\\z)')[i], '[^\\n]', ' ', 'g'), '')), '')"
_MARKDOWN = f"(select card_id, body from {CARDS} where body is not null union all select * from {cases.values_sql(cases.MARKDOWN, 'card_id, body')})"


def _markdown(s, d):
    return _cards(s, d, "body").select("card_id", "body").where("body is not null").unionByName(cases.rows(s, cases.MARKDOWN, "card_id string, body string"))


@query(f"""with v as (select card_id, string_split({_VISIBLE.format('body')}, chr(10)) as lines from {_MARKDOWN}), l as (select card_id, len(lines) as n, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from v),
 h as (select card_id, n, pos, length(regexp_extract(line, '^(#{{1,6}})', 1)) as level, {_ENDS.format("regexp_replace(line, '^#{{1,6}}[ \\t]+', '')").replace('{{', '{').replace('}}', '}')} as title from l where regexp_matches(line, '^#{{1,6}}[ \\t]+[^\\n]'))
select card_id, cast(row_number() over (partition by card_id order by pos) as int) as ord, cast(level as int) as level, title, cast(pos as int) as line,
  cast(coalesce(lead(pos) over (partition by card_id order by pos), n + 1) as int) as direct_end,
  cast(coalesce((select min(b.pos) from h b where b.card_id = h.card_id and b.pos > h.pos and b.level <= h.level), n + 1) as int) as "end",
  cast((select max(b.pos) from h b where b.card_id = h.card_id and b.pos < h.pos and b.level < h.level) as int) as parent from h""")
def heading_outline(s, d):
    return outline.heading_outline(_markdown(s, d), "card_id", "body")


@query(f"""with p as (select card_id, unnest(string_split_regex(chr(10) || body, '\\n## +')) as part, unnest(range(0, len(string_split_regex(chr(10) || body, '\\n## +'))))  as pos from {CARDS} where body is not null),
 t as (select card_id, pos, trim(split_part(part, chr(10), 1), ' ') as title, trim(substr(part, length(split_part(part, chr(10), 1)) + 1), chr(10)) as body from p where pos > 0)
select card_id, title, length(arg_max(body, pos)) as chars, sha256(arg_max(body, pos)) as digest from t group by card_id, title""")
def card_sections(s, d):
    m = outline.section_map(_cards(s, d, "body").where("body is not null"), "card_id", "body")
    return m.select("card_id", "title", F.length("body").cast("bigint").alias("chars"), F.sha2("body", 256).alias("digest"))


def markdown_blocks(s, d):
    b = markdown.markdown_blocks(_cards(s, d, "body").select("card_id", "body"), "card_id", "body")
    return b.select("card_id", "ord", "kind", "level", F.length("text").alias("chars"), F.size("items").alias("items"), F.size("table_rows").alias("table_rows"))


QUERIES["markdown_blocks"] = markdown_blocks


TEXTS = f"(select 'blocks' as table_name, block_key as record_key, text from {BLOCKS} union all select 'knowledge_cards', card_id, body from {CARDS})"


def _texts(s, d):
    own = _blocks(s, d, "text").select(F.lit("blocks").alias("table_name"), F.col("block_key").alias("record_key"), "text")
    return own.unionByName(_cards(s, d, "body").select(F.lit("knowledge_cards").alias("table_name"), F.col("card_id").alias("record_key"), F.col("body").alias("text")))


def _cases(s, values):
    return cases.rows(s, [("cases", k, t) for k, t, *_ in values], "table_name string, record_key string, text string")


_BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^(?:>\\s*)+', ''), '^#{{1,6}}\\s+', ''), '^(?:[-*+]|\\d+[.)、])\\s+', ''), '^\\[[ xX]\\]\\s+', ''), '[。；;]+$', '')"
_UNWRAPPED = "regexp_replace(regexp_replace(regexp_replace({}, '^\\*\\*(.+)\\*\\*$', '\\1'), '^__(.+)__$', '\\1'), '^`(.+)`$', '\\1')"


@query(f"""with l as (select table_name, record_key, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from {TEXTS} where text is not null),
 b as (select table_name, record_key, cast(pos as int) as line, lower({_ENDS.format(_UNWRAPPED.format(_ENDS.format(_BARE.format(_ENDS.format('line')))))}) as placeholder from l)
select * from b where placeholder in ('todo', 'tbd', '待补充', '略', '同上')
union all select 'cases', key, cast(len(string_split(split_part(text, case when key = 'case-09' then 'TODO' else chr(1) end, 1), chr(10))) as int), placeholder from {cases.values_sql(cases.PLACEHOLDER, 'key, text, placeholder')} where placeholder is not null""")
def placeholder_lines(s, d):
    """Lines that are a placeholder by themselves. Comments are text here."""
    l = _texts(s, d).unionByName(_cases(s, cases.PLACEHOLDER)).where("text is not null").select("table_name", "record_key", F.posexplode(F.split("text", "\n")).alias("_at", "_l"))
    l = l.select("table_name", "record_key", (F.col("_at") + 1).alias("line"), text.placeholder_line(F.col("_l")).alias("placeholder"))
    return l.where(F.col("placeholder").isin([p.lower() for p in text.PLACEHOLDERS]))


@query(f"""select table_name, record_key, variable, count(*) as times from (select table_name, record_key, unnest(regexp_extract_all(text, '\\$\\{{[^{{}}\\n]+\\}}')) as variable from {TEXTS}
  union all select 'cases', key, unnest(variables) from {cases.values_sql([v for v in cases.VARIABLES if v[2]], 'key, text, variables')}) group by all""")
def template_variables(s, d):
    """Template variables of each text, and how often. Comments are text here."""
    v = F.regexp_extract_all("text", F.lit(r"\$\{[^{}\n]+\}"), F.lit(0))
    return _texts(s, d).unionByName(_cases(s, cases.VARIABLES)).select("table_name", "record_key", F.explode(v).alias("variable")).groupBy("table_name", "record_key", "variable").agg(F.count("*").alias("times"))


@query(f"""with t as (select block_key, {_VISIBLE.format("coalesce(text, '')")} as text from {BLOCKS}), l as (select block_key, unnest(string_split(text, chr(10))) as raw from t)
select block_key, cast(sum(case when regexp_matches(raw, '^#{{1,6}}[ \\t]+[^\\n]') then 0 else length({_ENDS.format("regexp_replace(regexp_replace(regexp_replace(raw, '^\\\\s*(?:[-*+]\\\\s+|\\\\d+[.)、]\\\\s*)', ''), '[`*_>#|]', '', 'g'), '\\\\$\\\\{[^{}\\\\n]+\\\\}', '', 'g')")}) end) as bigint) as chars from l group by block_key
union all select key, chars from {cases.values_sql(cases.SUBSTANTIVE, 'key, text, chars')}""")
def substantive_length(s, d):
    rows = _blocks(s, d, "text").select("block_key", "text").unionByName(cases.rows(s, [v[:2] for v in cases.SUBSTANTIVE], "block_key string, text string"))
    return rows.select("block_key", text.substantive(F.col("text")).cast("bigint").alias("chars"))


def card_slugs(s, d):
    return _cards(s, d, "metadata").select("card_id", udfs.slug("metadata.title").alias("slug"))


QUERIES["card_slugs"] = card_slugs

# --- the knowledge library ------------------------------------------------------------------------


@query(f"""with p as (select card_id, unnest(string_split_regex(chr(10) || body, '\\n## +')) as part from {CARDS} where body is not null),
 t as (select card_id, trim(split_part(part, chr(10), 1), ' ') as section, length(regexp_replace(substr(part, length(split_part(part, chr(10), 1)) + 1), '\\s', '', 'g')) as chars from p),
 r as (select c.card_id, x.section from {CARDS} c, (select unnest({REQUIRED_SECTIONS}) as section) x)
select r.card_id, r.section, case when max(t.chars) is null then 'missing' when max(t.chars) < 6 then 'empty' else 'present' end as state from r left join t using (card_id, section) group by all""")
def required_sections(s, d):
    cards = _cards(s, d)
    own = cards.where("body is not null").select("card_id", F.explode(F.slice(F.split(F.concat(F.lit("\n"), "body"), r"\n## +"), 1, 2**31 - 1)).alias("_p"))
    own = own.select("card_id", F.trim(F.substring_index("_p", "\n", 1)).alias("section"), F.length(F.regexp_replace(F.expr("substr(_p, length(substring_index(_p, '\n', 1)) + 1)"), r"\s", "")).alias("chars"))
    own = own.groupBy("card_id", "section").agg(F.max("chars").alias("chars"))
    wanted = cards.select("card_id", F.explode(F.array(*map(F.lit, REQUIRED_SECTIONS))).alias("section"))
    return wanted.join(own, ["card_id", "section"], "left").select("card_id", "section", F.when(F.col("chars").isNull(), "missing").when(F.col("chars") < 6, "empty").otherwise("present").alias("state"))


@query(f"""select card_id, path, metadata.title as title, metadata.card_type as card_type, metadata.status as status, array_to_string(list_sort(metadata.modules), ',') as modules,
  array_to_string(list_sort(metadata.question_types), ',') as question_types, array_to_string(list_sort(metadata.abilities), ',') as abilities,
  array_to_string(list_sort(list_transform(metadata.sources, lambda x: x.id)), ',') as sources from {CARDS}""")
def library_index(s, d):
    def joined(c):
        return F.array_join(F.array_sort(c), ",")

    m = F.col("metadata")
    return _cards(s, d).select("card_id", "path", m["title"].alias("title"), m["card_type"].alias("card_type"), m["status"].alias("status"), joined(m["modules"]).alias("modules"), joined(m["question_types"]).alias("question_types"), joined(m["abilities"]).alias("abilities"), joined(F.transform(m["sources"], lambda x: x["id"])).alias("sources"))


@query("""with a as (select card_id, path, metadata.title as title from knowledge_cards), b as (select distinct card_id, path, metadata.title as title from knowledge_cards)
select (select count(*) from (select * from a except all select * from b)) as only_left, (select count(*) from (select * from b except all select * from a)) as only_right""")
def index_difference(s, d):
    rows = table(s, d, "knowledge_cards").select("card_id", "path", F.col("metadata.title").alias("title"))
    return setops.same_rows(rows, rows.distinct())


@query(f"""select card_id, cast(100 * i + 80 * t + 50 * g + 20 * b as int) as score, array_to_string(list_filter([case when i = 1 then 'id' end, case when t = 1 then 'title' end, case when g = 1 then 'tags' end, case when b = 1 then 'body' end], lambda x: x is not null), ',') as matched
 from (select card_id, contains(lower(card_id), '留白的艺术')::int as i, coalesce(contains(regexp_replace(lower(metadata.title), '[\\s\\x{{3000}}\\x{{a0}}\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}]+', '', 'g'), '留白的艺术'), false)::int as t,
   coalesce(contains(regexp_replace(lower(array_to_string(list_concat(list_concat(metadata.modules, metadata.question_types), metadata.abilities), ' ')), '\\s+', '', 'g'), '留白的艺术'), false)::int as g,
   coalesce(contains(regexp_replace(lower(body), '[\\s\\x{{3000}}\\x{{a0}}\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}]+', '', 'g'), '留白的艺术'), false)::int as b from {CARDS}) where i + t + g + b > 0""")
def card_search(s, d):
    m = F.col("metadata")
    tags = F.array_join(F.concat(*[F.coalesce(m[c], F.array().cast("array<string>")) for c in ("modules", "question_types", "abilities")]), " ")
    return match.weighted_search(_cards(s, d), {"id": F.col("card_id"), "title": m["title"], "tags": tags, "body": F.col("body")}, "留白的 艺术")


@query(f"""select card_id, 0 as score, '' as matched from {CARDS} where metadata.status in ('verified', 'stable') and list_has_any(metadata.modules, ['poetry', 'composition'])""")
def card_filter(s, d):
    """The empty query with filters: all cards of two states and two modules, score 0."""
    m = F.col("metadata")
    return match.weighted_search(_cards(s, d, "metadata"), {"title": m["title"]}, "", statuses=(m["status"], ["verified", "stable"]), modules=(m["modules"], ["poetry", "composition"]))


@query(f"""with c as (select candidate_id, regexp_replace(lower(coalesce(title, '') || coalesce(statement, '')), '[\\s\\x{{3000}}\\x{{a0}}\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}]+', '', 'g') as t from {CANDIDATES}),
 k as (select candidate_id, list_distinct(list_concat(regexp_extract_all(t, '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), list_transform(range(1, greatest(length(t) - 2, 1)), lambda i: substr(t, i, 4)))) as k from c)
select candidate_id, len(k) as n, array_to_string(list_sort(k), '|') as tokens from k""")
def token_sets(s, d):
    rows = _unique(s, d, "candidate_knowledge", "candidate_id", "title", "statement")
    k = text.tokens(F.concat_ws(" ", "title", "statement"))
    return rows.select("candidate_id", F.size(k).cast("bigint").alias("n"), F.array_join(F.array_sort(k), "|").alias("tokens"))


_COMPACT = "regexp_replace(lower({}), '[\\s\\x{{3000}}\\x{{a0}}\\x{{85}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}]+', '', 'g')"
_TOKENS = "unnest(list_concat(regexp_extract_all(t, '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), list_transform(range(1, greatest(length(t) - 2, 1)), lambda i: substr(t, i, 4))))".replace("{{", "{").replace("}}", "}")
#: Every question with every card, as the rule is stated: dimensions only within the module, 10 for each of task and evidence, applicable by one of those or by both labels.
_SCORED = f"""q as (select * from {KNOWLEDGE}), c as (select card_id, metadata, body from {CARDS}),
 sp as (select card_id, unnest(string_split_regex(chr(10) || body, '\\n## ')) as part, unnest(range(0, len(string_split_regex(chr(10) || body, '\\n## ')))) as pos from c where body is not null),
 sec as (select card_id, trim(split_part(part, chr(10), 1), ' ') as title, arg_max(substr(part, length(split_part(part, chr(10), 1)) + 1), pos) as body from sp where pos > 0 group by all),
 qt as (select question_id, 'actual_task' as d, {_COMPACT.format("coalesce(task_statement, '')")} as t from q union all select question_id, 'evidence_structure', {_COMPACT.format("coalesce(evidence_anchor, '') || ' ' || coalesce(array_to_string(retrieval_queries, ' '), '')")} from q),
 ct as (select card_id, case title when '知识表述' then 'actual_task' else 'evidence_structure' end as d, {_COMPACT.format('body')} as t from sec where title in ('知识表述', '支持证据')),
 qv as (select distinct question_id, d, {_TOKENS} as v from qt union select question_id, 'question_type', question_type from q union select question_id, 'ability', unnest(abilities) from q),
 cv as (select distinct card_id, d, {_TOKENS} as v from ct union select card_id, 'question_type', unnest(metadata.question_types) from c union select card_id, 'ability', unnest(metadata.abilities) from c),
 pairs as (select q.question_id, c.card_id from q, c where list_contains(c.metadata.modules, q.module)),
 met as (select distinct question_id, card_id, d from qv join cv using (d, v) where v <> ''),
 s as (select question_id, card_id, count_if(coalesce(d, '') in ('actual_task', 'evidence_structure')) as core, count_if(coalesce(d, '') in ('question_type', 'ability')) as labels, list(d) as ds from pairs left join met using (question_id, card_id) group by all),
 j as (select *, core > 0 or labels = 2 as ok, cast(10 * core + core + labels as int) as score from s)"""


def _match_sides(s, d):
    evidence = F.concat_ws(" ", F.col("evidence_anchor"), F.col("retrieval_queries"))
    q = _unique(s, d, "question_knowledge", "question_id", "module", "question_type", "abilities", "task_statement", "evidence_anchor", "retrieval_queries").select("question_id", "module", "question_type", "abilities", F.col("task_statement").alias("statement"), evidence.alias("evidence"))
    m = F.col("metadata")
    c = _cards(s, d, "metadata", "body").select("card_id", m["status"].alias("status"), m["modules"].alias("modules"), m["question_types"].alias("question_types"), m["abilities"].alias("abilities"), text.section(F.col("body"), "知识表述").alias("statement"), text.section(F.col("body"), "支持证据").alias("evidence"))
    return q, c


@query(f"""with {_SCORED}, g as (select question_id, count_if(ok) as applicable, count_if(not ok and labels > 0) as single_label, count_if(not ok and labels = 0) as unrelated, max(score) filter (ok) as best_score from j group by 1),
 b as (select question_id, min(card_id) as best_card from j join g using (question_id) where ok and score = best_score group by 1)
select question_id, coalesce(applicable, 0) as applicable, coalesce(single_label, 0) as single_label, coalesce(unrelated, 0) as unrelated, (select count(*) from c) - coalesce(applicable + single_label + unrelated, 0) as other_module, best_score, best_card from q left join g using (question_id) left join b using (question_id)""")
def question_card_match(s, d):
    """Per question: how many cards are applicable, share one label, share nothing, are of another module; the
    best score and the first card with it. Over all questions and cards, in all four dimensions."""
    return match.best_matches(*_match_sides(s, d))


@query(f"""with {_SCORED} select question_id, count(*) as pairs, cast(count_if(ok) as bigint) as applicable, cast(sum(score) as bigint) as scores, cast(count_if(list_contains(ds, 'actual_task')) as bigint) as by_task, cast(count_if(list_contains(ds, 'evidence_structure')) as bigint) as by_evidence,
  cast(count_if(list_contains(ds, 'question_type')) as bigint) as by_type, cast(count_if(list_contains(ds, 'ability')) as bigint) as by_ability from j where core + labels > 0 group by 1""")
def matched_dimensions(s, d):
    """Per question the pairs that have a dimension in common, by dimension."""
    has = lambda n: F.count_if(F.array_contains("dimensions", n))
    p = match.match_pairs(*_match_sides(s, d)).groupBy("question_id")
    return p.agg(F.count("*").alias("pairs"), F.count_if(F.col("applicability") == "applicable").alias("applicable"), F.sum("score").alias("scores"), has("actual_task").alias("by_task"), has("evidence_structure").alias("by_evidence"), has("question_type").alias("by_type"), has("ability").alias("by_ability"))


@query(f"""with {_SCORED}, o as (select question_id, card_id from j join c using (card_id) where ok and coalesce(metadata.status, '') not in ('review_required', 'deprecated'))
select question_id, case when count(card_id) = 0 then 'not_applicable' else 'applicable' end as decision, coalesce(array_to_string(list_sort(list(card_id) filter (card_id is not null)), ','), '') as card_ids from q left join o using (question_id) group by 1""")
def pre_decisions(s, d):
    q, c = _match_sides(s, d)
    p = match.pre_decisions(match.match_pairs(q, c), q, c, ["review_required", "deprecated"])
    return p.select("question_id", "decision", F.array_join("card_ids", ",").alias("card_ids"))


@query(f"""with s as (select distinct x.id as id, x.kind as kind from (select unnest(metadata.sources) as x from {CARDS}))
select c.candidate_id, c.source.id as source_id, case when c.source.id is null then 'missing_source' when not exists (select 1 from s where s.id = c.source.id) then 'unknown_source'
  when not exists (select 1 from s where s.id = c.source.id and s.kind = c.source.kind) then 'kind_mismatch' else 'bound' end as state from {CANDIDATES} c""")
def source_binding(s, d):
    known = _cards(s, d).select(F.explode("metadata.sources").alias("x")).where("x.id is not null").groupBy(F.col("x.id").alias("source_id")).agg(F.collect_set("x.kind").alias("kinds"))
    c = first_per_key(table(s, d, "candidate_knowledge").select("candidate_id", "source", "received_at"), "candidate_id").select("candidate_id", F.col("source.id").alias("source_id"), F.col("source.kind").alias("kind"))
    state = F.when(F.col("source_id").isNull(), "missing_source").when(F.col("kinds").isNull(), "unknown_source").when(F.coalesce(F.array_contains("kinds", F.col("kind")), F.lit(False)), "bound").otherwise("kind_mismatch")
    return c.join(known, "source_id", "left").select("candidate_id", "source_id", state.alias("state"))


@query(f"""select candidate_id, regexp_matches(source.locator, '^(?i:file:)|^/|^[A-Za-z]:[\\\\/]|^\\\\\\\\') as absolute, list_contains(string_split(replace(split_part(source.locator, '#', 1), '\\', '/'), '/'), '..') as escapes,
  list_contains({SOURCE_KINDS}, source.kind) as known_kind, trim(source.name, ' ') is null as nameless from {CANDIDATES}""")
def locator_checks(s, d):
    c = first_per_key(table(s, d, "candidate_knowledge").select("candidate_id", "source", "received_at"), "candidate_id")
    loc = F.col("source.locator")
    return c.select("candidate_id", text.is_absolute_locator(loc).alias("absolute"), text.escapes_root(loc).alias("escapes"), F.col("source.kind").isin(SOURCE_KINDS).alias("known_kind"), F.col("source.name").isNull().alias("nameless"))


@query(f"""with a as (select distinct unnest(abilities) as v, card_id from (select metadata.abilities as abilities, card_id from {CARDS})), q as (select distinct unnest(abilities) as v from {KNOWLEDGE})
select c.card_id, array_to_string(list_sort(coalesce(list(a.v) filter (a.v is not null and not exists (select 1 from q where q.v = a.v)), [])), '、') as unasked from {CARDS} c left join a on a.card_id = c.card_id group by c.card_id""".replace("list(a.v) filter (a.v is not null and not exists (select 1 from q where q.v = a.v))", "list(a.v) filter (a.v is not null and a.v not in (select v from q where v is not null))"))
def missing_list(s, d):
    """Per card the abilities that no question asks for, joined in order."""
    cards = _cards(s, d, "metadata").select("card_id", F.explode_outer("metadata.abilities").alias("v")).distinct()
    asked = table(s, d, "question_knowledge").select(F.explode("abilities").alias("v")).distinct().withColumn("asked", F.lit(True))
    g = cards.join(asked, "v", "left").groupBy("card_id").agg(F.collect_list(F.when(F.col("asked").isNull(), F.col("v"))).alias("l"))
    return g.select("card_id", F.array_join(F.array_sort("l"), "、").alias("unasked"))


# --- digests, duplicates, coverage ----------------------------------------------------------------


@query("select sha256(text) as digest, min(doc_id) as first_key, count(*) as copies from documents where text is not null group by text having count(*) > 1")
def duplicate_groups(s, d):
    return setops.exact_groups(table(s, d, "documents").select("doc_id", "text"), "doc_id", F.col("text")).where("copies > 1")


@query("select sha256(text) as digest, min(doc_id) as first_key, count(*) as copies from documents where text is not null group by text")
def dedup_sha256(s, d):
    return setops.exact_groups(table(s, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"))


@query("select sha256(text) as digest, min(doc_id) as first_key from documents i where crawled_at >= timestamp '2025-01-01' and text is not null and not exists (select 1 from documents k where k.crawled_at < timestamp '2025-01-01' and k.text = i.text) group by text")
def new_material_delta(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", "crawled_at")
    cut = F.lit("2025-01-01").cast("timestamp")
    return setops.new_content(docs.where(F.col("crawled_at") >= cut), docs.where(F.col("crawled_at") < cut), "doc_id", "text")


@query(f"""with t as (select doc_id, number, candidate_key, sha256(coalesce(text, '')) as digest, row_number() over w as version, lag(sha256(coalesce(text, ''))) over w as previous from {QUESTIONS} window w as (partition by doc_id, number order by candidate_key))
select doc_id, number, candidate_key, cast(version as int) as version, digest, previous, case when previous is null then 'initial' when previous <> digest then 'content_changed' else 'unchanged' end as change from t""")
def revision_ledger(s, d):
    return setops.revision_ledger(_questions(s, d, "doc_id", "number", "text"), ["doc_id", "number"], "candidate_key", "text")


@query("""select doc_id, sha256(string_agg(line, chr(10) order by line)) as fingerprint, count(*) as n from (select doc_id, coalesce(sha256, '') || ':' || coalesce(material_type, '') || ':' || coalesce(archived_path, '') as line from materials) group by doc_id""")
def materials_fingerprint(s, d):
    line = F.concat_ws(":", F.coalesce("sha256", F.lit("")), F.coalesce("material_type", F.lit("")), F.coalesce("archived_path", F.lit("")))
    return table(s, d, "materials").groupBy("doc_id").agg(setops.ordered_fingerprint(F.collect_list(line)).alias("fingerprint"), F.count("*").alias("n"))


@query(f"""with e as (select candidate_key, count(*) as expected_rows from {QUESTIONS} group by 1), a as (select candidate_key, count(*) as actual_rows from {KNOWLEDGE} where candidate_key is not null group by 1)
select candidate_key, case when actual_rows is null then 'missing' when expected_rows is null then 'extra' when expected_rows > 1 or actual_rows > 1 then 'duplicate' else 'matched' end as state, coalesce(expected_rows, 0) as expected_rows, coalesce(actual_rows, 0) as actual_rows
from e full join a using (candidate_key)""")
def coverage_check(s, d):
    return setops.coverage(_questions(s, d, "doc_id"), _unique(s, d, "question_knowledge", "question_id", "candidate_key"), "candidate_key")


@query(f"""select k.question_id, q.section, k.module, q.section is not null and q.section <> 'unclassified' and q.section <> k.module as conflict from {KNOWLEDGE} k join {QUESTIONS} q using (candidate_key)""")
def module_conflicts(s, d):
    k = first_per_key(table(s, d, "question_knowledge").select("question_id", "candidate_key", "module", "received_at"), "question_id")
    j = k.join(_questions(s, d, "section").select("candidate_key", "section"), "candidate_key")
    return j.select("question_id", "section", "module", F.coalesce((F.col("section") != "unclassified") & (F.col("section") != F.col("module")), F.lit(False)).alias("conflict"))


@query("""with g as (select page_key, sha256(arg_min(coalesce(text, ''), received_at)) as a, sha256(arg_max(coalesce(text, ''), received_at)) as b from page_texts group by page_key) select page_key, a = b as valid from g""")
def receipt_check(s, d):
    g = table(s, d, "page_texts").groupBy("page_key").agg(F.sha2(F.min_by(F.coalesce("text", F.lit("")), "received_at"), 256).alias("first"), F.sha2(F.max_by(F.coalesce("text", F.lit("")), "received_at"), 256).alias("last"))
    return setops.receipt(g.select("page_key", F.col("first").alias("digest")), g.select("page_key", F.col("last").alias("digest")), "page_key", "digest")


@query("select page_key, count(*) as copies from page_texts where page_key is not null group by page_key having count(*) > 1")
def duplicate_ids(s, d):
    return table(s, d, "page_texts").where("page_key is not null").groupBy("page_key").agg(F.count("*").alias("copies")).where("copies > 1")


@query(f"""with p as (select archived_path as path from materials where archived_path is not null union all select path from {cases.values_sql(cases.FILES, 'path, ok')} union all select * from (values ('docs/STRASSE.md'), ('docs/straße.md'), ('docs/e' || chr(769) || '.md')))
select replace(lower(nfc_normalize(path)), 'ß', 'ss') as folded, count(distinct path) as spellings, count(*) as rows_ from p group by 1 having count(*) > 1""")
def path_collisions(s, d):
    """Paths that are one but for case and composition."""
    extra = cases.rows(s, [(p,) for p, _ in cases.FILES] + [("docs/STRASSE.md",), ("docs/straße.md",), ("docs/e\u0301.md",)], "path string")
    g = table(s, d, "materials").where("archived_path is not null").select(F.col("archived_path").alias("path")).unionByName(extra).groupBy(udfs.casefold(udfs.nfc("path")).alias("folded"))
    return g.agg(F.count_distinct("path").alias("spellings"), F.count("*").alias("rows_")).where("rows_ > 1")


@query("""select regexp_extract(l, '^(?i:https?://)?([^/\\s:?#]+)', 1) as host, count(*) as links from (select unnest(regexp_extract_all(text, '(?i:https?://|www\\.)[^\\s<>"|,，;；]+')) as l from documents) group by 1""")
def link_hosts(s, d):
    l = F.explode(F.regexp_extract_all("text", F.lit(r"(?i:https?://|www\.)[^\s<>\"|,，;；]+"), F.lit(0)))
    return table(s, d, "documents").select(l.alias("l")).groupBy(F.regexp_extract("l", r"^(?i:https?://)?([^/\s:?#]+)", 1).alias("host")).agg(F.count("*").alias("links"))


@query(f"""with p as (select distinct path from (select archived_path as path from materials union all select path from blocks union all select path from knowledge_cards) where path is not null)
select path, not regexp_matches(path, '^/|^[A-Za-z]:|[\\\\<>:"|?*\\x00-\\x1f\\x7f]|//|(?:^|/)[ .]|[. ](?:/|$)|(?i)(?:^|/)(?:con|prn|aux|nul|clock\\$|conin\\$|conout\\$|(?:com|lpt)[1-9¹²³])(?:\\.[^/]*)?(?:/|$)') as portable, regexp_matches(path, '^cards/[^/]+/[^/]+\\.md$') as is_card from p
union select path, ok, false from {cases.values_sql(cases.FILES, 'path, ok')}""")
def portable_paths(s, d):
    """Every path that a table names: whether it is safe on any system, and whether it is a card's."""
    named = table(s, d, "materials").select(F.col("archived_path").alias("path")).unionByName(table(s, d, "blocks").select("path")).unionByName(table(s, d, "knowledge_cards").select("path"))
    p = F.col("path")
    d = named.where("path is not null").unionByName(cases.rows(s, [(x,) for x, _ in cases.FILES], "path string")).distinct()
    return d.select("path", release.is_portable(p, udfs.nfc(p)).alias("portable"), p.rlike(r"^cards/[^/]+/[^/]+\.md$").alias("is_card"))


@query("""with g as (select l_orderkey, l_returnflag, max(l_quantity) as q from lineitem group by all) select l_orderkey, cast(sum(q) as bigint) as granted, count(*) as groups_ from g group by l_orderkey""")
def group_best_totals(s, d):
    """Per key the sum over its groups of the best value of each: substitutes count once."""
    best = table(s, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_quantity").alias("q"))
    return best.groupBy("l_orderkey").agg(F.sum("q").cast("bigint").alias("granted"), F.count("*").alias("groups_"))


@query("""with o as (select user_id, event_id, ts, lag(ts) over (partition by user_id order by event_id) as before from events) select user_id, event_id, cast(epoch_us(ts) - epoch_us(before) as bigint) as gap_us, before is not null and before >= ts as overlaps from o""")
def event_gaps(s, d):
    """Time since the user's event before, and whether the two are out of order."""
    e = ordered.previous(table(s, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["event_id"], "ts", "before")
    return e.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))).alias("gap_us"), F.coalesce(F.col("before") >= F.col("ts"), F.lit(False)).alias("overlaps"))


# --- audit and events -----------------------------------------------------------------------------


_CASE_CODES = [(-1 - k, t, c) for k, (t, c) in enumerate(cases.AUDIT)]
_SECRETS = audit._OUTRIGHT.replace("'", "''")
_LOCAL = "A-Za-z0-9.!#$%&''*+=?^_`{|}~-"
#: A host path outside links and addresses, without look-around.
_ROOTED = "(?:^|[^\\p{L}\\p{N}_:/.-])/(?:(?:" + "|".join(hostpath.ROOTS) + ")(?:$|[/.,;:!?\\s''\"<>()\\[\\]{}])|[A-Za-z0-9_\\x{3400}-\\x{9fff}.~+-][^\\s''\"<>()\\[\\]{}/]*/+[^\\s''\"<>()\\[\\]{}]*[^\\s''\"<>()\\[\\]{}/.,;:!?])|(?i:file:[\\\\/])|(?:^|[^A-Za-z0-9\\\\])[A-Za-z]:[\\\\/]|(?:^|[^:/])//[A-Za-z0-9._-]+/[A-Za-z0-9._~-]"
_NO_ADDRESS = "regexp_replace(text, '(?i)https?://[^\\s<>\"'']+', ' ', 'g')"


@query(f"""with named as (select doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:{'|'.join(audit.KEYS)})\\b\\s*[:=]\\s*(?:''([^''\\r\\n]*)''|"([^"\\r\\n]*)"|([^\\s,;}}{{]+))')) as m from documents),
 bad as (select distinct doc_id from (select doc_id, regexp_replace(regexp_replace(m, '^[^:=]*[:=]\\s*', ''), '^[''"]|[''"]$', '', 'g') as v from named) where length(v) >= 4 and lower(v) not in ({', '.join(map(repr, audit.STAND_INS))}) and not regexp_matches(v, '^<YOUR_[A-Z0-9_]+>$|^\\$\\{{[A-Z][A-Z0-9_]*\\}}$')
   union select doc_id from documents where regexp_matches(text, '{_SECRETS}') or regexp_matches(text, '(?i)\\btoken\\b\\s*[:=]\\s*[''"][^''"\\r\\n]{{12,}}[''"]')),
 i as (select doc_id, 'secret_pattern' as code from bad union all select doc_id, 'identity_pattern' from documents where regexp_matches(text, '(?i)(?:^|[^{_LOCAL}])[{_LOCAL}]+@[A-Z0-9](?:[A-Z0-9.-]{{0,251}}[A-Z0-9])?\\.[A-Z]{{2,63}}\\b')
   union all select doc_id, 'private_term' from documents where contains(lower(text), 'grandmother') union all select doc_id, 'web_link' from documents where regexp_matches(text, '(?i)https?://|www\\.')
   union all select doc_id, 'absolute_path' from documents where regexp_matches({_NO_ADDRESS}, '{_ROOTED}'))
select doc_id, code from i union all select doc_id, unnest(codes) from {cases.values_sql([v for v in _CASE_CODES if v[2]], 'doc_id, text, codes')}""")
def text_audit_issues(s, d):
    """Issues of every document: secrets, mail addresses, host paths, a private term, web links."""
    rows = table(s, d, "documents").select("doc_id", "text").unionByName(cases.rows(s, [v[:2] for v in _CASE_CODES], "doc_id long, text string"))
    link = (F.col("doc_id") >= 0) & F.col("text").rlike(r"(?i)https?://|www\.")
    return audit.audit_issues(rows, "doc_id", "text", terms=["grandmother"], contacts=["project-contact@example.org"], checks={"web_link": link})


@query(f"""select doc_id, regexp_matches({_NO_ADDRESS}, '{_ROOTED}') as host_path from documents union all select doc_id, list_contains(codes, 'absolute_path') from {cases.values_sql([(k, t, c or ['none']) for k, t, c in _CASE_CODES], 'doc_id, text, codes')}""")
def path_scan(s, d):
    rows = table(s, d, "documents").select("doc_id", "text").unionByName(cases.rows(s, [v[:2] for v in _CASE_CODES], "doc_id long, text string"))
    return rows.select("doc_id", hostpath.names_host_path(F.col("text")).alias("host_path"))


@query(f"""select archived_path as path, archived_path as decoded from {MATERIALS} where not contains(archived_path, '%') union all select * from {cases.values_sql(cases.DECODED, 'path, decoded')}""")
def decoded_paths(s, d):
    rows = _materials(s, d, "archived_path").select(F.col("archived_path").alias("path")).unionByName(cases.rows(s, [v[:1] for v in cases.DECODED], "path string"))
    return rows.select("path", hostpath.percent_decoded(F.col("path")).alias("decoded"))


@query(f"""select question_id, regexp_replace(question_id, '^\\s+|\\s+$', '', 'g') as identifier, evidence_anchor is null or regexp_matches(evidence_anchor, '^\\s*$') as no_anchor from question_knowledge
union all select identifier, normal, true from {cases.values_sql(cases.IDENTIFIERS, 'identifier, normal')}""")
def identifiers(s, d):
    q = table(s, d, "question_knowledge").select("question_id", "evidence_anchor").unionByName(cases.rows(s, [(v, None) for v, _ in cases.IDENTIFIERS], "question_id string, evidence_anchor string"))
    return q.select("question_id", text.normal_identifier(F.col("question_id")).alias("identifier"), (F.col("evidence_anchor").isNull() | F.col("evidence_anchor").rlike(r"^\s*$")).alias("no_anchor"))


@query("select event_type, cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by all")
def event_props(s, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(s, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@query("select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id, event_type")
def latest_event(s, d):
    return audit_log.latest_per_key(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id"])


@query("select event_type, user_id, count(*) as n from events group by all")
def stream_counts(s, d):
    source = table(s, d, "events")
    return audit_log.counts_from_stream(s, f"{d}/events*.parquet", source.schema, ["event_type", "user_id"])


@query(f"""with i as (select 'warning' as level, 'sequence_gap' as code, doc_id as path from {QUESTIONS} where sequence_warning is not null union all select 'error', 'empty_page', doc_id from {PAGES} where text is null or regexp_matches(text, '^\\s*$'))
select path, cast(count_if(level = 'error') as bigint) as errors, cast(count_if(level = 'warning') as bigint) as warnings from i group by path""")
def issue_rollup(s, d):
    q = _questions(s, d).where("sequence_warning is not null").select(F.lit("warning").alias("level"), F.lit("sequence_gap").alias("code"), F.col("doc_id").alias("path"))
    p = _pages(s, d).where(F.col("text").isNull() | F.col("text").rlike(r"^\s*$")).select(F.lit("error").alias("level"), F.lit("empty_page").alias("code"), F.col("doc_id").alias("path"))
    return q.unionByName(p).groupBy("path").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
