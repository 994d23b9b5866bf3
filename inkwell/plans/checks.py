"""Registered queries of the operators that check collections, cards and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import cards, evidence, release
from inkwell.operators import sets as setops
from inkwell.plans import cases
from inkwell.plans.cut import cut
from inkwell.plans.registry import BLOCKS, CARDS, MATERIALS, PAGES, _blocks, _cards, _materials, _pages, query
from inkwell.sources import files
from inkwell.sources.tables import table

_ISSUES = cases.values_sql([(k, i) for k, _, issues in cases.COLLECTIONS for i in (issues or [None])], "key, issue")


@query(f"""select key, split_part(issue, '|', 1) as code, split_part(issue, '|', 2) as id, split_part(issue, '|', 3) as detail from {_ISSUES} where issue is not null
union all select card_id, 'missing_question_inventory', '', '' from {CARDS} where body is not null""")
def collection_issues(s, d):
    """Question collections (and all cards' bodies, which hold none) against their own inventory: choices, subjective questions, scores."""
    docs = _cards(s, d, "body").select(F.col("card_id").alias("key"), "body").unionByName(cases.rows(s, [c[:2] for c in cases.COLLECTIONS], "key string, body string"))
    questions, broken = evidence.question_inventory(docs, "key", "body")
    questions = cut(questions)
    choice = evidence.choice_evidence(docs, questions, "key", "body", cases.FIELDS)
    steps = evidence.subjective_chains(docs, questions, "key", "body", cases.STEPS)
    scores = evidence.score_allocations(docs, questions, "key", "body")
    empty = F.lit("")
    return (
        broken.select("key", "code", empty.alias("id"), F.coalesce(F.col("ord").cast("string"), empty).alias("detail"))
        .unionByName(choice.select("key", "code", "id", F.coalesce(F.concat_ws(":", "option", "missing"), empty).alias("detail")))
        .unionByName(steps.select("key", "code", "id", F.coalesce("missing", empty).alias("detail")))
        .unionByName(scores.select("key", "code", "id", empty.alias("detail")))
    )


_IN = "', '".join


@query(f"""with c as (select *, metadata as m from {CARDS}), x as (select card_id, path, unnest(m.sources) as s from c where m.sources is not null),
 i as (select card_id, path, unnest(['schema_version', 'title', 'card_type', 'status', 'risk_level', 'modules', 'question_types', 'abilities', 'sources']) as f, m from c),
 e as (select card_id, path, 'missing_metadata' as code from i where case f when 'schema_version' then m.schema_version is null when 'title' then m.title is null when 'card_type' then m.card_type is null when 'status' then m.status is null when 'risk_level' then m.risk_level is null when 'modules' then m.modules is null when 'question_types' then m.question_types is null when 'abilities' then m.abilities is null else m.sources is null end
  union all select card_id, path, 'unsupported_schema_version' from c where m.schema_version is distinct from {cards.VERSION}
  union all select card_id, path, 'invalid_title' from c where coalesce(trim(m.title), '') = ''
  union all select card_id, path, 'invalid_card_type' from c where coalesce(m.card_type, '') not in ('{_IN(cards.PREFIXES)}')
  union all select card_id, path, 'invalid_id' from c where m.card_type in ('{_IN(cards.PREFIXES)}') and not regexp_full_match(card_id, case m.card_type {' '.join(f"when '{k}' then '{v}'" for k, v in cards.PREFIXES.items())} end || '-[0-9]{{4}}')
  union all select card_id, path, 'invalid_status' from c where coalesce(m.status, '') not in ('{_IN(cards.STATUSES)}')
  union all select card_id, path, 'invalid_risk_level' from c where coalesce(m.risk_level, '') not in ('{_IN(cards.RISKS)}')
  union all select card_id, path, 'invalid_module' from c where coalesce(len(m.modules), 0) = 0 or len(list_filter(m.modules, lambda v: coalesce(v, '') not in ('{_IN(cards.MODULES)}'))) > 0
  union all select card_id, path, 'invalid_question_types' from c where coalesce(len(m.question_types), 0) = 0 or len(list_filter(m.question_types, lambda v: trim(coalesce(v, ''), ' 　') = '')) > 0
  union all select card_id, path, 'invalid_abilities' from c where coalesce(len(m.abilities), 0) = 0 or len(list_filter(m.abilities, lambda v: trim(coalesce(v, ''), ' 　') = '')) > 0
  union all select card_id, path, 'missing_section' from (select card_id, path, body, unnest({cards.REQUIRED_SECTIONS}) as t from c) where not regexp_matches(coalesce(body, ''), '(?m)^## ' || t || '\\s*$') or regexp_matches(body, '(?m)^## ' || t || '\\s*(?:\\n\\s*)*(?:^## |\\z)')
  union all select card_id, path, 'missing_source' from c where coalesce(len(m.sources), 0) = 0
  union all select card_id, path, 'invalid_source_id' from x where coalesce(trim(s.id), '') = '' or regexp_matches(s.id, '\\p{{C}}')
  union all select card_id, path, 'noncanonical_source_id' from x where trim(s.id) <> '' and not regexp_matches(s.id, '\\p{{C}}') and trim(s.id) <> s.id
  union all select card_id, path, 'invalid_source' from x where coalesce(trim(s.id), '') = '' or coalesce(trim(s.kind), '') = '' or coalesce(trim(s.name), '') = '' or coalesce(trim(s.locator), '') = ''
  union all select card_id, path, 'invalid_source' from x where coalesce(s.kind, '') not in ('{_IN(cards.SOURCE_KINDS)}')
  union all select card_id, path, 'invalid_source' from x where coalesce(trim(s.locator), '') = ''
  union all select card_id, path, 'absolute_path' from x where regexp_matches(s.locator, '^(?i:file:)|^/|^[A-Za-z]:[\\\\/]|^\\\\\\\\')
  union all select card_id, path, 'path_escape' from x where not regexp_matches(s.locator, '^(?i:file:)|^/|^[A-Za-z]:[\\\\/]|^\\\\\\\\') and list_contains(string_split(replace(split_part(s.locator, '#', 1), '\\', '/'), '/'), '..')
  union all select card_id, path, 'duplicate_source_id' from (select card_id, path, s.id as id, row_number() over (partition by card_id, s.id) as n from x where trim(s.id) = s.id and s.id <> '') where n > 1)
select card_id, path, code, count(*) as n from e group by all""")
def card_contract_issues(s, d):
    """Rules of the card contract that cards break, n times each."""
    return cards.card_issues(_cards(s, d))


@query(f"""with s as (select card_id, unnest(metadata.sources) as x from {CARDS}), c as (select card_id, unnest(range(0, len(metadata.sources))) as ord, unnest(metadata.sources) as x from {CARDS} where len(metadata.sources) > 0)
select card_id as key, cast(ord as int) as ord, case when ord % 3 = 1 or not exists (select 1 from s where s.card_id = c.card_id and s.x.id = c.x.id) then 'unknown_verification_source'
  when exists (select 1 from s where s.card_id = c.card_id and s.x.id = c.x.id and s.x.kind = 'formal_exam') then 'bound' else 'verification_source_kind_mismatch' end as state from c""")
def evidence_binding(s, d):
    """Each source as a case of a formal exam, every third under another id: whether its card has a source that may carry it."""
    own = _cards(s, d, "metadata").select(F.col("card_id").alias("key"), F.posexplode("metadata.sources").alias("ord", "x"))
    cases_ = own.select("key", "ord", F.when(F.col("ord") % 3 == 1, F.concat(F.lit("no-"), "x.id")).otherwise(F.col("x.id")).alias("source_id"), F.lit("formal_exam").alias("evidence_kind"))
    return cards.evidence_binding(cases_, own.select("key", F.col("x.id").alias("source_id"), F.col("x.kind").alias("kind")))


@query(f"""select distinct split_part(issue, '|', 1) as code, split_part(issue, '|', 2) as path, case when split_part(issue, '|', 1) = 'worktree_mismatch' then 'warning' else 'error' end as level from {cases.values_sql([(i,) for r in cases.RELEASE for i in (r[6] or [None])], 'issue')} where issue is not null
union all select unnest(list_filter(['forbidden_path', case when regexp_matches(archived_path, '(?i)\\.(?:doc|docx|pdf|png|jpg|zip|mp3|mp4|db)$') then 'forbidden_extension' when size_bytes > 2097152 then 'file_too_large' end], lambda v: v is not null)), archived_path, 'error'
  from (select distinct archived_path, size_bytes from {MATERIALS} where archived_path is not null and archived_path in (select archived_path from {MATERIALS} group by 1 having count(*) = 1))
union all select 'invalid_git_mode', archived_path, 'error' from {MATERIALS} where archived_path is not null group by archived_path having count(*) > 1""")
def release_issues(s, d):
    """Release audit of every archived material, known by path and size only, and of a case for each rule."""
    schema = "path string, mode string, size long, content binary, missing boolean, differs boolean"
    own = cases.rows(s, [(p, m, n, None if t is None else bytearray(t.encode()), a, b) for p, m, n, t, a, b, _ in cases.RELEASE], schema)
    known = _materials(s, d, "archived_path", "size_bytes").where("archived_path is not null")
    known = known.select(F.col("archived_path").alias("path"), F.lit("100644").alias("mode"), F.col("size_bytes").cast("long").alias("size"), F.lit(None).cast("binary").alias("content"), F.lit(False).alias("missing"), F.lit(False).alias("differs"))
    return release.release_audit(own.unionByName(known), release.Policy()).select("code", "path", "level")


@query(f"""with b as (select path, ord, block_key, row_number() over (partition by path order by ord, block_key) as r, row_number() over (partition by path order by block_key) as q from {BLOCKS} where path is not null) select path, bool_and(r = q) as same from b group by path""")
def block_order(s, d):
    """Whether each file's blocks stand in the order of their keys."""
    b = _blocks(s, d, "path", "ord").where("path is not null").withColumn("place", F.struct("ord", "block_key"))
    return setops.ordered_coverage(b, b.select("path", "block_key", F.struct(F.lit(0).alias("ord"), "block_key").alias("place")), "path", "block_key", "place")


@query("""with f as (select sha256 as digest, archived_path as path, doc_id as ord, coalesce(material_type, 'auto') as role, size_bytes as size from materials where sha256 is not null)
select digest, arg_min(path, (ord, path)) as path, count(*) as copies, coalesce(max(role) filter (role <> 'auto') <> min(role) filter (role <> 'auto'), false) as conflict from f group by digest""")
def archived_contents(s, d):
    """One row per content of the materials: its first file, how many there are, and whether they name different roles."""
    m = table(s, d, "materials").select(F.col("sha256").alias("digest"), F.col("archived_path").alias("path"), F.col("doc_id").alias("ord"), F.coalesce("material_type", F.lit("auto")).alias("role"), F.col("size_bytes").alias("size"))
    return setops.exact_roles(m)[0].select("digest", "path", "copies", "conflict")


@query(f"""with p as (select doc_id as doc, page_no as page, count(*) as n from {PAGES} where doc_id is not null group by all), c as (select doc_id as doc, cast(max(page_no) as int) - 1 as pages from {PAGES} where doc_id is not null group by 1),
 w as (select doc, unnest(range(1, pages + 1)) as page from c)
select coalesce(p.doc, w.doc) as doc, cast(coalesce(p.page, w.page) as int) as page, case when coalesce(p.page, w.page) is null then 'unnamed' when w.page is null then 'out_of_range' when p.doc is null then 'missing' when n > 1 then 'duplicate' else 'present' end as state from p full join w on p.doc = w.doc and p.page = w.page""")
def page_map(s, d):
    """The pages of each document as rendered images, against one page fewer than its last: each number once, none missing, none beyond."""
    p = _pages(s, d, "doc_id", "page_no").where("doc_id is not null")
    images = p.select(F.col("doc_id").alias("doc"), F.concat(F.lit("page-"), F.col("page_no").cast("string"), F.lit(".png")).alias("name"))
    return files.page_images(images, p.groupBy(F.col("doc_id").alias("doc")).agg((F.max("page_no") - 1).alias("pages")))


@query("""with b as (select distinct path from blocks where path is not null), n as (select path, list_last(string_split(path, '/')) as n from b)
select path, case n when '02-reading_2-1.md' then 'reading_2' when '01-reading_1-1.md' then 'reading_1' end as module, case when n in ('02-reading_2-1.md', '01-reading_1-1.md') then 'module' when n like '06-%-1.md' and n = '06-composition-1.md' then 'overview' else 'unknown_module_file' end as state from n where lower(n) like '%.md'""")
def module_files(s, d):
    """Which module each content file stands for by its name."""
    return files.content_files(table(s, d, "blocks").where("path is not null").select("path").distinct(), {"02-reading_2-1.md": "reading_2", "01-reading_1-1.md": "reading_1"}, ["06-composition-1.md"])


@query(f"""with m as (select doc_id, received_at, size_bytes % 4 as k from {MATERIALS}) select doc_id, case k when 0 then received_at when 1 then received_at - interval 8 hour when 2 then date_trunc('minute', received_at) + interval 330 minute end as reviewed_at from m""")
def zoned_times(s, d):
    """Times written with a zone in several forms, or without one, read back."""
    at = F.col("received_at").cast("timestamp_ntz")
    k = F.col("size_bytes") % 4
    written = F.when(k == 0, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(k == 1, F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+0800"))).when(k == 2, F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm"), F.lit("-05:30"))).when(k == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    m = table(s, d, "materials").groupBy("doc_id").agg(F.min("received_at").alias("received_at"), F.min("size_bytes").alias("size_bytes"))
    return m.select("doc_id", text.zoned_time(written).cast("timestamp_ntz").alias("reviewed_at"))


@query(f"""select props as value, true as safe from events union all select value, safe from {cases.values_sql(cases.JSON, 'value, safe')}""")
def log_details(s, d):
    """Whether the events' details, and a case of each kind, may stand in a log."""
    rows = table(s, d, "events").select(F.col("props").alias("value")).unionByName(cases.rows(s, [v[:1] for v in cases.JSON], "value string"))
    return rows.select("value", text.json_safe(F.col("value")).alias("safe"))


@query(f"""select path, try_cast(regexp_extract(path, '^.*?([0-9]+)[^0-9]*$', 1) as bigint) as number from (select distinct path from blocks where path is not null) union all select name, number from {cases.values_sql(cases.NAMES, 'name, number')}""")
def numbered_names(s, d):
    """The number that a file sorts by: the last run of digits of its name."""
    rows = table(s, d, "blocks").where("path is not null").select("path").distinct().unionByName(cases.rows(s, [v[:1] for v in cases.NAMES], "path string"))
    return rows.select("path", text.last_number(F.col("path")).alias("number"))
