import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.operators import audit, match, ordered, outline
from inkwell.operators import sets as setops
from inkwell.plans import pairs
from inkwell.sources import sinks
from inkwell.streaming import audit_log


def test_order_operators_equal_a_window(spark):
    random.seed(4)
    rows = [(random.choice(["hot", "hot", "a", None]), random.choice([None, *range(200)]), i, random.choice([None, None, "x", "y"]), random.randint(0, 9)) for i in range(900)]
    d = spark.createDataFrame(rows, "g string, n int, k int, v string, w int")
    w = Window.partitionBy("g").orderBy(F.col("n").asc_nulls_first(), "k")
    want = d.withColumn("c", F.coalesce(F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("none"))).withColumn("p", F.lag("w").over(w))
    got = ordered.previous(ordered.carry_forward(d, "g", ["n", "k"], F.col("v"), "c", "none"), ["g"], ["n", "k"], "w", "p")
    assert sorted(map(tuple, want.collect()), key=str) == sorted(map(tuple, got.select(*want.columns).collect()), key=str)
    numbered = ordered.numbered(d, ["g"], ["n", "k"], "w", "r", "p")
    ranked = d.withColumn("r", F.row_number().over(w)).withColumn("p", F.lag("w").over(w))
    assert sorted(map(tuple, ranked.collect()), key=str) == sorted(map(tuple, numbered.select(*ranked.columns).collect()), key=str)
    for empty in (ordered.carry_forward(d.limit(0), "g", ["n", "k"], F.col("v"), "c", "none"), ordered.numbered(d.limit(0), ["g"], ["n", "k"], "w", "r", "p")):
        assert empty.count() == 0


def test_a_hot_group_lies_in_several_ranges(spark):
    d = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"), F.col("id").alias("k"), F.lit("v").alias("v"))
    sizes = [r["count"] for r in ordered._ranges(d, ["g"], ["k"]).groupBy("_b").count().collect()]
    assert max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    last = ordered.numbered(d, ["g"], ["k"], "k", "r", "p").where("g = 'hot'").agg(F.max("r"), F.count_distinct("r")).first()
    assert tuple(last) == (13_334, 13_334)


def test_segments_and_outline(spark):
    pages = spark.createDataFrame([("p1", "一、信息类文本阅读\n1. 第一题\n续\n2．第二题"), ("p2", "前文 3. 不算\n４、全角也算"), ("p3", None), ("p4", "")], "k string, t string")
    got = [tuple(r) for r in outline.question_segments(pages, "k", "t").orderBy("k", "ord").collect()]
    assert got == [("p1", 1, 1, "1. 第一题\n续"), ("p1", 2, 2, "2．第二题"), ("p2", 1, 4, "４、全角也算")]
    assert [r[0] for r in pages.select(outline.last_section(F.col("t"))).collect()] == ["reading_1", None, None, None]
    doc = spark.createDataFrame([("d", "# A\nx\n## B\n### C\n## D\n# E")], "k string, t string")
    ends = {r.title: (r.direct_end, r.end) for r in outline.heading_outline(doc, "k", "t").collect()}
    assert ends == {"A": (3, 6), "B": (4, 5), "C": (5, 5), "D": (6, 6), "E": (7, 7)}
    hidden = spark.createDataFrame([("d", "# A\n<!-- # one\n## two\n-->\n## B\n<!-- open\n# no"), ("n", None), ("e", "")], "k string, t string")
    assert [(r.title, r.line, r.direct_end, r.end, r.parent) for r in outline.heading_outline(hidden, "k", "t").orderBy("ord").collect()] == [("A", 1, 5, 8, None), ("B", 5, 8, 8, 1)]
    cards = spark.createDataFrame([("c", "## x\n1\n## y\n2\n## x\n3"), ("e", ""), ("n", None)], "k string, t string")
    assert sorted(map(tuple, outline.section_map(cards, "k", "t").collect())) == [("c", "x", "3"), ("c", "y", "2")]


def test_sets(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "k int, c string")
    groups = {r.first_key: r.copies for r in setops.exact_groups(d, "k", F.col("c")).collect()}
    assert groups == {1: 2, 4: 1}
    assert [r.first_key for r in setops.new_content(d, d.where("k = 1"), "k", "c").collect()] == [4]
    e = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    a = spark.createDataFrame([("b",), ("c",)], "k string")
    assert sorted((r.k, r.state) for r in setops.coverage(e, a, "k").collect()) == [("a", "missing"), ("b", "duplicate"), ("c", "extra")]
    x, y = spark.createDataFrame([("a", "1"), ("b", None), ("c", "1")], "k string, h string"), spark.createDataFrame([("a", "1"), ("b", None), ("c", "2"), ("d", "1")], "k string, h string")
    assert sorted(map(tuple, setops.receipt(x, y, "k", "h").collect())) == [("a", True), ("b", True), ("c", False), ("d", False)]
    assert tuple(setops.same_rows(x, y).first()) == (1, 2)
    ledger = spark.createDataFrame([("g", 1, "x"), ("g", 2, "x"), ("g", 3, "y")], "g string, o int, c string")
    assert [r.change for r in setops.revision_ledger(ledger, ["g"], "o", "c").orderBy("o").collect()] == ["initial", "unchanged", "content_changed"]


def test_match_and_search(spark):
    q = spark.createDataFrame([("q1", "m", "t1", ["a"], "概括段落", "第3段"), ("q2", "m", None, None, None, None), ("q3", None, "t1", ["a"], "x", "y")], "question_id string, module string, question_type string, abilities array<string>, statement string, evidence string")
    c = spark.createDataFrame([("c1", ["m", "m"], ["t1"], ["a", None], "概括段落大意", "无"), ("c2", ["n"], ["t1"], ["a"], "概括段落", "第3段"), ("c3", ["m"], [], [], "别的", "第3段")], "card_id string, modules array<string>, question_types array<string>, abilities array<string>, statement string, evidence string")
    got = {(r.question_id, r.card_id): (r.dimensions, r.applicability, r.score) for r in match.match_pairs(q, c).collect()}
    assert got == {("q1", "c1"): (["question_type", "ability", "actual_task"], "applicable", 13), ("q1", "c3"): (["evidence_structure"], "applicable", 11)}
    single = match.match_pairs(q, c.withColumn("statement", F.lit(None).cast("string")).withColumn("abilities", F.lit(None).cast("array<string>"))).where("card_id = 'c1'").first()
    assert (single.dimensions, single.applicability, single.score) == (["question_type"], "not_applicable", 1) and single.reason == match.REASONS["single_label"]
    states = spark.createDataFrame([("c1", "deprecated"), ("c3", None)], "card_id string, status string")
    assert {r.question_id: (r.decision, r.card_ids) for r in match.pre_decisions(match.match_pairs(q, c), q, states, ["deprecated"]).collect()} == {"q1": ("applicable", ["c3"]), "q2": ("not_applicable", []), "q3": ("not_applicable", [])}
    cards = spark.createDataFrame([("MT-0001", "证 据", "x"), ("MT-0002", "y", "有证据"), ("MT-0003", None, None)], "card_id string, title string, body string")
    fields = {"id": F.col("card_id"), "title": F.col("title"), "body": F.col("body")}
    found = match.weighted_search(cards, fields, "证据").orderBy(F.desc("score"), "card_id").collect()
    assert [(r.card_id, r.score, r.matched) for r in found] == [("MT-0001", 80, "title"), ("MT-0002", 20, "body")]
    assert match.weighted_search(cards, fields, "").count() == 3
    assert match.weighted_search(cards, fields, "", statuses=(F.col("title"), ["y"])).count() == 1 and match.weighted_search(cards, fields, "", modules=(F.array("title"), [])).count() == 3


def test_audit(spark):
    key = "api" + "_key"
    rows = {"key": f"{key} = 'abcdef123'", "stand": f"{key} = 'changeme'", "var": key + "=${API_KEY}", "own": key + "=<YOUR_API_KEY>", "bear": "Bearer " + "x" * 20, "mail": "a@b.example", "noreply": "1+x@users.noreply.github.com", "db": "postgres" + "://u:p@h/d", "fine": "一段普通文字", "none": None}
    d = spark.createDataFrame(list(rows.items()), "k string, t string")
    got = {(r.k, r.code) for r in audit.audit_issues(d, "k", "t", terms=["普通"]).collect()}
    assert got == {("key", "secret_pattern"), ("bear", "secret_pattern"), ("mail", "identity_pattern"), ("db", "secret_pattern"), ("fine", "private_term")}
    assert audit.audit_issues(d, "k", "t", contacts=["A@b.example"]).where("k = 'mail'").count() == 0
    issues = spark.createDataFrame([("a", ""), ("a", None), (None, "x")], "path string, module string")
    assert [tuple(r) for r in audit.issue_order(issues).collect()] == [(None, "x"), ("a", None), ("a", "")]
    assert sinks.issues_as_json(issues).first().value == '{"module":"x","path":null}'


def test_salted_pairs(spark):
    rows = [("g", f"k{i}", str(i % 2)) for i in range(60)] + [("h", "a", "1"), (None, "b", "1"), ("h", None, "1"), ("g", "k1", "1")]
    d = spark.createDataFrame(rows, "g string, k string, v string")
    all_pairs = pairs.salted_self_pairs(d, ["g"], "k", block=7)
    assert all_pairs.count() == all_pairs.distinct().count() == 60 * 59 // 2
    assert pairs.salted_self_pairs(d, ["g"], "k", differ="v", block=7).count() == 30 * 30
    members = spark.createDataFrame([(1, f"x{i}") for i in range(30)] + [(2, f"y{i}") for i in range(20)], "class long, key string")
    ab = spark.createDataFrame([(1, 2)], "a long, b long")
    got = pairs.expand_class_pairs(ab, members, block=8)
    assert got.count() == got.distinct().count() == 600 and got.where("left >= right").count() == 0


def test_stream_counts_each_file_once(spark, tmp_path):
    events = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "t string, u int")
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    for _ in range(3):
        audit_log.append_events(events, log)
        got = {r.t: r.n for r in audit_log.counts_from_stream(spark, log, events.schema, ["t"], state, "json").collect()}
    assert got == {"a": 6, "b": 3}
    last = audit_log.latest_per_key(events, ["t"], ["u"], ["u"])
    assert sorted(map(tuple, last.collect())) == [("a", 2), ("b", 1)]


def test_archive(spark, tmp_path):
    d = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", b"2")], "path string, content binary")
    assert sinks.archive_new(d, str(tmp_path / "x")).count() == 2
    assert sinks.archive_new(d.unionByName(spark.createDataFrame([("d", b"3")], d.schema)), str(tmp_path / "x")).count() == 3
    assert sinks.manifest(d).count() == 3


def test_cut_and_clear(spark, tmp_path):
    from inkwell.plans import cut as c

    d = c.cut(spark.range(5))
    assert d.count() == 5 and "Range" not in d._jdf.queryExecution().toString()
    other = c.shared_dir(spark).removeprefix("file://") + "/inkwell-other-application/t"
    import os

    os.makedirs(other)
    c.clear(spark)
    assert os.path.exists(other)
    assert c.cut(spark.range(0)).count() == 0


def test_roles_order_and_issues(spark):
    f = spark.createDataFrame([(1, "a", "x", "auto", 3), (2, "b", "x", "exam", 3), (3, "c", "x", "answer", 3), (4, "d", "y", "exam", 1), (5, "e", None, "exam", 1)], "ord int, path string, digest string, role string, size long")
    kept, later = setops.exact_roles(f)
    assert sorted(map(tuple, kept.collect())) == [("x", "a", "auto", 3, 3, True), ("y", "d", "exam", 1, 1, False)]
    assert sorted(map(tuple, later.collect())) == [("x", "b", "a"), ("x", "c", "a")]
    e = spark.createDataFrame([("g", 1, "p"), ("g", 2, "q"), ("h", 1, "p"), ("i", 1, None)], "g string, n int, k string")
    a = spark.createDataFrame([("g", 1, "p"), ("g", 2, "q"), ("h", 1, "p"), ("h", 2, "p"), ("i", 5, None), ("j", 1, "x")], "g string, n int, k string")
    assert {r.g: r.same for r in setops.ordered_coverage(e, a, "g", "k", "n").collect()} == {"g": True, "h": False, "i": True, "j": False}
    issues = spark.createDataFrame([("error", "c1", "a", 2, "m"), ("warning", "c2", "a", 1, "n")], "level string, code string, path string, line int, message string")
    assert [r.line for r in sinks.issues_as_text(issues).orderBy("n").collect()] == ["WARNING [c2] a:1 n", "ERROR [c1] a:2 m", "1 errors, 1 warnings"]


def test_release_inventory(spark):
    from inkwell.operators import release

    listed = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "path string")
    staged = spark.createDataFrame([("a", "100644", "1", 0), ("b", "100644", "1", 1), ("b", "100644", "2", 2), ("d", "100644", "1", 0)], "path string, mode string, oid string, stage int")
    assert {r.path: r.conflict for r in release.inventory_entries(listed, staged).collect()} == {"a": False, "b": True, "c": True, "d": True}
    base = release.Policy()
    assert release.Policy(max_bytes=5, directories=["docs"]).is_narrower(base) and not release.Policy(directories=["x"]).is_narrower(base) and not release.Policy(forbidden_extensions=[]).is_narrower(base)
    u = lambda *v: spark.createDataFrame([(x,) for x in v], "url string")
    assert [r.url for r in release.unsafe_remotes(u("https://h/a", None), u("https://h/a", "/x"), ["https://h/a"]).collect()] == ["/x"]
    t = spark.createDataFrame([("Host-0001.lan spricht",), ("von user1@x.example",), ("user1@users.noreply.github.com",), ("host",)], "t string")
    assert [r[0] for r in t.select(audit.has_identity(F.col("t"), ["host-0001", "host"], ["user1"])).collect()] == [True, True, False, False]


def test_cards(spark):
    from inkwell.operators import cards

    kind = "card_id string, path string, metadata struct<schema_version:int,title:string,card_type:string,status:string,risk_level:string,modules:array<string>,question_types:array<string>,abilities:array<string>,sources:array<struct<id:string,kind:string,name:string,locator:string>>>, body string"
    body = "\n".join(f"## {t}\n文" for t in cards.REQUIRED_SECTIONS)
    src = ("s1", "formal_exam", "n", "exams/a.md")
    good = ("MT-0001", "p1", (1, "t", "method", "verified", "high", ["poetry"], ["q"], ["a"], [src]), body)
    rows = [good, ("MT-1", "p2", (2, " ", "method", "odd", "mid", ["x"], [""], [], [src, src, (" s2 ", "what", "", "/" + "etc/x"), (None, "formal_exam", "n", "a/../b")]), body.replace("## 反例与冲突\n文", "## 反例与冲突\n")), ("X", "p3", None, None), ("MT-0001", "p4", good[2], body)]
    d = spark.createDataFrame(rows, kind)
    got = {}
    for r in cards.card_issues(d).collect():
        got.setdefault(r.path, {})[r.code] = r.n
    assert "p1" not in got and got["p3"]["missing_metadata"] == 9 and got["p3"]["missing_section"] == 5
    assert got["p2"] == {"unsupported_schema_version": 1, "invalid_title": 1, "invalid_id": 1, "invalid_status": 1, "invalid_risk_level": 1, "invalid_module": 1, "invalid_question_types": 1, "invalid_abilities": 1, "missing_section": 1, "duplicate_source_id": 1, "noncanonical_source_id": 1, "invalid_source_id": 1, "invalid_source": 3, "absolute_path": 1, "path_escape": 1}
    assert sorted(r.path for r in cards.duplicate_cards(d).collect()) == ["p1", "p4"]
    index, none = d.where("path = 'p1'").select("card_id", "path"), spark.createDataFrame([], "path string")
    one = d.where("path = 'p1'")
    assert [r.code for r in cards.library_issues(one, none, index, index.limit(0)).collect()] == ["index_out_of_sync"] and cards.library_issues(one, none, index, index).count() == 0
    assert cards.card_issues(d.limit(0)).count() == 0
