import pytest
from pyspark.sql import functions as F

from inkwell.functions import hostpath, markdown, text, udfs
from inkwell.plans import cases
from inkwell.sources import files


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value,want", [("第2段 AB", {"第", "2", "段", "ab"}), ("证据链条", {"证据链条"}), ("", set()), (None, set()), ("a　b c", {"abc"})])
def test_tokens(spark, value, want):
    got = set(one(spark, value, text.tokens))
    assert {w for w in want if len(w) > 1 or w.isdigit()} <= got


def test_tokens_cross_word_limits(spark):
    assert "ab12" in one(spark, "a b 1 2", text.tokens)
    assert one(spark, "证据", text.tokens) == ["证据"]


@pytest.mark.parametrize("value,want", [("> TODO", "todo"), ("1. 待补充", "待补充"), ("- [ ] TBD", "tbd"), ("> - [x] 同上", "同上"), ("**TODO**。", "todo"), ("请写 TODO 清单", "请写 todo 清单")])
def test_placeholder_line(spark, value, want):
    assert one(spark, value, text.placeholder_line) == want


@pytest.mark.parametrize("value,want", [("# 标题\n- 正文**三字**\n<!-- 注 -->\n${x}", 4), (None, 0), ("", 0), ("| a | b |", 2 + 2)])
def test_substantive(spark, value, want):
    assert one(spark, value, text.substantive) == want


@pytest.mark.parametrize("value,absolute,escapes", [("exams/a.md", False, False), ("/" + "etc/x", True, False), ("C" + ":\\x", True, False), ("a/../b", False, True), ("a#../b", False, False), ("fi" + "le:/x", True, False)])
def test_locators(spark, value, absolute, escapes):
    assert one(spark, value, text.is_absolute_locator) is absolute
    assert one(spark, value, text.escapes_root) is escapes


@pytest.mark.parametrize("value,want", [("a.PDF", ".pdf"), ("x/y.tar.gz", ".gz"), ("x/.hidden", ""), ("noext", ""), (None, None)])
def test_suffix(spark, value, want):
    assert one(spark, value, text.suffix) == want


@pytest.mark.parametrize("value,want", [(" a1 ", "a1"), ("a​b", None), ("  ", None), (None, None), ("　题　", "题")])
def test_identifier(spark, value, want):
    assert one(spark, value, text.normal_identifier) == want


def test_percent_decoding(spark):
    d = spark.createDataFrame([*cases.DECODED, (None, None)], "v string, w string")
    assert [r.v for r in d.select("v", "w", hostpath.percent_decoded(F.col("v")).alias("g")).collect() if r.w != r.g] == []


def p(*parts):
    return "/" + "/".join(parts)


PATHS = [
    *[("source=" + v, True) for v in (p("mnt", "s", "e.md"), p("srv", "a", "c.toml"), p("workspace", "x", "n.md"), p("data", "e.pdf"), p("custom-root"), "file:" + p("srv", "d"), "/" * 2 + "server/share/e.pdf")],
    ("C" + ":\\Users", True), ("\\" * 2 + "host\\share\\x", True), ("See https://example.com/docs/guide and http://example.org/a/b.", False), ("See https://example.com/C:/guide and https://example.org/a/b.", False), ("按 A/B/C 处理，普通中文/并列/表达。", False), ("and/or", False), ("<root>/a/b", False), ("#!/usr/bin/env", False), ("", False),
    *[(f"[x]({v})", False) for v in ("/docs/guide.md", "/assets/logo.svg", "/examples/public/R.md", "/src/k/cli.py", "/docs/%E4%B8%AD%E6%96%87.md", "guides/%E4%B8%AD%E6%96%87.md", "</src/k/cli.py>", "<guides/%E4%B8%AD.md>", '</src/k/cli.py> "源码"', "../guide.md")],
    *[(f"[x]({v})", True) for v in (p("etc", "passwd"), p("docs", "..", "m", "p.md"), p("examples", "borrowed", "e.md"), p("Users", "a", "p.md"), p("src") + "\\o.py", '</src/k/cli.py> "' + p("Users", "a") + '"')],
    *[("[x](" + p("src", e, "Users", "a", "p.md") + ")", True) for e in ("%252e%252e", "%25252E%25252E", "%2E%2e", "%2525252e%2525252e")],
    *[("[x](" + p("src", e, "p.md") + ")", True) for e in ("%", "%2", "%GG", "%25252525252e", "%2500", "file%253A%252F%252FUsers", "%255CUsers", "%252F%252Fserver")],
    *[("[x](" + p("src", "m.py") + e + ")", True) for e in ("?cache=%252FUsers%252Fp", "?cache=%252Fcustom-root%252Fp.md", "#target=file%253A%252F%252FUsers", "?target=C%253A%252Fprivate")],
    *[("[x](" + f.format(e) + ")", True) for f in ("{}", "<{}>") for e in ("%2FUsers%2Fp%2Fq.md", p("%55sers", "a"), p("%2e%2e", "Users"), "%252FUsers%252Fp", "%25252525252FUsers%252Fp.md", "C%3A%2FUsers", "%2F%2Fserver%2Fshare%2Fp", "file%3A%2F%2F%2FUsers")],
    *[("[x](<" + e + ">)", True) for e in (p("src", "space here", "f.py"), p("src", "nested") + "<extra>", p("src", "esc") + "\\n.py")],
    *[("command " + r + p("Users", "a", "p.txt"), True) for r in (">", "2>", "< ")], ("> 普通文字", False), ("> " + p("Users", "a", "p"), True),
]


def test_host_paths(spark):
    d = spark.createDataFrame([*PATHS, (None, None)], "t string, w boolean")
    assert [(r.t, r.w) for r in d.select("t", "w", hostpath.names_host_path(F.col("t")).alias("g")).collect() if r.w != r.g] == []


def test_unicode_functions_keep_nulls(spark):
    d = spark.createDataFrame([("Straße", ), (None, )], "v string")
    assert [r[0] for r in d.select(udfs.casefold("v")).collect()] == ["strasse", None]
    assert [r[0] for r in d.select(udfs.slug("v")).collect()] == ["Straße", None]
    assert one(spark, "é", udfs.nfc) == "é"
    assert one(spark, "a1b22", udfs.matches_of(r"(\d+)"))[1].start == 3


def test_markdown_blocks():
    got = list(markdown.blocks("# 一\n段落\n接着\n\n- a\n  - b\n1. c\n\n| x | y |\n|---|---|\n| 1 |\n"))
    assert [(b[0], b[1]) for b in got] == [("heading", 1), ("paragraph", 0), ("list", 0), ("list", 0), ("table", 0)]
    assert got[1][2] == "段落 接着" and got[2][3][1]["level"] == 1 and got[4][4] == [["x", "y"], ["1", ""]]
    mixed = list(markdown.blocks("- a | b\n|---|---|\n- c | d\nx\n---|---\n---|---\nz|w\nplain | pipe\nnext\n#no\n"))
    assert [b[0] for b in mixed] == ["table", "paragraph", "table", "paragraph"] and mixed[0][4] == [["- a", "b"], ["- c", "d"]] and mixed[3][2] == "next #no"
    assert [markdown.table_cells(c) for c in ("a|b", "|a||b|", r"a \| b", r"| a \|", "|", "a\\")] == [["a", "b"], ["a", "", "b"], ["a | b"], ["a |"], [""], ["a\\"]]
    assert list(markdown.blocks("")) == [] and markdown.table_cells(r"| a \| b | c |") == ["a | b", "c"]


def test_card_and_documents(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>甲</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "in/b.txt").write_bytes("﻿乙".encode())
    (tmp_path / "in/c.docx").write_bytes(b"broken")
    (tmp_path / "in/d.pdf").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.page_no, r.text, r.error) for r in files.read_documents(spark, str(tmp_path / "in")).collect()}
    assert got["a.docx"] == (1, "甲\n1\t2", None) and got["b.txt"][1] == "乙" and got["c.docx"][2] == "BadZipFile" and got["d.pdf"][1] is None
    two = files.read_documents(spark, str(tmp_path / "in"), lambda b: ["p", "q"]).where("path like '%pdf'").collect()
    assert sorted(r.page_no for r in two) == [1, 2]
    (tmp_path / "cards/m").mkdir(parents=True)
    (tmp_path / "cards/m/1.md").write_text('+++\nid = "MT-0001"\nmodules = ["a"]\n+++\n## x\ny\n')
    (tmp_path / "cards/m/2.md").write_text("no")
    cards = {r.error: r for r in files.read_cards(spark, str(tmp_path / "cards"), "id string, modules array<string>").collect()}
    assert cards[None].metadata.id == "MT-0001" and cards[None].body == "## x\ny" and "no front matter" in cards


def test_markdown_comments_and_nulls(spark):
    d = spark.createDataFrame([("a", "x <!-- \n# no\n--> y\n<!-- open\n# no"), ("b", None), ("c", "")], "k string, t string")
    assert [(r.k, r.kind, r.text) for r in markdown.markdown_blocks(d, "k", "t").collect()] == [("a", "paragraph", "x  y")]


def test_field_values_and_json(spark):
    body = "- **依据**： 甲\n依据:\n* 依据 ：乙 \n不依据：丙"
    assert one(spark, body, lambda c: text.field_values(c, ["依据"])) == ["甲", "* 依据 ：乙 "]  # white space after the colon may hold a line feed
    assert one(spark, "```json\n{\"a\": 1}\n```", text.fenced_json) == '{"a": 1}' and one(spark, "```json\n{}\n```\n```json {} ```", text.fenced_json) is None and one(spark, None, text.fenced_json) is None
    assert one(spark, "１٢3", text.digits) == "123" and one(spark, "**【甲】**", text.heading_name) == "甲"


def test_sources(spark, tmp_path):
    counts = spark.createDataFrame([("d", 3), ("e", 0), (None, 1)], "doc string, pages int")
    images = spark.createDataFrame([("d", "page-1.png"), ("d", "page-1.jpg"), ("d", "page-9.png"), ("d", "cover.png"), ("d", "page-3")], "doc string, name string")
    got = sorted(((r.doc, r.page, r.state) for r in files.page_images(images, counts).where("doc is not null").collect()), key=str)
    assert got == [("d", 1, "duplicate"), ("d", 2, "missing"), ("d", 3, "present"), ("d", 9, "out_of_range"), ("d", None, "unnamed")]
    f = spark.createDataFrame([("a", 3, b"abc"), ("b", 9, b"x" * 9)], "path string, length long, content binary")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "path string")
    assert sorted((r.path, r.state, r.content) for r in files.bounded(f, wanted, 5).collect()) == [("a", "read", b"abc"), ("b", "too_large", None), ("c", "missing", None)]
    assert [r.path for r in files.null_split(spark.createDataFrame([("a\0b\0",)], "v string"), "v").collect()] == ["a", "b"]
    (tmp_path / "a.json").write_text('{"schema_version": 1, "x": "y"}')
    assert files.read_versioned(spark, str(tmp_path / "a.json"), "x string").first().x == "y"
    (tmp_path / "b.json").write_text('{"schema_version": 2}')
    with pytest.raises(Exception, match="schema_version"):
        files.read_versioned(spark, str(tmp_path / "b.json"), "x string").collect()
