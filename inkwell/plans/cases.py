"""Literal rows that stand beside a table's own, so that each branch of a rule occurs in its query.

The same list gives Spark rows and the SQL beside them. Secrets and paths are put together at run
time: no text here has the form of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, (bool, int, float)):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "'" + v.replace("'", "''") + "'"


def values_sql(values: list[tuple], columns: str) -> str:
    """A FROM item with these rows."""
    return f"(select * from (values {', '.join('(' + ', '.join(map(literal, v)) + ')' for v in values)}) v({columns}))"


def path(*parts: str) -> str:
    return "/" + "/".join(parts)


_KEY, _TOKEN, _AT = "api" + "_key", "to" + "ken", "@"

#: (text, codes it breaks): secrets, addresses and host paths, and what only looks like them.
AUDIT = [
    (f"{_KEY} = 'abcdef123'", ["secret_pattern"]), (f"{_KEY} = 'ab cdefgh'", ["secret_pattern"]), (f'password: "ab"', []), (f"{_KEY} = 'changeme'", []), (f"{_KEY}=${{API_KEY}}", []), (f"{_KEY}=<YOUR_API_KEY>", []),
    (f"{_KEY} = 'prod-test-{'a' * 24}'", ["secret_pattern"]), (f"{_KEY} = 'example-{_TOKEN} {'d' * 24}'", ["secret_pattern"]), (f"{_KEY} = 'example-{_TOKEN}'", []),
    (f"{_TOKEN} = '{'a' * 28}'", ["secret_pattern"]), (f"{_TOKEN} = {'a' * 28}", []), ("Bear" + "er " + "b" * 28, ["secret_pattern"]), ("gh" + "p_" + "b" * 36, ["secret_pattern"]), ("gl" + "pat-" + "c" * 24, ["secret_pattern"]),
    ("github" + "_pat_" + "a" * 30, ["secret_pattern"]), ("-----BEGIN RSA PRIVATE " + "KEY-----", ["secret_pattern"]), ("AK" + "IA" + "A" * 16, ["secret_pattern"]),
    (f"Person.Name{_AT}Company.Example", ["identity_pattern"]), (f"1+x{_AT}users.noreply.github.com", []), (f"1+x{_AT}users.noreply.other.example", ["identity_pattern"]), (f"git{_AT}github.com:a/b.git", []), (f"ssh://git{_AT}github.com/a/b", []),
    (f"git{_AT}github.com", ["identity_pattern"]), (f"project-contact{_AT}example.org", []), (f"other-contact{_AT}example.org", ["identity_pattern"]), ("eine GRANDMOTHER spricht", ["private_term"]),
    ("source=" + path("mnt", "share", "exam.md"), ["absolute_path"]), ("source=" + path("custom-root"), ["absolute_path"]), ("a " + path("custom-root") + " b", []), ("source=" + "file:" + path("srv", "x.pdf"), ["absolute_path"]),
    ("source=" + "/" * 2 + "server/share/exam.pdf", ["absolute_path"]), ("C" + ":\\Users\\a", ["absolute_path"]), ("\\" * 2 + "host\\share\\x", ["absolute_path"]), ("[guide](/docs/guide.md)", []), ("[logo](/assets/logo.svg)", []),
    ("按 A/B/C 处理，普通中文/并列/表达。", []), ("[x](/examples/public/README.md)", []), ("[x]" + "(" + path("examples", "borrowed", "exam.md") + ")", ["absolute_path"]), ("[x](" + path("docs", "..", "m", "private.md") + ")", ["absolute_path"]),
    ("[x](" + path("src", "%25" + "2e%25" + "2e", "Users", "p.md") + ")", ["absolute_path"]), ("[x](/docs/%E4%B8%AD%E6%96%87.md)", []), ("[x](" + path("src", "%GG", "p.md") + ")", ["absolute_path"]), ("command >" + path("Users", "a", "p.txt"), ["absolute_path"]),
    ("[x](</src/module/cli.py>)", []), ("[x](<" + path("src", "space here", "f.py") + ">)", ["absolute_path"]), ("[x](%2F" + "Users%2Fperson%2Fp.md)", ["absolute_path"]), ("[x](guides/%E4%B8%AD%E6%96%87.md)", []), ("<root>/a/b", []), ("#!/usr/bin/env", []), ("", []),
]

#: Percent-decoding to a fixed point: text, what comes out.
DECODED = [("a%20b", "a b"), ("a+b", "a+b"), ("%2525", None), ("%2541", "A"), ("%zz", None), ("%ff", None), ("%00", None), ("plain", "plain"), ("%25" * 1 + "25" * 6 + "41", None), ("%E4%B8%AD", "中")]

#: Pages of two documents: key, document, page, text.
PAGES = [
    ("case-1", "case-a", 1, "一、信息类文本阅读\n1. 第一题\n2. 第二题"), ("case-2", "case-a", 2, "语言文字运用\n4. 第四题\n古代诗歌阅读"), ("case-3", "case-a", 3, None), ("case-4", "case-a", 4, "５、全角\n三、写作\n  6．末题\n续行"),
    ("case-5", "case-b", 1, "3.14 也算题号\n文言文阅读与诗歌\n小说阅读\n4、末题"), ("case-6", "case-b", 2, "阅读 I 甲\n1234. 不是题号\n12. 诗歌在先"),
]

#: Markdown texts with comments of every kind: key, text.
MARKDOWN = [
    ("case-1", "# A\nx\n<!-- # hidden -->\n## B\n### C\n## D\n# E"), ("case-2", "# A\n<!-- # one\n## two\n-->\n## B\n# <!-- x --> C"), ("case-3", "## A\n<!-- never closed\n# B\n## C"), ("case-4", "#no\n####### seven\n#\tTab\n```\n# in code\n```"),
    ("case-5", ""), ("case-6", "#  \n# x  "),
]

#: Lines with and without a placeholder: key, text, placeholder (null: none).
PLACEHOLDER = [("case-01", "> TODO", "todo"), ("case-02", "1. 待补充", "待补充"), ("case-03", "- [ ] TBD", "tbd"), ("case-04", "> - [x] 同上", "同上"), ("case-05", "**TODO**。", "todo"), ("case-06", "请写 TODO 清单", None), ("case-07", "## `略`", "略"), ("case-08", "`**TBD**`；", None), ("case-09", "<!-- \nTODO\n-->", "todo"), ("case-10", "TODO 清单", None)]
#: Texts with template variables: key, text, variables.
VARIABLES = [("case-01", "${a} x ${a}", ["${a}", "${a}"]), ("case-02", "<!-- ${b c} -->", ["${b c}"]), ("case-03", "${} ${\n} $x", [])]
#: Markdown texts and the number of their characters that carry content.
SUBSTANTIVE = [("case-1", "# 标题\n- 正文**三字**\n<!-- 注\n释 -->\n${x}", 4), ("case-2", "| a | b |", 4), ("case-3", "1) 甲<!-- 开", 1), ("case-4", None, 0), ("case-5", "　甲 ", 1)]
#: Identifiers and their normal form.
IDENTIFIERS = [(" a1 ", "a1"), ("a​b", None), ("  ", None), ("　题　", "题"), ("a\tb", None), ("Ab", "Ab")]
#: Paths, their mode, whether portable.
FILES = [
    ("docs/a.md", True), ("docs/‮txt.md", False), ("docs/é.md", False), ("docs/ leading.md", False), ("docs/.hidden.md", False), (".github/x.yml", True), ("docs/COM¹.md", False), ("con.txt", False), ("a/../b", False), ("/a", False), ("a//b", False), ("C:x", False), ("a\\b", False), ("docs/Case.md", True), ("docs/case.md", True), ("a?b", False), ("", False),
]


def _fence(s: str) -> str:
    return "```json\n" + s + "\n```\n"


_INVENTORY = '{"schema_version": 1, "questions": [%s]}'
_ALLOCATION = '{"schema_version": 1, "question_id": "2", "total": %s, "mode": "additive", "components": [%s], "cap": {"points": 5, "rule": "r"}, "substitution_groups": [%s]}'
_PART = '{"id": "%s", "label": "x", "points": %s}'
_BANDS = '{"schema_version": 1, "question_id": "5", "total": 60, "mode": "holistic", "components": [], "cap": {"points": 60, "rule": "r"}, "substitution_groups": [], "holistic_rule": "h", "bands": [%s]}'
_BAND = '{"min": %s, "max": %s, "rule": "r"}'
_SCORED = "## 题目清单\n" + _fence(_INVENTORY % '{"id": "2", "kind": "other", "score": 5}') + "## 【官方分值构成】：2\n"
_HOLISTIC = "## 题目清单\n" + _fence(_INVENTORY % '{"id": "5", "kind": "composition", "score": 60}') + "## 【建议分值构成】：5\n"
_CHOICE = "## 题目清单\n" + _fence(_INVENTORY % '{"id": "1", "kind": "choice", "options": ["A", "B"]}, {"id": "3", "kind": "choice", "options": ["A"]}')
_SUBJECT = "## 题目清单\n" + _fence(_INVENTORY % '{"id": "4", "kind": "subjective"}, {"id": "6", "kind": "subjective"}')
#: Markdown of question collections and what is wrong with them: key, text, issues (code|id|detail).
COLLECTIONS = [
    ("case-01", "# 无清单", ["missing_question_inventory||"]),
    ("case-02", "## 题目清单\n" + _fence(_INVENTORY % "") + _fence(_INVENTORY % ""), ["invalid_question_inventory||"]),
    ("case-03", "## 题目清单：甲\n" + _fence(_INVENTORY % '{"id": " 7 ", "kind": "other"}, {"id": "7", "kind": "other"}, {"id": "8", "kind": "choice"}, {"id": "9", "kind": "essay"}, {"id": "10", "kind": "other", "score": 0}, {"id": "11", "kind": "choice", "options": ["A", "A"]}, {"id": "12", "kind": "other", "options": ["A"]}'), [f"invalid_question_inventory||{k}" for k in range(1, 7)]),
    ("case-04", _CHOICE + "## 选择题：1\n### A项\n- 原文依据：甲\n- **设误类型**：乙\n### b 项：二\n- 原文依据：甲\n<!-- - 设误类型：隐 -->\n## 选择题：9\n", ["missing_option_evidence|1|B:设误类型", "missing_option_evidence|3|", "unexpected_question_block|9|"]),
    ("case-05", _CHOICE + "## 选择题：1\n## **选择题: 3**\n#### A项\n原文依据：甲\n", ["missing_option_evidence|1|A:原文依据、设误类型", "missing_option_evidence|1|B:原文依据、设误类型", "missing_option_evidence|3|A:原文依据、设误类型"]),
    ("case-06", _SUBJECT + "## 主观题：4\n审题：有\n### 下级\n作答：在下级\n## 主观题：0\n", ["missing_subjective_step|4|作答", "missing_subjective_chain|6|", "unexpected_question_block|0|"]),
    ("case-07", _SCORED + _fence(_ALLOCATION % (5, ", ".join([_PART % ("a", 3), _PART % ("b", 2)]), "")), []),
    ("case-08", _SCORED + _fence(_ALLOCATION % (5, ", ".join([_PART % ("a", 2), _PART % ("b", 2)]), "")), ["score_total_mismatch|2|"]),
    ("case-09", _SCORED + _fence(_ALLOCATION % (5, ", ".join([_PART % ("a", 3), _PART % ("b", 2), _PART % ("c", 2)]), '{"component_ids": ["b", "c"], "rule": "z"}')), []),
    ("case-10", _SCORED + _fence(_ALLOCATION % (5, ", ".join([_PART % ("a", 3), _PART % ("b", 2), _PART % ("c", 2)]), "")), ["score_total_mismatch|2|"]),
    ("case-11", _SCORED + _fence(_ALLOCATION % (5, ", ".join([_PART % ("a", 3), _PART % ("b", 2)]), '{"component_ids": ["b"], "rule": "z"}')), ["invalid_substitution_group|2|"]),
    ("case-12", _SCORED + _fence(_ALLOCATION % (6, _PART % ("a", 5), "")), ["score_total_mismatch|2|"]),
    ("case-13", _SCORED + "无\n## 【官方分值构成】：2\n" + "## 【官方分值构成】：7\n", ["duplicate_score_allocation|2|", "unexpected_score_allocation|7|"]),
    ("case-14", _SCORED + "没有围栏", ["invalid_score_allocation|2|"]),
    ("case-15", _HOLISTIC + _fence(_BANDS % ", ".join([_BAND % (0, 19), _BAND % (20, 39), _BAND % (40, 60)])), []),
    ("case-16", _HOLISTIC + _fence(_BANDS % ", ".join([_BAND % (0, 19), _BAND % (21, 60)])), ["invalid_holistic_allocation|5|"]),
    ("case-17", _HOLISTIC + _fence(_BANDS % ", ".join([_BAND % (0, 19), _BAND % (20, 59)])), ["score_total_mismatch|5|"]),
    ("case-18", "## 题目清单\n" + _fence(_INVENTORY % '{"id": "5", "kind": "composition", "score": 60}'), ["missing_score_allocation|5|"]),
]
FIELDS = {"原文依据": ["原文依据", "依据"], "设误类型": ["设误类型"]}
STEPS = {"审题": ["审题"], "作答": ["作答", "答案"]}

#: Files of an inventory: path, mode, size, text (null: not read), missing, differs, and their issues (code|shown path).
RELEASE = [
    ("docs/ok.md", "100644", 9, "一般文字", False, False, []), ("docs/warn.md", "100755", 9, "x", False, True, ["worktree_mismatch|docs/warn.md"]), ("materials/x.md", "100644", 9, "x", False, False, ["forbidden_path|materials/x.md"]),
    ("docs/link.md", "120000", 9, "", False, False, ["tracked_symlink|docs/link.md"]), ("src/module", "160000", 9, None, False, False, ["tracked_submodule|src/module"]), ("docs/odd.md", "100600", 9, "x", False, False, ["invalid_git_mode|docs/odd.md"]),
    ("docs/a.PDF", "100644", 99999999, None, False, False, ["forbidden_extension|docs/a.PDF"]), ("docs/big.md", "100644", 2097153, None, False, False, ["file_too_large|docs/big.md"]), ("docs/edge.md", "100644", 2097152, "x", False, False, []),
    ("docs/gone.md", "100644", 0, None, True, False, ["missing_tracked_file|docs/gone.md"]), ("docs/zero.md", "100644", 9, "a\0b", False, False, ["binary_file|docs/zero.md"]), ("docs/lfs.md", "100644", 9, "version https://git-lfs.github.com/spec/v1\noid x", False, False, ["lfs_pointer|docs/lfs.md"]),
    ("docs/mail.md", "100644", 9, f"Person{_AT}Company.Example", False, False, ["identity_pattern|docs/mail.md"]), ("private/k.md", "100644", 9, f"{_KEY} = 'abcdef123'", False, False, ["forbidden_path|private/k.md", "secret_pattern|private/k.md"]),
    (f"docs/Person{_AT}Company.Example.md", "100644", 9, "x", False, False, []), ("docs/Fold.md", "100644", 9, "x", False, False, []), ("docs/fold.md", "100644", 9, "x", False, False, ["invalid_path|<unsafe-path>"]),
    ("docs/.hid.md", "100644", 9, f"Person{_AT}Company.Example", False, True, ["invalid_path|<unsafe-path>"]), ("materials/gh" + "p_" + "b" * 36, "100644", 9, "x", False, False, ["forbidden_path|<redacted-path>"]), ("README.de.md", "100644", 9, "x", False, False, []), ("notes.md", "100644", 9, "x", False, False, ["forbidden_path|notes.md"]),
    ("examples/public/a.md", "100644", 9, "x", False, False, []), ("examples/other/a.md", "100644", 9, "x", False, False, ["forbidden_path|examples/other/a.md"]), ("docs/twice.md", "100644", 9, "x", False, False, ["invalid_git_mode|docs/twice.md"]), ("docs/twice.md", "100644", 9, "x", False, False, []),
]
#: JSON texts and whether they may stand in a log.
JSON = [('{"a": 1}', True), ('{"a": NaN}', False), ("{", False), ('{"a": "' + path("Users", "x") + '"}', False), ('{"' + path("tmp", "x") + '": 1}', False), ('{"a": ["b/c", "C' + ":" + '\\\\\\\\x"]}', False), ('{"a": "甲/乙"}', True), ("[]", True), (None, None)]
#: Names and the number they sort by.
NAMES = [("page-2.png", 2), ("page-10.png", 10), ("scan3-01.png", 1), ("cover.png", None), ("9" * 30, None)]
