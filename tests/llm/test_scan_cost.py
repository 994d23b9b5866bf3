import random

import numpy as np

from inkwell.llm import scan
from inkwell.llm.arrays import code_points, strings


class Bad(dict):
    def keys(self):
        raise AssertionError("all known words are walked for one record")

    __iter__ = items = values = keys


def test_a_record_costs_its_own_words_alone():
    words = scan.Words(np.zeros(scan.BUCKETS, np.int32))
    words.bad = Bad({"tlie": "the"})
    assert words.wrong({"tlie", "potter"}) == {"tlie": "the"} and words.good == {"potter"}
    assert words.wrong({"b0at"}) == {"b0at": "boat"} and len(words.bad) == 2


def plain_flow(text):
    text = scan.re.sub(r"(?<=[㐀-鿿,。、;:])\n(?=[㐀-鿿])", "", text)
    for read, sign in scan._PRIVATE.items():
        text = text.replace(read, chr(sign))
    return text


def test_whole_batches_equal_text_by_text():
    random.seed(4)
    pool = "".join(scan.SPLIT.values()) * 2 + "\n" * 25 + ",。、;:，中文𠀀-㐀鿿abc019é×ȀɏɐÀ "
    texts = ["".join(random.choices(pool, k=random.randint(0, 40))) for _ in range(5000)] + ["", "\n", "木木木木木", "日月月月", "木\n木", ""]
    cps, starts = scan._padded(*code_points(texts))
    flow, begin = scan._flow(cps, starts)
    assert strings(flow, np.r_[begin, len(flow)]) == [f"\n\n{plain_flow(t)}\n\n" for t in texts]
    assert strings(cps, np.r_[starts, len(cps)]) == [f"\n\n{t}\n\n" for t in texts]  # left as they were
    own = [[] for _ in texts]
    for w, i in zip(*(lambda w, at: (w, np.searchsorted(starts, at, "right") - 1))(*scan._latin_words(cps))):
        own[i] += [] if w.isdigit() else [w]
    assert own == [scan.LATIN_WORD.findall(t) for t in texts]


def test_edges_of_pages_and_questions():
    text = "一行字一\n \n二行字二\n三行字三\n四行字四\n五行字五\n\n"
    assert [s for s, _ in scan.edge_lines(text, 1, False)] == ["一行字一", "二行字二", "四行字四", "五行字五"]
    assert [s for s, _ in scan.edge_lines(text, 1, True)] == ["一行字一", "二行字二", "三行字三", "四行字四", "五行字五"]
    assert scan.edge_lines("甲乙丙\n\n\n\n\n", 1, False) == [("甲乙丙", False)] and scan.edge_lines("\n\n", 1, False) == []
    assert scan.edge_lines("甲乙丙 7\n正文到此为止。\n- 7 -", 7, False) == [("甲乙丙", False), ("", True)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_forms_of_titles_equal_brute_force(spark):
    random.seed(6)
    titles = [("d", "林丽读本第六辑"), ("d", "讲评与练习"), ("d", "讲评与练"), ("e", "林丽读本第九十九辑上册")]
    own = {("d", "林丽读本第六辑"), ("e", "讲评与练习")}
    for doc, t in titles * 60:
        x = list(t)
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(x))
            x[i : i + 1] = random.choice(([], [random.choice("林丽右")], [x[i], "了"]))
        own |= {(doc, "".join(x))} if len(x) > 3 else set()
    want = {(d, s) for d, s in own if any(d == e and edits(s, t) <= min(2, len(t) // 4) for e, t in titles)}
    got = scan.title_forms(spark.createDataFrame(sorted(own), "doc string, title string"), spark.createDataFrame(titles, "doc string, title string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) < len(own) - 20


def test_repair_goes_over_whole_batches(monkeypatch):
    calls = []
    for f in ("canonical", "_misread_signs"):
        monkeypatch.setattr(scan, f, lambda *a, f=getattr(scan, f), n=f: calls.append(n) or f(*a))
    words = scan.Words(np.zeros(scan.BUCKETS, np.int32))
    texts = ["讲评与练习\nThe b0at is old.", "正文。\n- 2 -", "Nor-\ngre sleeps."]
    assert scan.repair_texts(texts, [1, 2, 3], [False] * 3, [["讲评与练习"], None, []], words) == ["The boat is old.", "正文。", "Norgre\nsleeps."]
    assert calls == ["canonical", "_misread_signs"]
