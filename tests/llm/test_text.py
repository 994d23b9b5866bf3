import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import encoding, leak, lookalike, mix, residue, scan, spam

SENTENCE = "黄昏时，诺奥米的书贩在河边为新桥筹集石料，即使地图上没有标出。"


def test_canonical_equals_composed_form_of_accents():
    random.seed(1)
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x300, 0x315), *range(0xC0, 0x180), *range(0x1E00, 0x1EF9))]
    texts = ["".join(random.choices(letters, k=random.randint(0, 8))) for _ in range(3000)]
    got = lookalike.canonical(texts)
    assert got == lookalike.canonical([unicodedata.normalize("NFD", t) for t in texts]) == lookalike.canonical(got)
    alone = {c for c in letters if lookalike.canonical([c])[0] == unicodedata.normalize("NFC", c)}
    plain = [(t, g) for t, g in zip(texts, got) if set(t) <= alone]
    assert all(unicodedata.normalize("NFC", t) == g for t, g in plain) and len(plain) > 1000


@pytest.mark.parametrize("a,b", [("ＡＢ１，", "AB1,"), ("а с", "a c"), ("ﬁn", "fin"), ("x​y", "xy"), ("a b", "a b"), ("⽂⼀", "文一"), ("料", "料"), ("é", "é"), ("｡", "。")])
def test_same_look(a, b):
    x, y = lookalike.canonical([a, b])
    assert x == y


@pytest.mark.parametrize("a,b", [("A", "a"), ("é", "è"), ("²", "2"), ("①", "1"), ("a\nb", "a b"), ("ü", "u")])
def test_other_look(a, b):
    x, y = lookalike.canonical([a, b])
    assert x != y


def test_look_alike_pairs(spark):
    rows = [("t", "1", "a,b"), ("t", "2", "a，b"), ("t", "3", "a，b"), ("t", "4", " "), ("t", "5", "　"), ("t", "6", None), ("t", None, "a,b"), ("u", "7", "a，b"), ("t", "1", "a,b")]
    d = spark.createDataFrame(rows, "name string, key string, text string").withColumn("raw", F.lit(1))
    assert {tuple(r) for r in lookalike.look_alike_pairs(d).collect()} == {("t", "1", "2"), ("t", "1", "3")}
    assert [r[0] for r in d.select(lookalike.canonical_text("text")).limit(2).collect()] == ["a,b", "a,b"]


@pytest.mark.parametrize("source,wrong", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("gbk", "latin-1"), ("gbk", "cp1252")])
def test_encoding_round_trip(source, wrong):
    back = {b: c for c, b in encoding._bytes_of(wrong).items()}
    garbled = "".join(back.get(b, chr(b)) for b in SENTENCE.encode(source))
    text, done, lost, met = encoding.restore("前文没有问题。\n" + garbled + "\nplain tail")
    assert text == "前文没有问题。\n" + SENTENCE + "\nplain tail" and done and not lost


def test_twice_garbled_and_two_byte_reading():
    once = SENTENCE.encode().decode("latin-1")
    assert encoding.restore(once.encode().decode("latin-1"))[0] == SENTENCE
    half = "黄昏时分的书贩在河边"[:10].encode().decode("gb18030", "replace")
    _, done, lost, _ = encoding.restore("头。" + half)
    assert done + lost > 0


@pytest.mark.parametrize("text", ["Café Ålund, Straße der Gärtner, São Ulmó", "Señor Quiñal añadió: «¡Así será!»", "Ветер над старой рекой не стихает до утра.", "δέλτα και γάμμα, λόγος", SENTENCE, "naïve façade, Ærø, Łódka, ÃÉÕ", "«Où est la clé ?»", "", "abc", "£12 or €14; 5 °C — “q”"])
def test_ordinary_text_is_left_alone(text):
    assert encoding.restore(text) == (text, 0, 0, "")


def test_repair_encoding(spark):
    bad = "é".join(["x"] * 3).encode().decode("cp1252")
    d = spark.createDataFrame([("1", bad), ("2", "ok é"), ("3", None), (None, bad), ("4", "�� x"), ("5", "")], "page_key string, text string").withColumn("key", F.lit("clash"))
    assert {(r.key, r.restored > 0) for r in encoding.repair_encoding(d, "page_key", "text").collect()} == {("1", True), ("4", False)}


@pytest.mark.parametrize("text", ["{{ title }}", "本节介绍 %page%，共 %page% 项。", "讲评人：${name}　日期：${date}", "【作者】：【】", "[请填写title]", "<在此输入说明>", "TODO：补全x", "典故的用意：待补充", "Lorem ipsum dolor", "词语的语境义标题占位", "404 Not Found", "Access denied. Request id 1", "[object Object]", "讲评。请启用 JavaScript 后继续浏览。", "noscript: content unavailable", "xxxxxx", "同上，略", "测试测试测试", "null", SENTENCE + "服务器繁忙，请稍后再试"])
def test_residue(text):
    assert residue.residue(lookalike.canonical([text])[0])


@pytest.mark.parametrize("text", ["题目用集合 {a, b, c} 表示三个层次", "《空白》一文的标题写作“[ ]”", "说明文介绍 JavaScript 的由来", "短文批评“请稍后再试”式的敷衍", "小说里反复出现“页面不存在”这句旁白", "选段写机器报错 65 次而主人公不以为意", "TODO 一词在访谈里指待办清单", "材料谈到服务器返回 404 的原因", "请在 ______ 处补写恰当的句子", "“略”“同上”在古人札记中常见", "学生把“待补充”当成答案写进试卷", "```\n{{ name }}\n```\n模板语法用 `{{ x }}` 表示变量。", SENTENCE, ""])
def test_no_residue(text):
    assert not residue.residue(lookalike.canonical([text])[0])


def test_residue_records(spark):
    d = spark.createDataFrame([("b", "1", "{{x}}"), ("b", "2", None), ("b", None, "{{x}}"), ("b", "3", "")], "name string, key string, text string").withColumn("kinds", F.lit(0))
    assert [(r.key, r.kinds, r.density) for r in residue.residue_records(d).collect()] == [("1", "field", 1.0)]
    assert residue.residue_records(d.limit(0)).count() == 0


def leak_brute(docs, items, share):
    out = set()
    for d, t in docs:
        for i, p in items:
            a, b = leak.plain(p), leak.plain(t)
            need = max(1, int(-(-len(a) * share // 1)))
            if a and any(a[k : k + need] in b for k in range(len(a) - need + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(random.randint(3, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for n in range(150):
        t = " ".join(word() for _ in range(random.randint(0, 30)))
        if n % 2:
            p = random.choice(items[:25])[1]
            a = random.randrange(len(p) // 2 + 1)
            t += " " + p[a : a + random.randint(len(p) // 3, len(p))].upper() + "! " + t
        docs.append((n, t))
    docs += [(500, None), (None, items[0][1]), (501, ""), (502, items[0][1] * 3), (0, docs[0][1])]
    want = leak_brute([d for d in docs if d[0] is not None and d[1]], [i for i in items if i[1]], 0.5)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = leak.leaks(d, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 20
    assert got.where("item_id = 0 and doc_id = 502").first().score == 1.0
    assert leak.leaks(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_alignment_bears_edits():
    a = np.frombuffer("abcdefghij".encode("utf-32-le"), np.uint32)
    b = np.frombuffer("xxabcdXefghijxx".encode("utf-32-le"), np.uint32)
    assert leak.align_score(a, a) == 1.0 and leak.align_score(a, b) == (10 * 2 - 4) / 20 and leak.align_score(a, b[:0]) == 0.0


def test_water_fill():
    fill = mix.water_fill({"a": 100, "b": 100, "c": 100}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 5, "c": 5}, 300)
    assert fill["a"] == 100 and abs(fill["b"] - 120) < 1e-6 and abs(fill["c"] - 80) < 1e-6
    assert mix.water_fill({"a": 10}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 3}, 100) == {"a": 20.0, "b": 0.0}
    assert mix.water_fill({}, {"a": 1.0}, {"a": 1}, 0) == {"a": 0.0}


def test_mix(spark):
    docs = [(i, ["A b", "a-b", "c", None, "x"][i % 5], f"text number {i} " * (1 + i % 3)) for i in range(500)] + [(900, "c", None), (None, "c", "x y"), (901, "c", "")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("copies", F.lit("clash"))
    t = spark.createDataFrame([("a_b", 0.2, 1), ("c", 0.7, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    taken, shares = mix.mix(d, t)
    s = {r.source: r for r in shares.collect()}
    assert s["none"].selected_tokens == 0 and abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    rows = taken.collect()
    assert max(r.copies for r in rows if r.source == "c") <= 3 and {r.source for r in rows} <= {"a_b", "c"} and len({r.doc_id for r in rows}) == len(rows)
    assert sum(r.copies * r.n_tokens for r in rows if r.source == "c") == s["c"].selected_tokens
    assert abs(s["c"].selected_tokens - s["c"].epochs * s["c"].tokens) < 0.02 * s["c"].tokens
    assert sorted(map(tuple, mix.mix(d, t)[0].collect())) == sorted(map(tuple, rows))


STUFFED = ["lamp " * 30, "lamp, buy lamp, lamp, cheap lamp, lamp, lamp", "Our kettle is the kettle for kettle lovers! Buy kettle, love kettle, gift kettle!", "http://a.example/x\nhttp://b.example/y\n- www.c.test/z", "lamp-blue-12 desk-xl-9 boots-red-77 lamp-s-5", "Home | Login | lamp Dor | Home | Cart | lamp Dor | Next | Next | Home", "雨靴 价格 雨靴 批发 雨靴 雨靴 直销 雨靴", "水壶专家巴奥水壶水壶! 买水壶到塔温乌水壶，水壶品质水壶!", "desk A11 4.50\nlamp B22 3.20\nboots X8 9.99", "shop.jp/a\nkaufen-hier.ru/b/c\nsklep.pl\nlojas.uk/x", "lamp, kettle, desk lamp, boots, cheap chair, sofa, carpet, mirror, shelf"]
PROSE = ["The miller draws the plans of the canal by the river, because the water is rising. See https://a.example/x for more.", "Ce jour-là, 7950 personnes sont venues.\n" * 4, "– Come in, said the keeper of the tower.\n– Not yet, said the potter.\n– Why not?", SENTENCE * 5, "Der Weg soll 511 Schritte lang sein.", "wein\nauf\ndem\nvollen\nMarkt\nwährend\nder langen Regenzeit, und die Gewohnheit blieb.", "On that day 393 people came.\nOn that day 393 people came.On that day 393 people came.", "THE CHOIR REVISES A SONG KNOWN FOR GENERATIONS DEEP IN THE GROVE."]


@pytest.mark.parametrize("text,want", [(t, True) for t in STUFFED] + [(t, False) for t in PROSE])
def test_stuffed(text, want):
    usual = {k: {"function": v} for k, v in {"en": 0.43, "de": 0.44, "fr": 0.48, "zh": 0.25, "und": 0.0}.items()}
    assert (spam.stuffed_share(text, usual) > 0.5) is want


def test_stuffed_pages(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(STUFFED + PROSE * 4)] + [(99, None), (98, ""), (97, " \n"), (None, STUFFED[0])], "doc_id long, text string").withColumn("share", F.lit("clash"))
    assert {r.doc_id for r in spam.stuffed_pages(d).collect()} == set(range(len(STUFFED)))
    assert spam.stuffed_pages(d.limit(0)).count() == 0


def scan_rows():
    rows = []
    for p in range(1, 31):
        title = "《林丽读本》第六辑" if p % 2 else "讲评与练习"
        if p == 7:
            title = "《林丽读》第六辑"
        body = "\n".join("丰收之后，乌莫丽的石匠一家在旧车站后面修补一条旧船，因为没有人记得旧规矩。" for _ in range(3))
        rows.append(("page_texts", f"p{p:02}", "d", p, f"{title}\n{body}\n— {p} —", False))
    rows[4] = (*rows[4][:4], rows[4][4].replace("石匠", "右匠", 1).replace("的", "白勺", 1), False)
    for p in range(1, 31):
        rows.append(("page_texts", f"e{p:02}", "e", p, "The potter of Norgre repairs an old boat behind the station at dusk.\n" * 3, False))
    rows.append(("page_texts", "e90", "e", 90, "The potter of Nor-\ngre repairs an old bo¬\nat behind the station at dusk.", False))
    rows.append(("page_texts", "e91", "e", 91, "Tlie p0tter of Norgre repairs an old boat bchind the station at dusk.", False))
    rows.append(("page_texts", "t1", "f", 1, "《多温读本》第十辑\n32\n" + SENTENCE, False))
    rows.append(("question_candidates", "q1", "d", 3, "3. 分析细节。\n- 3 -\n《林丽读本》第六辑\n丰收之后，乌莫丽的石匠一家在旧车站。", True))
    return rows + [("page_texts", "n1", None, None, "正文一句。", False), ("page_texts", "n2", "d", 5, None, False), ("page_texts", "n3", "d", 5, "", False), ("page_texts", None, "d", 5, "x", False), rows[0]]


def test_scan_noise(spark):
    d = spark.createDataFrame(scan_rows(), "name string, key string, doc string, page int, text string, inside boolean").withColumn("kind", F.lit("clash"))
    got = {(r.key, r.kind) for r in scan.scan_noise(d).collect()}
    want = {(f"p{p:02}", k) for p in range(1, 31) for k in ("header", "page_number")} | {("p05", "misread"), ("e90", "hyphen"), ("e91", "misread"), ("q1", "header"), ("q1", "page_number")}
    assert got == want
    assert scan.scan_noise(d.limit(0)).count() == 0


def test_repaired_texts(spark):
    d = spark.createDataFrame(scan_rows(), "name string, key string, doc string, page int, text string, inside boolean")
    got = {r.key: r.text for r in scan.repaired_texts(d).collect()}
    line = "丰收之后,乌莫丽的石匠一家在旧车站后面修补一条旧船,因为没有人记得旧规矩。"
    assert got["p05"] == got["p06"] == "\n".join([line] * 3)
    assert got["e91"] == "The potter of Norgre repairs an old boat behind the station at dusk."
    assert got["e90"].replace("\n", " ") == "The potter of Norgre repairs an old boat behind the station at dusk."
    assert got["q1"] == "3. 分析细节。\n丰收之后,乌莫丽的石匠一家在旧车站。" and got["n2"] is None and got["n3"] == ""


def test_broken_lines():
    assert scan._joined(["在漫长的雨季等待迟到的货车，因", "为没有人记得旧规矩。", "- 一"]) == ["在漫长的雨季等待迟到的货车，因为没有人记得旧规矩。", "- 一"]
    assert scan._joined(["黄昏时种下三排柳树，", "节日前夜整理失散的信件。"]) == ["黄昏时种下三排柳树，", "节日前夜整理失散的信件。"]
    assert scan._joined(["the quick brown fox jumps", "over the lazy dog again"]) == ["the quick brown fox jumps over the lazy dog again"]


def test_residue_in_context():
    from inkwell.llm.residue import residue

    for t in (
        "In the templating syntax the placeholder {{ name }} is replaced by the value, as the manual explains in detail.",
        "The shell expands ${HOME} to the user's own directory, so the variable need not be quoted in this example.",
        "Every reader knows the words 404 Not Found, yet few can say what the status code means to the server.",
        "The guard said Access denied, and the whole company turned back into the long and narrow street again.",
    ):
        assert residue(t) == {}, t
    for t in ("Please enable JS to view this site", "This page can't be found.", "Dear {first name}, welcome", "{% if user %}", "Hello *|FNAME|*", "Access denied", "404 Not Found", "啊啊啊啊啊", "天地天地天地"):
        assert residue(t), t


def test_repeats_name_every_text_that_repeats():
    from inkwell.llm.residue import FILLER, repeats

    texts = ["啊啊啊啊", "啊啊啊啊啊", "天地天地", "", "天地天地天地", "一二三四五六" * 3, "一二三四五六" * 2, "地天", "天" * 3 + "a" * 9, "春秋冬夏春秋冬夏春秋冬夏"]
    for t, r in zip(texts, repeats(texts)):
        assert r or not FILLER.search(t)
    assert repeats(texts).sum() < len(texts) - 3
