from inkwell.llm import scan

BODY = "丰收之后，乌莫丽的石匠一家在旧车站后面修补一条旧船。"


def page(doc, n, *lines, number=True):
    return ("page_texts", f"{doc}{n}", doc, n, "\n".join([*lines, BODY, *([f"- {n} -"] if number else [])]), False)


def rows():
    """Three documents with their titles on each page; then documents where one survived once."""
    out = [page(d, n, f"{name}高级中学 语文 试卷六") for d, name in (("a", "巴克"), ("b", "雅塔"), ("c", "丽温")) for n in range(1, 5)]
    out += [page("once", n, *(["伦林高级中学 语文 试卷八"] if n == 8 else [])) for n in range(1, 10)]
    out += [page("first", n, *(["多哈高级中学 语文 试卷二"] if n == 1 else [])) for n in range(1, 4)]
    out += [page("bare", n, *(["索米高级中学 语文 试卷二"] if n == 2 else []), number=False) for n in range(1, 4)]
    out += [page("other", n, *(["克温的清单 其二"] if n == 2 else [])) for n in range(1, 12)]
    out += [page("eleven", n, *(["维佐高级中学 语文 试卷三"] if n in (4, 7) else [])) for n in range(1, 12)]
    return [*out, ("question_candidates", "q", "once", 3, f"伦林高级中学 语文 试卷八\n{BODY}", True)]


def test_a_title_that_stands_once(spark):
    d = spark.createDataFrame(rows(), "name string, key string, doc string, page int, text string, inside boolean")
    headers = {r.key for r in scan.scan_noise(d).where("kind = 'header'").collect()}
    assert headers == {f"{x}{n}" for x in "abc" for n in range(1, 5)} | {"once8", "q", "eleven4", "eleven7"}
    texts = {r.key: r.text for r in scan.repaired_texts(d).collect()}
    assert "试卷" not in texts["once8"] + texts["q"] and "试卷" in texts["first1"] and "试卷" in texts["bare2"] and "清单" in texts["other2"]


def test_a_form_needs_other_documents(spark):
    own = [r for r in rows() if r[2] not in ("a", "b")]
    d = spark.createDataFrame(own, "name string, key string, doc string, page int, text string, inside boolean")
    assert {r.key for r in scan.scan_noise(d).where("kind = 'header'").collect()} == {f"c{n}" for n in range(1, 5)}
