import pytest
from pyspark.sql import functions as F

from inkwell.llm import scan


@pytest.mark.parametrize("line", ["〇7", "7〇", "〇 7 〇", "○7", "◯ 7", "— 〇7 —", "第7页", "- 7 -"])
def test_ringed_zero_around_a_page_number(line):
    assert scan.title_parts(line, 7) == ("", True) and scan.title_parts(line, 8) == ("", False)


@pytest.mark.parametrize("line", ["〇7 | 林丽读本", "林丽读本 | 〇7", "7〇 · 林丽读本", "林丽读本　　〇 7"])
def test_ringed_zero_beside_a_title(line):
    assert scan.title_parts(line, 7) == ("林丽读本", True)


@pytest.mark.parametrize("line", ["二〇7", "二〇〇7年", "〇七"])
def test_numerals_are_no_page_number(line):
    assert not scan.NUMBER_LINE.match(line) and not scan.title_parts(line, 7)[1]


def test_ringed_zero_in_records(spark):
    text = "丰收之后，乌莫丽的石匠一家在旧车站后面修补一条旧船。"
    rows = [("page_texts", "p7", "d", 7, f"{text}\n〇7", False), ("page_texts", "p8", "d", 8, f"{text}\n〇7", False), ("question_candidates", "q", "d", 7, f"{text}\n〇7\n{text}", True)]
    d = spark.createDataFrame(rows, "name string, key string, doc string, page int, text string, inside boolean")
    assert {r.key for r in scan.scan_noise(d).where(F.col("kind") == "page_number").collect()} == {"p7", "q"}
    assert {r.key: "〇7" in r.text for r in scan.repaired_texts(d).collect()} == {"p7": False, "p8": True, "q": False}
