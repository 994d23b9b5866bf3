from inkwell.llm import sets


def test_one_shared_member_does_not_make_sets_alike(spark):
    rows = [("a", ["x", "p", "q"]), ("b", ["x", "r", "s"]), ("c", ["x", "p", "q", "t"]), ("d", ["x"])]
    got = sets.similar_pairs(spark.createDataFrame(rows, "key string, items array<string>"), 0.6).collect()
    assert [tuple(r) for r in got] == [("a", "c")]
