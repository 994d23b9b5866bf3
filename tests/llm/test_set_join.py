import itertools
import random
from pathlib import Path

from pyspark.sql import functions as F

from inkwell.llm import sets


def pairs(rows, theta=0.6):
    own = {k: set(v) - {None} for k, v in rows if k and v}
    return {tuple(sorted(p)) for p in itertools.combinations([k for k in own if own[k]], 2) if len(own[p[0]] & own[p[1]]) >= theta * len(own[p[0]] | own[p[1]]) - 1e-9}


def rows_of(n):
    random.seed(4)
    return [(f"k{i:03}", random.sample([f"c{j}" for j in range(9)], random.randint(1, 5)) + [None] * (i % 7 == 0)) for i in range(n)] + [("one", ["c1"]), ("two", ["c1"]), ("none", [None])]


def test_frequent_keys_are_split_and_entries_shared(spark, monkeypatch):
    """Keys of more sets than a block, and a histogram so small that all its entries are shared, lose no pair."""
    rows = rows_of(150)
    d = spark.createDataFrame(rows, "key string, items array<string>")
    for name, value in (("BLOCK", 6), ("FREQUENT", 3), ("OFTEN", 8), ("LEAST", 8), ("MOST", 8), ("PART", 4)):
        monkeypatch.setattr(sets, name, value)
    got = sets.similar_pairs(d).collect()
    assert {tuple(r) for r in got} == pairs(rows) and len(got) == len(pairs(rows))


def test_hashed_sets_counted_with_their_repeats(spark):
    rows = rows_of(60)
    d = spark.createDataFrame(rows, "key string, items array<string>")
    h = d.select("key", sets.hashes(F.col("items")).alias("items"))
    assert {tuple(r) for r in sets.similar_pairs(h, 0.6, h.unionByName(h)).collect()} == pairs(rows)


def test_what_is_written_follows_the_sets_alone(spark):
    """Members are long texts: no text but the keys' may be written."""
    size = lambda: sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*.parquet"))
    random.seed(6)
    rows = [(f"k{i}", [f"{random.random()}" * 40 for _ in range(8)]) for i in range(300)]
    before = size()
    sets.similar_pairs(spark.createDataFrame(rows, "key string, items array<string>")).collect()
    assert 0 < size() - before < 300 * 8 * 40
