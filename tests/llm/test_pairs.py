import itertools
import random

import pytest
from pyspark.sql import functions as F

from inkwell.llm import lookalike, near, sets


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("seed,theta", [(1, 0.6), (2, 0.8), (3, 0.5)])
def test_similar_sets_equal_brute_force(spark, seed, theta):
    random.seed(seed)
    common, rare = [f"c{i}" for i in range(4)], [f"r{i}" for i in range(60)]
    own = []
    for i in range(220):
        base = set(random.choices(common, k=random.randint(0, 3)) + random.choices(rare, k=random.randint(0, 9)))
        own.append(base)
        if i % 3 == 0 and base:
            own.append(base - {next(iter(base))} | ({random.choice(rare)} if i % 2 else set()))
    rows = [(f"k{i:04}", sorted(s) or None if i % 5 else sorted(s)) for i, s in enumerate(own)]
    rows += [rows[0], (None, ["x"]), ("solo", ["only"]), ("null", [None]) if False else ("empty", [])]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations([r for r in {k: v for k, v in rows if k}.items() if r[1]], 2) for a, b in [sorted((a, b))] if jaccard(set(x), set(y)) >= theta}
    d = spark.createDataFrame(rows, "key string, items array<string>").withColumn("class", F.lit("clash"))
    got = sets.similar_pairs(d, theta).collect()
    assert {(r.left, r.right) for r in got} == want and len(got) == len(want) and want


def test_longer_prefixes_are_chosen_and_lose_nothing(spark):
    random.seed(9)
    items = [f"t{i}" for i in range(14)]
    rows = [(f"k{i:03}", random.sample(items, random.randint(5, 9))) for i in range(160)]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if jaccard(set(x), set(y)) >= 0.6}
    got = sets.similar_pairs(spark.createDataFrame(rows, "key string, items array<string>"), 0.6)
    assert {(r.left, r.right) for r in got.collect()} == want and len(want) > 50


def test_normal_set(spark):
    d = spark.createDataFrame([([" A", "a ", None, "", "　", "B"],), (None,), ([],)], "x array<string>")
    assert [r[0] for r in d.select(sets.normal_set(F.col("x"))).collect()] == [["a", "b"], None, []]


def test_empty_tables(spark):
    assert sets.similar_pairs(spark.createDataFrame([], "key string, items array<string>")).count() == 0
    assert near.near_pairs(spark.createDataFrame([], "key string, text string")).count() == 0
    assert lookalike.look_alike_pairs(spark.createDataFrame([], "name string, key string, text string")).count() == 0


@pytest.mark.parametrize("theta", [0.6, 0.8])
def test_near_pairs_equal_brute_force(spark, theta):
    random.seed(5)
    words = [f"{random.choice('山水风云日月')}{random.choice('东南西北')}{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        base = [random.choice(words) for _ in range(random.randint(2, 30))]
        for _ in range(3):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts.append("".join(copy))
    rows = [(f"k{i:03}", t) for i, t in enumerate(texts)] + [("z1", None), ("z2", ""), ("z3", "短"), (None, texts[0]), ("k000", texts[0]), ("long", "长" * 3000 + texts[1])]
    runs = {k: {t[i : i + 3] for i in range(len(t) - 2)} for k, t in rows if k and t and len(t) > 2}
    want = {tuple(sorted(p)) for p in itertools.combinations(runs, 2) if jaccard(runs[p[0]], runs[p[1]]) >= theta}
    got = near.near_pairs(spark.createDataFrame(rows, "key string, text string").withColumn("class", F.lit(1)), theta).collect()
    assert {(r.left, r.right) for r in got} == want and len(got) == len(want) and want


def test_near_pairs_split_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    rows = [(f"k{i:03}", "同一开头的很长一句话放在这里" + chr(0x4E00 + i) + chr(0x4F00 + i)) for i in range(70)]
    got = near.near_pairs(spark.createDataFrame(rows, "key string, text string"), 0.6)
    assert got.count() == got.distinct().count() == 70 * 69 // 2


def test_hot_cells_are_split_on_both_sides(spark, monkeypatch):
    """A third of all texts share their beginning: cells of many records, cut into small blocks, lose no pair."""
    import random

    from inkwell.llm import near

    random.seed(11)
    letters = "abcdefghijklmnop"
    rows = []
    for i in range(240):
        t = "".join(random.choice(letters) for _ in range(random.randint(5, 30)))
        rows.append((f"k{i:03}", "gemeinsamer anfang aller texte " * (i % 3 == 0) + (rows[-1][1][:-2] + "zz" if i % 4 == 1 else t)))

    def brute():
        g = {k: {t[j : j + 3] for j in range(len(t) - 2)} for k, t in rows}
        return {(a, b) for a in g for b in g if a < b and g[a] and len(g[a] & g[b]) / len(g[a] | g[b]) >= 0.6 - 1e-12}

    d = spark.createDataFrame(rows, "key string, text string")
    want = brute()
    for block in (4096, 8):
        monkeypatch.setattr(near, "BLOCK", block)
        assert {tuple(r) for r in near.near_pairs(d).collect()} == want
    assert len(want) > 100
    monkeypatch.setattr(near, "LEAST", 1 << 14)
    monkeypatch.setattr(near, "MOST", 1 << 14)
    monkeypatch.setattr(near, "PART", 1 << 12)
    assert {tuple(r) for r in near.near_pairs(d).collect()} == want
