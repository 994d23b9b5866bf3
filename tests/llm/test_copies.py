import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import leak


def score(x, y):
    """Smith-Waterman cell by cell, over the score of a whole copy."""
    h, best = [0] * (len(y) + 1), 0
    for a in x:
        row = [0]
        for j, b in enumerate(y, 1):
            row.append(max(0, h[j - 1] + (leak.MATCH if a == b else leak.MISMATCH), h[j] + leak.GAP, row[j - 1] + leak.GAP))
        h, best = row, max(best, *row)
    return best / (leak.MATCH * len(x))


def run(x, y):
    return max((n for n in range(len(x) + 1) if any(x[k : k + n] in y for k in range(len(x) - n + 1))), default=0)


def edited(t, share, signs):
    out = []
    for c in t:
        k = random.random()
        out.append(c if k > share else random.choice(["", random.choice(signs), c + random.choice(signs)]))
    return "".join(out)


def cases():
    random.seed(6)
    signs = "abcdefgh山水风云"
    items = [(i, "".join(random.choices(signs, k=random.randint(1, 60)))) for i in range(14)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for n in range(90):
        p = random.choice(items[:14])[1]
        a = random.randrange(len(p) // 2 + 1)
        docs.append((n, "".join(random.choices(signs, k=random.randint(0, 40))) + edited(p[a : a + random.randint(len(p) // 3, len(p))], random.random() / 3, signs).upper() + "! " + "".join(random.choices(signs, k=random.randint(0, 30)))))
    return docs + [(500, None), (None, items[0][1]), (501, ""), (502, items[0][1] * 3), (503, "—")], items


@pytest.mark.parametrize("share", [0.5, 0.7])
def test_copies_equal_brute_force(spark, share):
    docs, items = cases()
    want = {}
    for d, t in docs:
        for i, p in items:
            x, y = leak.plain(p), leak.plain(t)
            if d is not None and x and y and score(x, y) >= share:
                want[d, i] = (run(x, y), len(x), round(score(x, y), 6))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    e = spark.createDataFrame(items, "item_id long, text string")
    got = leak.copies(d, e, share).collect()
    assert {(r.doc_id, r.item_id): (r.run, r.item_len, round(r.score, 6)) for r in got} == want and len(got) == len(want)
    assert {(r.doc_id, r.item_id) for r in leak.leaks(d, e, share, align=False).collect()} < set(want)
    assert leak.copies(d.limit(0), e).count() == leak.copies(d, e.limit(0)).count() == 0


def test_blocks_and_widths_change_nothing(spark, monkeypatch):
    docs, items = cases()
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, leak.copies(d, e).collect()))
    monkeypatch.setattr(leak, "DOCS", 7)
    monkeypatch.setattr(leak, "ITEMS", 4)
    assert sorted(map(tuple, leak.copies(d, e).collect())) == whole
    texts = [np.array(list(map(ord, leak.plain(t)))) for _, t in docs if t and leak.plain(t)]
    x = np.array(list(map(ord, items[0][1])))
    for f in (leak._best_alignments, leak._longest_runs):
        one = leak._each(f, x, texts)
        monkeypatch.setattr(leak, "WIDTH", 50)
        assert (leak._each(f, x, texts) == one).all()
        monkeypatch.undo()


def test_an_edited_copy_without_a_long_run(spark):
    text = "The night conductor of Harqua sorts the scattered letters in front of the town hall at dusk, until the bell rings again and the keeper of the tower closes the gate."
    copy = "".join(c if k % 16 else "x" for k, c in enumerate(text))
    d, e = spark.createDataFrame([(1, "Before. " + copy + " After."), (2, "The bell rings again.")], "doc_id long, text string"), spark.createDataFrame([(7, text)], "item_id long, text string")
    assert not leak.leaks(d, e).count()
    r = leak.copies(d, e).collect()
    assert [(x.doc_id, x.item_id) for x in r] == [(1, 7)] and r[0].run < r[0].item_len / 4 and r[0].score > 0.5
