import math
import random
import re
from itertools import combinations

import numpy as np
import pytest

from placewise.llm.decontaminate import ALL_MASKS, MASKS, aligned_overlap, drop_leaks, find_leaks, item_masks

from .conftest import ROWS


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def plain_leaks(docs, items, overlap=13, agreement=0.7):
    """Every alignment of every document with every item, no seeds."""
    found = set()
    for doc, text in docs:
        d = tokens(text)
        for item, passage in items:
            p = tokens(passage)
            if len(p) < min(map(len, MASKS)):
                continue
            size = min(overlap, len(p))
            for shift in range(-len(p) + size, len(d) - size + 1):
                low, high = max(0, -shift), min(len(p), len(d) - shift)
                same = [d[j + shift] == p[j] for j in range(low, high)]
                if any(sum(same[i : i + size]) >= agreement * size for i in range(len(same) - size + 1)):
                    found.add((doc, item))
    return found


def fixture():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(14, 40)))) for i in range(12)]
    items += [(50, "too short"), (51, None), (52, items[0][1])]
    docs = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        if i % 3 == 0:
            passage = tokens(items[rng.randrange(12)][1])
            for at in range(i % 5, len(passage), 5):  # every fifth word replaced, at most
                if i % 2:
                    passage[at] = "changed"
            body[10:10] = [w.upper() + "," for w in passage]
        docs.append((i, " ".join(body)))
    return docs, items


def test_leaks_agree_with_comparing_everything(spark):
    docs, items = fixture()
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = found.collect()
    want = plain_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    assert {d for d, _ in want} == {i for i in range(60) if i % 3 == 0}


def test_overlap_at_the_ends():
    around, item = np.arange(5, 25), np.arange(0, 12)
    assert aligned_overlap(around, item, -5, 13) == (0, 12, 7, 0)
    assert aligned_overlap(np.arange(0, 30), item, 0, 13) == (12, 12, 12, 0)


def test_odd_inputs(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, ROWS[0][1]), (None, "Ein Text ohne Nummer, aber mit Wörtern."), (3, None)], "item_id long, text string")
    rows = find_leaks(odd_docs, items).collect()
    assert sorted((r["doc_id"] is None, r["item_id"] is None) for r in rows) == [(False, False), (True, True)]
    left = drop_leaks(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == len(ROWS) - 2
    none = items.limit(0)
    assert find_leaks(odd_docs, none).count() == 0 and find_leaks(no_docs, items).count() == 0
    assert drop_leaks(odd_docs, none).count() == len(ROWS)


@pytest.mark.parametrize("size", range(6, 14))
def test_every_allowed_pattern_has_a_hit(size):
    agree = math.ceil(round(0.7 * size, 9))
    masks = [ALL_MASKS[m] for m in item_masks(size)]
    spots = [{s + i for i, c in enumerate(m) if c == "1"} for m in masks for s in range(size - len(m) + 1)]
    patterns = list(combinations(range(size), size - agree))
    assert [p for p in patterns if not any(spot.isdisjoint(p) for spot in spots)] == []
    assert size != 13 or len(patterns) == 286


def test_spread_substitutions_are_found(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(5000)]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    items = {size: pick(size) for size in [*range(6, 14), 20, 60]}
    changes = []
    for size in range(6, 14):
        allowed = size - math.ceil(round(0.7 * size, 9))
        changes += [(size, set(c)) for c in combinations(range(size), allowed)]
    changes += [(size, set(range(phase, size, 4))) for size in (20, 60) for phase in range(4)]
    docs = []
    for i, (size, gone) in enumerate(changes):
        passage = [f"new{i}x{at}" if at in gone else w for at, w in enumerate(items[size])]
        docs.append((i, " ".join(pick(30) + passage + pick(30))))
    found = find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(n, " ".join(p)) for n, p in items.items()], "item_id long, text string"),
    )
    met = {(r["doc_id"], r["item_id"]): r["n_words"] for r in found.collect()}
    assert all(met.get((i, size), 0) >= size - len(gone) for i, (size, gone) in enumerate(changes))
