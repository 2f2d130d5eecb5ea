import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from placewise.llm.filter_audit import audit_filters, filter_masks, range_bounds, _mark, _MARKED
from placewise.llm.radix_trie import RadixTrie, common_length



WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def plain_masks(rows):
    """(doc_id, part, set of failed filters) of (doc_id, text, lang) rows."""
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        failed = set()
        if len(words) < 200:
            failed.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            failed.add("C")
        if any(c in "#$%&*|" for c in text):
            failed.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
            failed.add("E")
        out.append((doc_id, lang or "", "".join(sorted(failed))))
    return out


def plain_audit(masks, quality, toxic):
    rows = []
    for part in {p for _, p, _ in masks}:
        docs = [(i, f) for i, p, f in masks if p == part]
        found = {}
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                fails = sum(x in f for _, f in docs)
                found[order, step] = (
                    len(left), len(gone), fails - len(gone), sum(f == x for _, f in docs),
                    sum(quality.get(i, 0) == 1 for i, _ in gone), sum(toxic.get(i, 0) == 1 for i, _ in gone),
                )
        for (order, step), r in found.items():
            share = sum(v[1] for (o, s), v in found.items() if o[s - 1] == order[step - 1])
            rows.append((part, "".join(order), step, *r, share))
    return sorted(rows)


def told(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


def letters(frame):
    return sorted(((r["doc_id"], r["part"], "".join(x for i, x in enumerate("ABCDE") if r["mask"] >> i & 1)) for r in frame.collect()), key=repr)


def test_trie_holds_the_smallest_ids():
    rng = random.Random(3)
    texts = [b"", b"a"] + ["".join(rng.choice("abé") for _ in range(rng.randrange(60))).encode() for _ in range(500)]
    texts += [texts[rng.randrange(len(texts))] + b"xy" * rng.randrange(3) for _ in range(500)]
    trie, least = RadixTrie(), {}
    for i, text in sorted(enumerate(texts), key=lambda _: rng.random()):
        trie.insert(text, i).members[:] = [text]
        least[text] = min(i, least.get(text, i))
    found = [(n.members[0], n.least) for n in trie.terminals()]
    assert found == sorted(least.items())
    assert common_length(b"x" * 5000 + b"a", b"x" * 5000 + b"b") == 5000


@pytest.mark.parametrize("header", [0, 3000])
def test_separators_cut_evenly_below_a_common_beginning(header):
    rng = random.Random(4)
    texts = sorted({b"h" * header + bytes(rng.choices(b"abc", k=rng.randrange(1, 80))) for _ in range(2000)})
    trie = RadixTrie()
    for text in texts:
        trie.insert(text, 1)
    assert trie.size == sum(map(len, texts))
    cuts = trie.separators(trie.size // 40)
    assert cuts == sorted(cuts) and len(cuts) > 10
    sizes = [sum(a <= t < b for t in texts) for a, b in zip([b"", *cuts], [*cuts, b"\xff"], strict=True)]
    assert sum(sizes) == len(texts) and max(sizes) < len(texts) / 5


def test_masks_of_copies_in_many_tasks(spark):
    rng = random.Random(5)
    base = ["shared header " * 40 + f"text {i} " * rng.randrange(1, 90) for i in range(40)]
    rows = [(i, rng.choice(base), rng.choice(["en", "de", None])) for i in rng.sample(range(10_000), 600)]
    rows += [(i, base[0], "en") for i in range(20_000, 20_400)]  # a third of all rows
    rows += [(None, base[0], "en"), (7, None, "en"), (7, "", "en"), (3, "", ""), (20_000, base[0], "en")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9)
    assert letters(filter_masks(docs)) == sorted(plain_masks(rows), key=repr)
    marked = docs.select("doc_id", F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit(""))).mapInArrow(_mark, _MARKED).cache()
    # One row of text a task however many copies, and bounds that fall behind the common header.
    assert marked.where(F.col("text") == base[0]).count() <= 9
    assert sum(len(b) > 560 for b in range_bounds(marked, 8)) >= 5


def test_orders_against_brute_force(spark, documents, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    marks = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    wanted = plain_audit(plain_masks(rows), {i: m[0] for i, m in marks.items()}, {i: m[1] for i, m in marks.items()})
    assert told(audit_filters(documents, labels)) == wanted
    assert len(wanted) == 600 * len({r[2] for r in rows})


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(1, 1, 0, "clash"), (1, 0, 1, "clash"), (2, None, None, ""), (None, 1, 1, ""), (4, 1, 0, "x")],
        "doc_id long, quality int, toxic int, part string",
    )
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()]
    masks = plain_masks(rows)
    assert letters(filter_masks(odd_docs)) == sorted(masks, key=repr)
    assert told(audit_filters(odd_docs, labels)) == plain_audit(masks, {1: 1, 4: 1}, {1: 1})
    assert audit_filters(no_docs, labels).collect() == []
    assert told(audit_filters(odd_docs, labels.where("false"))) == plain_audit(masks, {}, {})


def test_plan_compares_no_pairs(documents, labels):
    plan = audit_filters(documents, labels)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
