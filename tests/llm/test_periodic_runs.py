import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from placewise.llm.periodic_runs import collapse_runs, digest_runs, find_runs, kept_words, planted_periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every lag, word by word; of the lags of one stretch the smallest."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start >= max(12 - q, q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, words):
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    told = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in (told, rest)))


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(250):
        n = rng.choice([11, 12, 13, 24, 48, 90, 140])
        kind = rng.randrange(5)
        if kind == 0:
            words = [rng.choice("ab") for _ in range(n)]
        elif kind == 1:
            words = []
            while len(words) < n:
                words += [rng.choice("ab") for _ in range(rng.randrange(1, 25))] * rng.randrange(1, 5)
        elif kind == 2:
            words = fibonacci(n + 9)[rng.randrange(9) :]
        elif kind == 3:
            words = ["a"] * n
            for _ in range(rng.randrange(5)):
                words[rng.randrange(n)] = "b"
        else:
            words = ([rng.choice("abc") for _ in range(rng.randrange(1, 25))] * n)[:n]
            words[rng.randrange(n)] = "x"
            words = words * rng.randrange(1, 4)
        assert [tuple(r) for r in find_runs(words).tolist()] == plain_runs(words), "".join(words)


def test_hand_computed():
    words = "x a b c a b c a b c a b c y".split()
    assert find_runs(words).tolist() == [[1, 12, 3]]
    assert [w for w, k in zip(words, kept_words(14, find_runs(words)), strict=True) if k] == "x a b c y".split()
    assert find_runs("a b c a b c a b c a b".split()).tolist() == []  # eleven words
    assert find_runs(["a"] * 40).tolist() == [[0, 40, 1]]  # not also periods 2, 3, ...


@pytest.mark.parametrize(
    "words",
    [["a"] * 200_000, ["a"] * 100_000 + ["b"] + ["a"] * 100_000, ["x", "y", "x"] * 70_000, fibonacci(200_000), [str(i) for i in range(200_000)]],
    ids=["one word", "two blocks", "one period", "fibonacci", "no repeats"],
)
def test_long_texts_take_little_time(words):
    start = time.time()
    find_runs(words)
    assert time.time() - start < 20


def test_documents_against_brute_force(documents):
    rows = documents.where(F.length("text") < 4000).collect()
    assert len(rows) > 100
    found = {r["doc_id"]: tuple(r) for r in digest_runs(collapse_runs(planted_periods(documents))).collect()}
    assert sum(r[1] > 0 for r in found.values()) > 10
    for r in rows:
        assert found[r["doc_id"]] == plain_digest(r["doc_id"], plain_planted(r["doc_id"], r["text"]))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in digest_runs(collapse_runs(planted_periods(odd_docs))).collect()]
    given = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if len(r["text"] or "") < 1000]
    wanted = [plain_digest(i, plain_planted(i, t)) for i, t in given]
    short = [r for r in rows if r[0] != 4]
    assert sorted(short, key=repr) == sorted(wanted, key=repr)
    assert len(rows) == odd_docs.count() and all(r[6] and r[7] for r in rows)
    # "lorem ipsum dolor" 15,000 times; the x at the end is one word of its own.
    assert [r[1:5] for r in [tuple(x) for x in digest_runs(collapse_runs(odd_docs)).collect()] if r[0] == 4] == [(1, 0, 45_000, 3)] * 2
    assert digest_runs(collapse_runs(planted_periods(no_docs))).collect() == []


def test_other_columns_pass(odd_docs):
    rows = collapse_runs(odd_docs, keep=("doc_id", "source", "n_words", "score")).collect()
    assert len(rows) == 10 and {r["score"] for r in rows} == {"clash"}
    assert rows[0]["collapsed"].startswith("The first document")
