import re
from collections import Counter

import numpy as np
import pytest

from placewise.llm.quality_rules import MEASURES, apply_quality_rules, count_columns

from .conftest import ROWS, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_counts_agree_with_plain_python(spark):
    texts = [
        *(r[1] for r in ROWS),
        "a b c d e f g h " * 2,
        "a b c d e f g h i a b c d e f g h",
        "x " * 9,
        "1 2 3 4 5 6 7 8 9 " * 3 + "tail",
        "one\none\n\n \none \n# * | <b> 😀😀",
        "a\x1cb c\x85d e",
    ]
    rows = count_columns(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == plain_counts(texts[r["i"]]), texts[r["i"]]


def test_counts_of_the_documents(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in apply_quality_rules(documents).collect():
        counts = plain_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == counts
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r["kept"] and r["base_failed"])


def test_thresholds_follow_their_group(spark):
    """Long words are normal in one source and odd in the other."""
    rng = np.random.default_rng(9)

    def text(mean):
        return " ".join("x" * max(1, int(rng.normal(mean, 1))) + str(i) for i in range(60))

    rows = [(i, text(5), "en", "short") for i in range(150)] + [(i, text(14), "en", "long") for i in range(150, 300)]
    rows += [(900, text(14), "en", "short"), (901, text(5), "en", "long"), (902, text(5), "en", "rare"), (903, text(5), None, None)]
    found = {r["doc_id"]: r for r in apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i]["kept"] for i in range(300))
    assert found[900]["outside"] == found[901]["outside"] == ["word_length"]
    # A group of one document is judged by its language, or by the corpus.
    assert found[902]["kept"] and found[903]["kept"]


def test_quality_labels_are_met(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = apply_quality_rules(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.97
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.9


def test_plan_is_native(odd_docs):
    plan = apply_quality_rules(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("given", ["odd", "none", "all_fail"])
def test_odd_inputs(spark, odd_docs, no_docs, given):
    docs = {"odd": odd_docs, "none": no_docs, "all_fail": odd_docs.where("doc_id in (2, 5)")}[given]
    rows = apply_quality_rules(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert isinstance(r["kept"], bool) and r["base_failed"] is not None
        if r["n_words"] < 20:
            assert r["base_failed"] and not r["kept"]
    assert len(MEASURES) == 4
