import random
from collections import Counter

import numpy as np

from placewise.llm.toxicity import BlockMaxIndex, drop_toxic, fit_toxicity, isotonic, score_toxicity, terms_of

from .conftest import ROWS


def corpus(spark, n=900):
    """Every sixth text holds two or more words of a hidden list."""
    rng = random.Random(13)
    plain, bad = [f"plain{i}" for i in range(400)], ["grobian", "schuft", "zanker"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if i % 6 == 0:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "e", "en"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_block_max_search_is_exact():
    rng = np.random.default_rng(14)
    vectors = []
    for _ in range(700):
        terms = rng.choice(40, rng.integers(1, 8), replace=False).tolist()
        weights = rng.integers(1, 4, len(terms)).astype(float)
        vectors.append(dict(zip(terms, (weights / np.linalg.norm(weights)).tolist(), strict=True)))
    index = BlockMaxIndex.build(vectors, 40)
    for query in vectors[:150]:
        scores = [(round(sum(w * v.get(t, 0.0) for t, w in query.items()), 9), e) for e, v in enumerate(vectors)]
        want = sorted(((s, e) for s, e in scores if s > 0), key=lambda x: (-x[0], x[1]))[:15]
        got = index.nearest(query, 15)
        assert [e for _, e in got] == [e for _, e in want]
        assert np.allclose([s for s, _ in got], [s for s, _ in want], atol=1e-8)


def test_held_out_accuracy_and_evidence(spark):
    docs, labels = corpus(spark)
    found = score_toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 150 and all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    toxic = next(r for r in held if r["toxic"] == 1 and r["predicted"] == 1)
    assert toxic["terms"] and toxic["example_ids"] and toxic["cosines"][0] > 0.5


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(spark, 400)
    model = fit_toxicity(docs, labels)
    turned = labels.selectExpr("doc_id", "if(pmod(crc32(cast(doc_id as string)), 4) = 2, 1 - toxic, toxic) as toxic")
    again = fit_toxicity(docs, turned)
    assert (model.terms, model.ids, model.toxic, model.curve) == (again.terms, again.ids, again.toxic, again.curve)


def test_isotonic_curve():
    curve = isotonic([(0.1, 0, 1.0), (0.2, 1, 1.0), (0.3, 0, 1.0), (0.9, 1, 1.0), (0.9, 1, 1.0)], 0.5)
    values = [y for _, y in curve]
    assert values == sorted(values) and all(0 < y < 1 for y in values)
    assert isotonic([(0.4, 0, 3.0), (0.4, 1, 1.0)], 0.5) == [(0.4, 0.3)]
    assert terms_of("word") == ["word"] and terms_of("wordings") == ["wordings", "word*", "wordi*", "wordin*"]
    assert Counter(terms_of("x" * 50)[0])["x"] == 32


def test_odd_inputs(spark, odd_docs, no_docs):
    docs, labels = corpus(spark, 300)
    model = fit_toxicity(docs, labels)
    rows = score_toxicity(odd_docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] < 0.3 for r in rows)
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    assert score_toxicity(no_docs, model).count() == 0
    kept = drop_toxic(odd_docs, model)
    assert kept.schema == odd_docs.schema and kept.count() == len(ROWS)
    dropped = drop_toxic(docs, model).join(labels, "doc_id").groupBy("toxic").count().collect()
    assert {r["toxic"]: r["count"] for r in dropped}.get(0) == 250
    for few in (labels.limit(0), labels.where("toxic = 0"), spark.createDataFrame([(None, None), (1, None)], "doc_id long, toxic int")):
        assert {r["score"] for r in score_toxicity(odd_docs, fit_toxicity(odd_docs, few)).collect()} == {0.0}
    fit_toxicity(no_docs, labels)
