from pyspark.sql import functions as F

from placewise.llm.common import HELD_OUT, fold
from placewise.llm.cotraining import META_SIZE, TEXT_SIZE, fit_quality, meta_features, score_quality, text_features

from .conftest import ROWS, SF


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels, rounds=1)
    held = score_quality(docs, model).join(labels, "doc_id").where(fold(F.col("doc_id")) == HELD_OUT).collect()
    assert len(held) > 60
    assert sum(r["kept"] == bool(r["quality"]) for r in held) / len(held) > 0.93
    assert all(0 <= r[c] <= 1 for r in held for c in ("score", "text_score", "meta_score"))
    assert abs(model.weights[0]) > 0


def test_views_see_only_their_columns():
    assert len(text_features("")) == TEXT_SIZE and len(meta_features(None, None, None)) == META_SIZE
    assert meta_features(None, None, None)[:3].tolist() == [1, 1, 1]
    a, b = text_features("Some words, and some words."), text_features("### ||| $$$ %%% 123")
    assert a[0] > b[0] and a[4] < b[4]
    assert meta_features("en", "a", 10**12).sum() == 3


def test_odd_inputs(spark, odd_docs, no_docs):
    one = spark.createDataFrame([(1, 1), (3, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert {r["score"] for r in score_quality(odd_docs, fit_quality(odd_docs, one)).collect()} == {1.0}
    none = fit_quality(odd_docs, one.limit(0))
    assert {r["score"] for r in score_quality(odd_docs, none).collect()} == {0.0}
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels, rounds=1)
    rows = score_quality(odd_docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert score_quality(no_docs, model).count() == 0
    fit_quality(no_docs, labels)
