import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from placewise.llm.byte_bpe import ByteBpe, read_ranks
from placewise.llm.queries import ORACLE_SQL, QUERIES
from placewise.session import scratch_path

from .conftest import ROWS, SF
from .test_decontaminate import plain_leaks
from .test_simhash import plain_components, plain_fingerprint


def test_operators_and_the_pipeline_are_registered():
    names = queries()
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLE_SQL) <= set(oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]


def test_stages_against_brute_force(spark):
    """Every stage on what the one before kept, with planted rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    planted = [(10**6, f"Quite new words stand here before it. {item} And after.", "en", "src0", 1), (10**6 + 1, "Unlike all else: password = abcdef123456", "en", "src0", 1)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    seen = {"documents": docs}
    for name, function in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        function(spark, docs, SF).write.parquet(path)
        seen[name], docs = spark.read.parquet(path), spark.read.parquet(path)
        if name != "tokens":
            assert docs.columns == seen["documents"].columns
    rows = {n: {r["doc_id"]: r for r in d.collect()} for n, d in seen.items()}
    assert set(rows["toxicity"]) <= set(rows["documents"])
    texts = {i: r["text"] for i, r in rows["toxicity"].items()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    groups = plain_components(set(prints.values()))
    assert set(rows["near_duplicates"]) == {i for i in texts if i == min(j for j in texts if prints[j] in groups[prints[i]])}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaking = {d for d, _ in plain_leaks([(i, texts[i]) for i in rows["near_duplicates"]], items)}
    assert 10**6 in leaking
    assert set(rows["decontamination"]) == set(rows["near_duplicates"]) - leaking
    assert set(rows["secrets"]) == set(rows["tokens"]) == set(rows["decontamination"])
    assert rows["secrets"][10**6 + 1]["text"] == "Unlike all else: [secret]"
    bpe = ByteBpe(read_ranks(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")), corpus_pipeline.public_tokenizers.PATTERN)
    for i, r in rows["tokens"].items():
        assert r["restored"] and b"".join(bpe.decode([__import__("numpy").array(r["ids"])])).decode() == rows["secrets"][i]["text"]


def test_stages_survive_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, function in corpus_pipeline.STAGES:
            columns = docs.columns
            path = scratch_path(spark, f"odd-{name}")
            function(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            assert name == "tokens" or docs.columns == columns
    assert len(ROWS) == 10
