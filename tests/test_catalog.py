import re

from __spark_entry__ import entry, oracle_sql, queries
from catalog.registry import all_queries

SF = "/root/testdata/sf0.001"

# Queries quick enough for every test run; tests/oracle.py runs all of them.
QUICK = (
    "user_profile", "nearest_poi_category", "covered_users", "friendship_cases", "pair_overlap_measures",
    "od_ranking_cases_within_borough", "origin_statistics", "sessions", "next_business_cases", "category_star_profile",
    "binary_metrics", "disagreement", "parse_ranking", "answered_requests", "edge_list_scan", "response_scan",
    "duration_texts_enriched", "closed_sessions", "streamed_sessions",
)


def test_every_twin_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 130


def test_inventory_is_covered():
    lines = [q.covers for q in all_queries().values()]
    covered = set(re.findall(r"\b[A-Z]{1,2}\d+[a-c]?\b", " ".join(lines)))
    wanted = {f"{p}{i}" for p, n in (("S", 15), ("P", 12), ("J", 15), ("A", 31), ("W", 12), ("T", 11), ("U", 5),
                                     ("F", 14), ("D", 11), ("V", 14), ("X", 9), ("C", 5), ("M", 19), ("ST", 2))
              for i in range(1, n + 1)} | {"X5b", "X5c"}
    assert not wanted - covered, sorted(wanted - covered)


def test_flagship_query(spark):
    row = entry(spark).first()
    assert 0 < row["acc_at_1"] <= row["acc_at_5"] <= 1 and row["n_queries"] > 0


def test_quick_queries_agree_with_their_twins(spark):
    from oracle import compare, connect

    con = connect(SF)
    for name in QUICK:
        ok, note = compare(queries()[name](spark, SF), con, oracle_sql()[name])
        assert ok, f"{name}: {note}"
