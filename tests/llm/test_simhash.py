import random

import numpy as np
import xxhash

from placewise.llm.components import connected_components
from placewise.llm.simhash import drop_near_duplicates, near_duplicates, tile_forest

from .conftest import ROWS


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for space in "\t\n\v\f\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints):
    """fingerprint -> set of linked fingerprints, by comparing all."""
    todo, out = set(fingerprints), {}
    while todo:
        group, front = set(), [todo.pop()]
        while front:
            f = front.pop()
            group.add(f)
            near = {g for g in todo if (f ^ g).bit_count() <= 4}
            todo -= near
            front += near
        out.update(dict.fromkeys(group, group))
    return out


def near_texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(150)] = rng.choice(words)
            rows.append((len(rows) + 100, " ".join(copy)))
    return rows


def test_components_agree_with_comparing_all(spark):
    rows = near_texts() + [(r[0], r[1]) for r in ROWS]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = {text: plain_fingerprint(text) for _, text in rows}
    groups = plain_components(set(prints.values()))
    want = []
    for doc, text in rows:
        ids = [d for d, t in rows if d is not None and prints[t] in groups[prints[text]]]
        want.append((doc, f"{prints[text]:016x}", min(ids, default=None)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)
    assert len({r["component_id"] for r in found}) < len(rows) - 10


def test_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(12)]))
    fps = fps[np.lexsort((fps, np.bitwise_count(fps)))]
    half = len(fps) // 2
    edges = [tile_forest(fps, None, 4)]
    split = [tile_forest(fps[:half], None, 4), tile_forest(fps[half:], None, 4), tile_forest(fps[:half], fps[half:], 4)]
    groups = plain_components({int(f) for f in fps})

    def closure(parts):
        parent = {int(f): int(f) for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for us, vs in parts:
            for u, v in zip(us.tolist(), vs.tolist(), strict=True):
                assert v in groups[u]
                parent[find(u)] = find(v)
        return {f: frozenset(g for g in parent if find(g) == find(f)) for f in parent}

    want = {f: frozenset(g) for f, g in groups.items()}
    assert closure(edges) == want == closure(split)
    assert sum(len(u) for u, _ in edges) == len(fps) - len(set(want.values()))


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, j) for j in range(500, 520)] + [(7001, 7002), (7002, 7003), (7003, 7001), (9, 9)]
    found = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(found[i] == 0 for i in range(41)) and all(found[j] == 500 for j in (1000, *range(500, 520)))
    assert {found[i] for i in (7001, 7002, 7003)} == {7001}


def test_dropping_keeps_one_of_each(spark, odd_docs, no_docs):
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    # The texts without words (2, 2, 3, null, 5) are one component; 4 is there twice; one row without an id has its own.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (False, 6), (True, 0)]
    assert drop_near_duplicates(no_docs).count() == 0 and near_duplicates(no_docs).count() == 0
    twins = spark.createDataFrame([(None, "same words in both of them"), (None, "same words in both of them")], "doc_id long, text string")
    assert drop_near_duplicates(twins).count() == 1
