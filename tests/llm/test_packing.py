import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from placewise.llm.byte_bpe import read_ranks
from placewise.llm.packing import CapacityTree, Tokenizer, best_fit_decreasing, digest_packed, pack_tokens, write_packed
from placewise.session import scratch_path

from .conftest import ROWS

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain_packing(sizes, length):
    rooms, bins = [], []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= sizes[piece]]
        if fits:
            at = min(fits)[1]
            rooms[at] -= sizes[piece]
            bins[at].append(piece)
        else:
            rooms.append(length - sizes[piece])
            bins.append([piece])
    return bins


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 70).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(1, n), max_size=60))))
def test_tree_finds_the_best_fit(case):
    length, sizes = case
    assert best_fit_decreasing(sizes, length) == plain_packing(sizes, length)


def test_empty_tree_has_no_room():
    tree = CapacityTree(10)
    assert tree.take(1) is None
    tree.put(4, 0)
    assert tree.take(5) is None and tree.take(3) == (4, 0) and tree.take(1) is None


def unpacked(rows, length):
    pieces = defaultdict(list)
    for r in rows:
        ids, positions, ends = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_lengths"]
        assert len(ids) == length and ends[0] == 0 and ends[-1] == r["n_tokens"] and (ids[ends[-1] :] == 50256).all()
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces[r["doc_ids"][k]].append((r["starts"][k], ids[a:b].tolist()))
    return pieces


def test_nothing_is_lost(spark, documents):
    length = 256
    packed = write_packed(pack_tokens(documents, PATH, PATTERN, length=length), scratch_path(spark, "packed-test"))
    rows = packed.collect()
    assert len({r["sequence"] for r in rows}) == len(rows)
    pieces = unpacked(rows, length)
    tokenizer = Tokenizer(read_ranks(PATH), PATTERN)
    for r in documents.collect():
        tokens = tokenizer(r["text"]).tolist()
        parts = sorted(pieces.get(r["doc_id"], []))
        assert [t for _, p in parts for t in p] == tokens
        assert [s for s, _ in parts] == list(range(0, len(tokens), length))
    assert sum(r["n_tokens"] for r in rows) > 0.97 * length * len(rows)
    assert digest_packed(packed).count() == len(rows)


def test_groups_are_bounded(spark, documents, monkeypatch):
    import placewise.llm.packing as packing

    monkeypatch.setattr(packing, "GROUP_TOKENS", 3000)
    rng = random.Random(12)
    sizes = [rng.randint(1, 64) for _ in range(500)]
    assert sum(map(len, packing.best_fit_decreasing(sizes, 64))) == 500


def test_odd_inputs(spark, odd_docs, no_docs):
    rows = pack_tokens(odd_docs, PATH, PATTERN, length=128).collect()
    pieces = unpacked(rows, 128)
    assert set(pieces) == {1, 4, 5, 6, None}
    tokenizer = Tokenizer(read_ranks(PATH), PATTERN)
    assert sum(len(p) for _, p in pieces[4]) == 2 * len(tokenizer(ROWS[6][1]))
    assert pack_tokens(no_docs, PATH, PATTERN).count() == 0
