import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from placewise.llm.byte_bpe import LONG_WORD, ByteBpe, decode_ids, encode_texts, read_ranks, round_trip

from .conftest import ROWS

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(read_ranks(PATH), PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    letters = "aàb'sß² \n\t\x1c\x85\xa0éЖ一٣Ⅷ!?.́😀_0x"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    return ["", "it's  a\n\n test  ", "<|endoftext|>", "a" * 3000, "ab" * LONG_WORD + " " * 300, *made, *(r[1] or "" for r in ROWS)]


def test_ids_are_those_of_the_library(bpe, library):
    for text, ids in zip(texts(), bpe.encode(texts()), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)


def test_heap_and_recursion_agree(bpe):
    rng = random.Random(8)
    for _ in range(200):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 60)))
        bpe.memo.clear()
        bpe._contract([(word, word.encode())])
        assert list(memoryview(bpe.memo[word]).cast("i")) == bpe.contract_long(word.encode())


@pytest.mark.parametrize("kind", ["letters", "thai"])
def test_many_long_words_stay_within_memory(bpe, library, kind):
    """Distinct unbroken words in one text: 100 to 240 letters, or 30 to 80 characters of three bytes."""
    rng = random.Random(9)
    words = set()
    while len(words) < 20_000:
        if kind == "thai":
            words.add("".join(chr(0x0E01 + rng.randrange(46)) for _ in range(rng.randint(30, 80))))
        else:
            words.add("".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(100, 240))))
    # One piece in five of the letters, which are the slower ones.
    text = " ".join(sorted(words)[:: 1 if kind == "thai" else 5])
    (ids,) = bpe.encode([text])
    assert ids.tolist() == library.encode_ordinary(text)
    assert bpe.decode([ids]) == [text.encode()]


def test_decoding_in_segments(bpe, monkeypatch):
    monkeypatch.setattr("placewise.llm.byte_bpe.SEGMENT", 7)
    monkeypatch.setattr("placewise.llm.byte_bpe.IDS_AT_ONCE", 20)
    ids = bpe.encode(texts()[:400])
    assert bpe.decode(ids) == [t.encode() for t in texts()[:400]]


def test_round_trip_over_spark(spark, odd_docs, no_docs, library):
    rows = round_trip(odd_docs, PATH, PATTERN, keep_ids=True).collect()
    assert len(rows) == len(ROWS) and all(r["restored"] for r in rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = []
    for doc, text, *_ in ROWS:
        ids = library.encode_ordinary(text or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        want.append((doc, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True, ids))
    assert sorted((tuple(r) for r in rows), key=key) == sorted(want, key=key)
    assert round_trip(no_docs, PATH, PATTERN).count() == 0
    encoded = encode_texts(odd_docs, PATH, PATTERN)
    decoded = [bytes(r["decoded"]).decode() for r in decode_ids(encoded, PATH, PATTERN).collect()]
    assert sorted(decoded) == sorted(r[1] or "" for r in ROWS)


def test_large_rank_files_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr("placewise.llm.byte_bpe.MOST_BYTES", 10)
    (tmp_path / "ranks").write_bytes(b"x" * 11)
    with pytest.raises(ValueError):
        read_ranks(str(tmp_path / "ranks"))
