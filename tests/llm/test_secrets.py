import hashlib
import random
import re
import time

from placewise.llm.secrets import ENCODINGS, _long_runs, _scan, evidence, evidence_bin, infer_encoding, randomness_p, redact_secrets, scan_secrets, thresholds_of

from .conftest import ROWS

PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute(text):
    spans = []
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        spans += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return ",".join(s for _, _, s in sorted(spans))


def secret(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_base_spans_agree_with_a_plain_search(spark, documents):
    rng = random.Random(1)
    made = []
    for i in range(300):
        parts = [
            rng.choice(["ToKeN: ", "api_key=", "passwd = '", "secret:", "AKIA", "ſecret=", "x"]) + secret(rng, "abcdef0123456789AKIZ+/_é ", rng.randint(0, 40))
            for _ in range(rng.randint(0, 6))
        ]
        made.append((i + 10**6, " ".join(parts)))
    rows = made + [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    texts = dict(rows)
    for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (texts[r["doc_id"]], want, r["spans"])
        kinds = re.findall(r"([a-z]+):", want)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [kinds.count(k) for k in PATTERNS]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_random_strings_pass_and_words_fail():
    rng = random.Random(2)
    base62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    found = [randomness_p(s, infer_encoding(s)) for s in (secret(rng, base62, 40) for _ in range(400)) if infer_encoding(s)]
    assert 0.35 < sum(p > 0.5 for p in found) / len(found) < 0.65
    for text in ("aaaaaaaaaaaaaaaaA1", "abcdefghijklmnopqrstuvwxyz0123456789ABC", "Version1Version1Version1Version1"):
        assert randomness_p(text, infer_encoding(text)) < 0.05
    assert [infer_encoding(x) for x in ("0123", "12ab", "12AB", "word", "A2Z7", "a9z", "aB", "aB9", "a+/B", "a-B", "a+-", "é")] == [
        "digits", "hex", "hex_upper", "lower", "base32", "base36", "letters", "base62", "base64", "base64url", "any", None
    ]


ORDINARY = (
    "internationalization getElementsByClassName MAX_CONNECTION_TIMEOUT data-testid-login-button user_profile_picture_2023 "
    "org/example/project/module/src/main.py 20240131235959000000 123456789012345678901234567890 AbstractSingletonProxyFactoryBean "
    "4000-1234-5678-9010-1122 a/b/c/d/e/f/g/h/i/j/k utm_source/newsletter/2023-11/campaign Donaudampfschifffahrtsgesellschaft "
    "------------------------ AAAAAAAAAAAAAAAAAAAAAAAA abcdefghijklmnopqrstuvwxyz 0123456789abcdefABCDEF"
).split()


def test_ordinary_identifiers_are_no_secrets(spark):
    rows = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(ORDINARY, ORDINARY[::-1], strict=True))]
    found = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["spans"] for r in found if r["n_random"]] == []


def test_a_lone_key_is_found_in_a_table_of_three_rows(spark):
    """What is a secret does not depend on the size of the table."""
    rng = random.Random(11)
    for name in ("lower", "base32", "base36", "letters", "base62", "base64", "base64url", "any"):
        key = secret(rng, ENCODINGS[name], 32 if name not in ("lower", "base36") else 40)
        rows = [(1, "nothing here"), (2, f"the key {key} is new"), (3, None)]
        found = {r["doc_id"]: r["spans"] for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == {1: "", 2: f"random:8:{8 + len(key)}", 3: ""}, (name, key, found, evidence(key, name))


def test_ordinary_runs_seldom_give_evidence():
    """The p-value is one: runs drawn from the ordinary model reach b bits at most once in 2 ** b."""
    from placewise.llm.secrets import BEGINS, FOLLOWS, LETTERS

    rng = random.Random(12)
    letters = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    bins = []
    for _ in range(4000):
        row, run = BEGINS, ""
        for _ in range(rng.randint(16, 40)):
            (kind,) = rng.choices(list(row), list(row.values()))
            run += rng.choices(letters[kind], LETTERS)[0] if kind in letters else rng.choice("0123456789" if kind == "digit" else "+/-_")
            row = FOLLOWS[kind]
        bins.append(evidence_bin(run))
    for b in range(1, 8):
        assert sum(x >= b for x in bins) / len(bins) <= 2.0**-b + 0.01


def test_planted_keys_are_found_and_little_else(spark, documents):
    """One document in forty holds a key of one of five encodings, the others ordinary identifiers or nothing."""
    rng = random.Random(13)
    names = ["base32", "base36", "base62", "base64", "base64url"]
    rows, hidden = [], {}
    for r in documents.select("doc_id", "text").collect():
        text = r["text"]
        for copy in range(5):
            i = r["doc_id"] * 5 + copy
            word = rng.choice(ORDINARY)
            if i % 40 == 0:
                word = hidden[i] = secret(rng, ENCODINGS[rng.choice(names)], rng.randint(32, 48))
            rows.append((i, f"{text} {word} end"))
    found = {r["doc_id"]: r["spans"] for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    flagged = [(i, texts[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for i, spans in found.items() for s in spans.split(",") if s.startswith("random")]
    right = [x for x in flagged if hidden.get(x[0]) == x[1]]
    assert len(right) >= 0.95 * len(hidden) and len(right) >= 0.9 * len(flagged), (len(hidden), len(right), flagged[:5])


def test_product_codes_are_told_from_keys(spark):
    rng = random.Random(3)
    hidden = {i: secret(rng, ENCODINGS["base62"], 36) for i in range(0, 200, 2)}
    rows = [(i, f"see {hidden[i]} there" if i in hidden else f"part AAAAbbbb{i % 10}AAAAbbbbAAAAbbbb{i % 7}AAbb0000aaaa here") for i in range(200)]
    found = {r["doc_id"] for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_random"]}
    assert len(found & hidden.keys()) >= 95
    assert len(found - hidden.keys()) <= 0.1 * len(found)
    assert thresholds_of({}, 0.1) == {} and thresholds_of({(0, 0): 1000, (0, 12): 1}, 0.1) == {}
    assert thresholds_of({(3, 5): 1}, 0.1) == {3: 4} and thresholds_of({(0, 0): 1000, (0, 14): 1}, 0.1) == {0: 14}


def test_a_list_of_checksums_takes_linear_time():
    rng = random.Random(14)
    text = " ".join(secret(rng, "0123456789abcdef", 32) for _ in range(100_000))
    start = time.time()
    ((_, base, found),) = _scan([text])
    assert len(base) == 100_000 and found == [] and time.time() - start < 5


def test_runs_beside_fixed_spans_are_still_looked_at(spark):
    key = "q7Zk2LxVb9TmWc4RfY8sHd3NjPg6Ua1E"
    rows = [(1, f"password=abcdef {key}/{'0a' * 14}")]
    (row,) = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # The hexadecimal digits before a break belong to the fixed span, the rest of the run stays a candidate.
    assert row["n_assign"] == row["n_hex"] == row["n_random"] == 1


def test_long_runs_are_maximal():
    text = "é" * 3 + "A1b2" * 5 + "_- +/x" + "b" * 12
    assert _long_runs([text, "", "short"])[0] == ["A1b2" * 5 + "_-"]


def test_odd_inputs(spark, odd_docs, no_docs):
    rows = scan_secrets(odd_docs).collect()
    assert len(rows) == len(ROWS)
    assert [r["n_assign"] for r in rows if r["doc_id"] == 6] == [1]
    assert scan_secrets(no_docs).count() == 0 and redact_secrets(no_docs).columns == no_docs.columns
    redacted = redact_secrets(odd_docs)
    assert redacted.schema == odd_docs.schema
    by_id = {r["doc_id"]: r for r in redacted.collect()}
    assert "hunter2" not in by_id[6]["text"] and by_id[6]["n_chars"] == len(by_id[6]["text"])
    assert by_id[3]["text"] is None and by_id[1]["text"] == ROWS[0][1] and by_id[1]["fp"] == "clash"
