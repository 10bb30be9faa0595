import hashlib
import random
import re
import string

import numpy as np

from candlemill.llm.secrets import battery, digest, redact, scan_secrets, thresholds

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18),
    ("hex", re.compile(r"[0-9a-f]+"), 16),
]


def brute(text):
    found = []
    for kind, (name, pattern, least) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if len(m[2] if name == "assign" else m[0]) >= least:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_match_brute_force(make_docs, words, edge_rows):
    rng = random.Random(1)
    bits = ["password=abcdefabcdef1234", 'API_KEY: "x.y-z_0123456789"', "token = short", "AKIA" + "A1" * 9, "AKIA12", "0123456789abcdef0", "deadbeef", "pAsSwD='ABCDEFGHIJKL'", "é" * 5]
    rows = [(100 + i, words(20, i) + " " + " ".join(rng.choice(bits) for _ in range(4)) + " " + words(9, -i)) for i in range(60)]
    rows += edge_rows
    got = digest(scan_secrets(make_docs(rows), ["doc_id"])).collect()
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            continue
        want = brute(text[r["doc_id"]])
        listed = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert all(x in r["spans"].split(",") for x in listed.split(",") if x)
    assert digest(scan_secrets(make_docs(rows).limit(0), ["doc_id"])).count() == 0


def test_battery_tells_random_from_words():
    rng = random.Random(2)
    chars = string.ascii_letters + string.digits + "+/"
    tokens = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(200)]
    plain = ["".join(rng.choice(["th", "er", "on", "an", "ing"]) for _ in range(16)) for _ in range(200)]
    assert np.median(battery(tokens, "base64")) > 0.05 and np.quantile(battery(tokens, "base64"), 0.05) > 1e-3
    assert np.median(battery(plain, "base64")) < 1e-6


def test_random_tokens_are_added_and_words_are_not(make_docs, words):
    rng = random.Random(3)
    chars = string.ascii_letters + string.digits + "+/"
    rows = [(i, words(30, i) + " " + "therandingontherandin" + "ther" * (i % 5)) for i in range(1200)]
    token = "".join(rng.choice(chars) for _ in range(40))
    rows.append((1000, f"{words(5, 1)} {token} {words(5, 2)}"))
    got = {r["doc_id"]: r["spans"] for r in digest(scan_secrets(make_docs(rows), ["doc_id"])).collect()}
    start = rows[-1][1].index(token)
    assert got[1000] == f"random:{start}:{start + 40}"
    assert not any(v for k, v in got.items() if k != 1000)


def test_few_keys_are_found_among_many_slugs(make_docs, words):
    rng = random.Random(8)
    chars = string.ascii_letters + string.digits + "+/"
    rows = [(i, words(20, i) + " " + "therandingontherandin" + "ther" * (i % 5)) for i in range(1500)]
    slug = lambda: "/".join("-".join(words(1, rng.random()) for _ in range(3)) for _ in range(2)) + f"-{rng.randint(1990, 2025)}"
    rows += [(2000 + i, words(8, i) + " " + slug() + " " + slug()) for i in range(500)]
    keys = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(5)]
    keys += ["".join(rng.choice(string.ascii_letters) for _ in range(48)) for _ in range(3)]
    rows += [(3000 + i, f"{words(5, i)} {k} {words(5, -i)}") for i, k in enumerate(keys)]
    got = {r["doc_id"]: r["spans"] for r in digest(scan_secrets(make_docs(rows), ["doc_id"])).collect()}
    assert sum("random" in got[3000 + i] for i in range(len(keys))) >= len(keys) - 1
    assert sum(bool(v) for k, v in got.items() if k < 3000) <= 2


def test_tokens_around_a_fixed_pattern_are_tested_and_redacted_whole(make_docs, words):
    rng = random.Random(4)
    rows = [(i, words(20, i) + " therandingontherandin" + "ther" * (i % 5)) for i in range(1200)]
    part = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    key = part(30) + "X" + "0123456789abcdef1" + "X" + part(30)
    docs = make_docs([*rows, (5000, f"a {key} b")])
    got = scan_secrets(docs, ["doc_id", "text"]).where("doc_id = 5000")
    assert {s["kind"] for s in got.first()["spans"]} == {2, 3}
    assert redact(got).first()["text"] == "a [SECRET] b"


def test_discovery_rate_needs_evidence():
    plain = [("base64", 3, 0, 10_000)]
    assert thresholds([("base64", 3, 119, 5), ("base64", 3, 0, 5)], plain, 0.01)[("base64", 3)] > 0
    assert ("base64", 3) not in thresholds([("base64", 3, 119, 5)], [("base64", 3, 0, 3)], 0.01)


def test_redaction(make_docs):
    docs = make_docs([(1, "a password=abcdefabcdef1234 b"), (2, None), (3, "clean")])
    out = {r["doc_id"]: r["text"] for r in redact(scan_secrets(docs, ["doc_id", "text"])).collect()}
    assert out == {1: "a [SECRET] b", 2: None, 3: "clean"}
