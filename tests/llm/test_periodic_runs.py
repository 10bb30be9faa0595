import hashlib
import random
import zlib

import numpy as np
import pytest

from candlemill.llm import periodic_runs
from candlemill.llm.periodic_runs import digest, find_runs, maximal_runs, plant_repeats, word_runs


def brute(w, least=6, repeats=4):
    """Every stretch, by definition."""
    found = {}
    for p in range(1, len(w) // repeats + 1):
        s = 0
        while s + p < len(w):
            if w[s] != w[s + p]:
                s += 1
                continue
            e = s + p
            while e < len(w) and w[e] == w[e - p]:
                e += 1
            if e - s >= max(least, repeats * p):
                found.setdefault((s, e - s), p)
            s = e - p + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def some_words(rng):
    n, own = rng.randint(0, 90), "abcdefgh"[: rng.choice([1, 2, 3, 8])]
    w = [rng.choice(own) for _ in range(n)]
    if rng.random() < 0.6 and n > 8:
        a, p = rng.randrange(n), rng.randint(1, 7)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least,repeats", [(6, 4), (3, 2), (9, 3)])
def test_matches_brute_force(make_docs, least, repeats):
    rng = random.Random(repeats)
    texts = [some_words(rng) for _ in range(300)]
    rows = find_runs(make_docs([(k, "  ".join(w)) for k, w in enumerate(texts)]), ["doc_id"], least, repeats).collect()
    assert sum(len(r["runs"]) for r in rows) > 100
    for r in rows:
        w = texts[r["doc_id"]]
        runs = [tuple(x) for x in r["runs"]]
        assert (r["n_words"], runs) == (len(w), brute(w, least, repeats))
        assert runs == word_runs([x.encode() for x in w], least, repeats)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_misleading_hashes_are_caught(make_docs, monkeypatch):
    """With one hash for all words, only the comparison of the words themselves tells texts apart."""
    monkeypatch.setattr(periodic_runs, "maximal_runs", lambda words, at, *a: maximal_runs(np.zeros_like(words), at, *a))
    text = "a b c a b c a b c a b c d e f g h"
    plan = find_runs(make_docs([(1, text), (2, "x x x x x x x")]), ["doc_id"])
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in plan.collect()} == {1: [(0, 12, 3)], 2: [(0, 7, 1)]}


def test_words_keep_their_case_and_bounds(make_docs):
    rows = [(1, "A a A a A a"), (2, "x\x0bx\tx\nx\rx\x0cx"), (3, "é é é é é é é é é é é é"), (4, "x x x x x"), (5, "x x x")]
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in find_runs(make_docs(rows), ["doc_id"]).collect()}
    assert got == {1: [], 2: [(0, 6, 1)], 3: [(0, 6, 1)], 4: [], 5: []}  # runs don't cross texts; 1 repeats its period three times only


def test_edges(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    got = digest(find_runs(docs, ["doc_id"])).collect()
    assert len(got) == len(edge_rows)
    nothing = hashlib.sha256(b"").hexdigest()
    by_id = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3):
        assert tuple(by_id[i])[1:] == (0, None, None, None, None, nothing, nothing)
    long = by_id[7]
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["exponent_milli"]) == (1, 0, 30_000, 1, 30_000_000)
    assert long["collapsed_sha256"] == hashlib.sha256(b"wort").hexdigest()
    assert long["runs_sha256"] == hashlib.sha256(b"0,30000,1\n").hexdigest()
    assert digest(find_runs(docs.limit(0), ["doc_id"])).count() == 0
    assert plant_repeats(docs).count() == len(edge_rows) and plant_repeats(docs.limit(0)).count() == 0


def test_ties_take_the_first_longest(make_docs):
    text = "a a a a a a q r b b b b b b"
    r = digest(find_runs(make_docs([(1, text)]), ["doc_id"])).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"]) == (2, 0, 6, 1)


def test_planting(make_docs, words):
    rows = [(i, words(5 + i % 60, i)) for i in range(200)]
    got = {r["doc_id"]: r["text"] for r in plant_repeats(make_docs(rows)).collect()}
    planted = 0
    for i, text in rows:
        h, w = zlib.crc32(str(i).encode()), text.split()
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        assert got[i].split() == w
    assert planted > 10
