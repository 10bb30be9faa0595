import random

import numpy as np
import pytest

from candlemill.llm.graph import components
from candlemill.llm.minhash_dedup import exact_links, near_duplicates


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force(make_docs, words, k):
    rng, rows = random.Random(k), []
    for group in range(25):
        base = words(80, group).split()
        for _ in range(rng.randint(1, 5) if group else 320):  # one group of more than one block
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = words(1, rng.random())
            rows.append((len(rows) * 2, " ".join(own)))
    rows += [(1, None), (3, ""), (5, " \t"), (7, "Two words"), (9, "two WORDS"), (11, "two words more")]
    got = {r["doc_id"]: r for r in near_duplicates(make_docs(rows), k=k).collect()}
    for i, (n, component) in brute(rows, k, 80).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, component == i), i


def test_edges(make_docs, edge_rows):
    got = near_duplicates(make_docs(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert near_duplicates(make_docs(edge_rows).limit(0)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (3, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_exact_links():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    got = exact_links(sets, 50)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            a_, b_ = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (100 * len(a_ & b_) >= 50 * len(a_ | b_))


def test_one_id_with_several_texts_is_one_document(make_docs, words):
    a, b, c = (words(60, k) for k in range(3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, c), (4, None), (4, c + " z"), (9, c), (1, a)]
    for order in (rows, rows[::-1]):
        got = near_duplicates(make_docs(order)).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (9, 4)} and len(got) == len(rows)


def test_very_many_copies(make_docs, words, monkeypatch):
    from candlemill.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "MANY", 5)
    rows = [(i, words(30, 0)) for i in range(10, 60)] + [(i, words(30, i)) for i in range(100, 130)] + [(5, words(30, 0) + " end")]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make_docs(rows)).collect()}
    assert got == {i: 5 if i < 100 else i for i, _ in rows}
