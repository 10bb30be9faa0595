import random

import numpy as np
import pytest

from candlemill.llm.decontam import common_words, contamination, passages_of, rare_words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], (prev + 1 if x == y else max(row[j], row[j + 1]))
    return row[-1]


def test_common_words_match_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 80))] for _ in range(2))
        assert common_words(a, b) == lcs(a, b)


def test_passages():
    assert passages_of(100) == [(0, 33), (33, 66), (66, 100)] and passages_of(0) == [(0, 0)]


def test_planted_items(spark, make_docs, words, edge_rows):
    items = [(i, words(20 + 3 * i, 1000 + i)) for i in range(12)] + [(50, None), (51, ""), (None, "null id item of some words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rng, rows, want = random.Random(5), [], set()
    for i in range(80):
        body = words(120, i).split()
        if i < 12:  # verbatim
            body[30:30] = items[i][1].split()
            want.add((100 + i, i))
        elif i < 24:  # every sixth word replaced
            own = [w if j % 6 else words(1, 7 * i + j) for j, w in enumerate(items[i - 12][1].split(), 1)]
            body[60:60] = own
            want.add((100 + i, i - 12))
        rows.append((100 + i, " ".join(body).capitalize() + "."))
    rows += [(200, items[3][1]), *edge_rows]
    want.add((200, 3))
    rng.shuffle(rows)
    found = contamination(make_docs(rows), bench)  # the column "leaks" there already is replaced
    assert found.columns.count("leaks") == 1
    got = {(r["doc_id"], x["item_id"]) for r in found.collect() for x in r["leaks"]}
    assert got == want
    assert contamination(make_docs(rows).limit(0), bench).count() == 0
    none = contamination(make_docs(rows[:5]), bench.limit(0))
    assert none.count() == 5 and all(not r["leaks"] for r in none.collect())


def zipf_words(rng, n, sizes=20_000):
    return [f"w{int(x)}" for x in np.minimum(sizes ** rng.random(n), sizes)]


@pytest.mark.parametrize("many", [40, 400, 2000, 5000])
def test_recall_against_brute_force_at_any_size_of_the_benchmark(spark, make_docs, many):
    """Verbatim copies and copies with every sixth word replaced, among common words; brute force checks what else is found."""
    rng = np.random.default_rng(many)
    items = [(i, zipf_words(rng, 48)) for i in range(many)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows, copies, changed = [], set(), set()
    for k in range(240):
        body, (i, own) = zipf_words(rng, 150), items[k * many // 240]
        if k % 3 == 1:
            own = [w if j % 6 else f"new{k}x{j}" for j, w in enumerate(own, 1)]
        if k % 3 < 2:
            body[k % 140 : k % 140] = own
            (changed if k % 3 else copies).add((k, i))
        rows.append((k, " ".join(body)))
    found = [(r["doc_id"], x) for r in contamination(make_docs(rows), bench).collect() for x in r["leaks"]]
    got = {(d, x["item_id"]) for d, x in found}
    assert len(got & copies) >= 0.99 * len(copies) and len(got & changed) >= 0.9 * len(changed)
    assert all(0 < x["cosine"] <= 1 for _, x in found)
    text, words = dict(rows), dict(items)
    assert all(lcs(words[i], text[d].split()) >= 0.5 * len(words[i]) for d, i in got)


def test_a_stretch_with_half_of_a_passage_is_always_looked_at(spark):
    rng = random.Random(3)
    for _ in range(300):
        m = rng.randint(3, 48)
        rows, weight = np.array([rng.randrange(30) for _ in range(m)]), np.random.default_rng(m).random(30)
        rare, times, least = rare_words(rows, weight)
        kept = {rows[i] for i in rng.sample(range(m), -(-m // 2))}
        assert sum(n for r, n in zip(rare, times) if r in kept) >= least


def test_one_passage_of_a_long_item_is_a_leak(spark, make_docs):
    rng = np.random.default_rng(9)
    long = zipf_words(rng, 400)
    bench = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    rows = [(1, " ".join(zipf_words(rng, 50) + long[80:180] + zipf_words(rng, 50))), (2, " ".join(zipf_words(rng, 90) + long[:20]))]
    got = {r["doc_id"]: r["leaks"] for r in contamination(make_docs(rows), bench).collect()}
    assert got[1][0]["passage"] >= 0.9 and got[1][0]["common"] < 0.5 and not got[2]


def test_items_with_a_filler_after_each_word_are_found(spark, make_docs):
    """Common subsequence 1.0 over twice the words: fillers from the benchmark's own words, and words of no item; brute force on what else is found."""
    rng = np.random.default_rng(31)
    items = [(i, zipf_words(rng, int(rng.integers(20, 120)))) for i in range(400)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    rows, want = [], set()
    for k in range(120):
        i, own = items[3 * k]
        fill = zipf_words(rng, len(own)) if k % 2 else [f"filler{k}x{j}" for j in range(len(own))]
        body = zipf_words(rng, 200)
        if k % 3:
            body[k : k] = [w for pair in zip(own, fill) for w in pair]
            want.add((k, i))
        rows.append((k, " ".join(body)))
    found = [(r["doc_id"], x) for r in contamination(make_docs(rows), bench).collect() for x in r["leaks"]]
    got, text, words = {(d, x["item_id"]) for d, x in found}, dict(rows), dict(items)
    assert len(got & want) >= 0.95 * len(want)
    for d, x in found:
        stretch = text[d].split()[x["first_word"] : x["first_word"] + x["n_words"]]
        share = lcs(words[x["item_id"]], stretch) / len(words[x["item_id"]])
        assert share >= 0.5
    assert not {d for d, _ in got} - {d for d, _ in want}


def test_blocks_find_what_one_search_finds(spark, make_docs, words, monkeypatch):
    bench = spark.createDataFrame([(i, words(30 + i, 50 + i)) for i in range(30)], "item_id long, text string")
    docs = make_docs([(i, words(40, 900 + i) + " " + words(30 + i, 50 + i)) for i in range(0, 30, 2)] + [(99, None)])
    found = lambda: sorted((r["doc_id"], x["item_id"], x["common"]) for r in contamination(docs, bench).collect() for x in r["leaks"])
    whole = found()
    monkeypatch.setattr("candlemill.llm.decontam.BLOCK_PASSAGES", 5)
    assert found() == whole and {(i, i) for i in range(0, 30, 2)} <= {(d, x) for d, x, _ in whole}
