import random
import re
from collections import Counter

import pytest

from candlemill.llm.collocations import collocations, frequent_phrases


def counted(rows, longest):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, longest=4, support=30, absorb=80, top=2000):
    f, n = counted(rows, longest)
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= support:
            cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            found[lang, w] = (a, min(cuts))
    out = {}
    for lang in {x for x, _ in found}:
        left = []
        for (x, w), (a, (score, _, l, r)) in found.items():
            inside = (b for (y, v), (b, _) in found.items() if y == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))))
            if x == lang and all(100 * b < absorb * a for b in inside):
                left.append((-score, -a, " ".join(w).encode(), a, l, r, score))
        for rank, (_, _, phrase, a, l, r, score) in enumerate(sorted(left)[:top], 1):
            out[lang, rank] = (phrase.decode(), a, l, r, n[lang], score)
    return out


def sentences(seed, count):
    rng = random.Random(seed)
    fixed = ["new york stock exchange", "as soon as possible", "in the", "of the", "Straße ÉCOLE", "a a", "big red"]
    rows = []
    for k in range(count):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(["the", "a", "x%d" % rng.randrange(40), "In", "of", "York"]) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "]) for p in parts)
        rows.append((k, text, rng.choice(["en", "en", "de", None, "und"])))
    return rows


def result(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("buckets", [None, 1 << 16])
def test_matches_brute_force(make_docs, buckets):
    rows = sentences(1, 500)
    got = result(collocations(make_docs(rows), buckets=buckets))
    assert got == brute(rows) and len(got) > 40
    assert any(len(v[0].split()) == 4 for v in got.values())


def test_other_limits(make_docs):
    rows = sentences(2, 120)
    got = result(collocations(make_docs(rows), longest=3, support=4, absorb=60, top=7))
    assert got == brute(rows, 3, 4, 60, 7)


def test_full_buckets_lose_nothing(make_docs, monkeypatch):
    """Where every bucket and every filter bit is taken, all phrases are counted."""
    from candlemill.llm import collocations as module

    rows = sentences(3, 150)
    monkeypatch.setattr(module, "_has", lambda bits, grams: grams == grams)
    tables, totals = frequent_phrases(make_docs(rows), support=5)
    f, n = counted(rows, 4)
    assert {(r["lang"], r["phrase"]): r["n"] for t in tables for r in t.collect()} == {(x, " ".join(w)): a for (x, w), a in f.items() if a >= 5}
    assert {r["lang"]: r["n"] for r in totals.collect()} == {x: a for x, a in n.items() if a}


def test_edges(make_docs, edge_rows):
    got = collocations(make_docs(edge_rows)).collect()
    best = [(r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got]
    # the long text repeats one word: pairs and threes are absorbed by fours
    assert best == [("en", "wort wort wort wort", 29_997, 30_000, 29_998, best[0][5], 2_000_000 * 29_997 // 59_998)]
    assert collocations(make_docs(edge_rows).limit(0)).count() == 0
    assert collocations(make_docs([(1, "a, a. a"), (2, None)])).count() == 0


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from candlemill.llm.collocations import _number

    row = spark.range(1).select(F.lit(5 * 10**17).alias("a"), F.lit(6 * 10**17).alias("l"), F.lit(7 * 10**17).alias("r"))
    got = row.select(F.expr(f"2000000 * {_number('a')} div ({_number('l')} + {_number('r')})")).first()[0]
    assert got == 2_000_000 * 5 * 10**17 // (13 * 10**17)
