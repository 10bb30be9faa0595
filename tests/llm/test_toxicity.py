import math
import zlib

import numpy as np

from candlemill.llm.toxicity import LABEL_ODDS, label_model, score_toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(words, n=600):
    rows, marks = [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        body = words(40, i).split()
        if toxic:
            body[7:7] = ["idiot", f"lowei{words(1, i)}"] if i % 2 else [f"lowei{words(1, -i)}"]
        rows.append((i, " ".join(body)))
        marks.append((i, 1, toxic))
    return rows, marks


def test_held_out_accuracy(spark, make_docs, words, edge_rows):
    rows, marks = corpus(words)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(make_docs(rows), labels).collect()}
    test = [(m[2], got[m[0]]) for m in marks if held(m[0])]
    assert len(test) > 80 and all(r["held_out"] for _, r in test)
    assert np.mean([r["predicted"] == t for t, r in test]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    odd = score_toxicity(make_docs(rows[:200] + [(1000 + (i or 0), t) for i, t in edge_rows]), labels).collect()
    assert len(odd) == 200 + len(edge_rows) and all(r["score"] is not None for r in odd)


def test_held_out_labels_are_not_learned(spark, make_docs, words):
    rows, marks = corpus(words, 200)
    flipped = [(i, q, 1 - t if held(i) else t) for i, q, t in marks]
    a, b = (
        {r["doc_id"]: r["score"] for r in score_toxicity(make_docs(rows), spark.createDataFrame(m, "doc_id long, quality int, toxic int")).collect()}
        for m in (marks, flipped)
    )
    assert a == b


def test_without_labels(spark, make_docs, words):
    rows, marks = corpus(words, 20)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score_toxicity(make_docs(rows), empty).collect()
    assert len(got) == 20 and {r["score"] for r in got} == {0.0}
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 7)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score_toxicity(make_docs(rows), odd).collect()} == {0.0}
    assert score_toxicity(make_docs(rows).limit(0), empty).count() == 0


def test_label_model_discounts_copies():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.2).astype(int)
    good, weak = np.where(rng.random(2000) < 0.9, y, 0), (rng.random(2000) < 0.3).astype(int)
    votes = np.stack([good, weak, weak, weak], axis=1).astype(float)
    q, rates = label_model(votes, y)
    assert rates["weight"][1] < 0.5 < rates["weight"][0]
    assert ((q > 0.5) == y).mean() > 0.95


def test_label_model_is_the_one_written_out():
    """The same expectation maximisation, a row and a voter at a time."""
    rng = np.random.default_rng(3)
    y = (rng.random(60) < 0.3).astype(int)
    votes = np.stack([np.where(rng.random(60) < p, y, rng.random(60) < 0.2) for p in (0.9, 0.7, 0.7, 0.1)], axis=1).astype(float)
    votes[:, 2] = votes[:, 1]
    n, m = votes.shape
    q = [float(x) for x in y]
    for _ in range(5):
        pos = sum(q) + 1
        neg = n - sum(q) + 1
        on = [(sum(q[i] * votes[i][j] for i in range(n)) + 0.5) / (pos + 1) for j in range(m)]
        off = [(sum((1 - q[i]) * votes[i][j] for i in range(n)) + 0.5) / (neg + 1) for j in range(m)]
        rest = [[votes[i][j] - q[i] * on[j] - (1 - q[i]) * off[j] for j in range(m)] for i in range(n)]
        sd = [math.sqrt(sum(r[j] ** 2 for r in rest) / n) for j in range(m)]
        shared = [[sum(r[a] * r[b] for r in rest) / n / (sd[a] * sd[b]) for b in range(m)] for a in range(m)]
        weight = [1 / (1 + sum(max(shared[a][b], 0) for b in range(m) if b != a)) for a in range(m)]
        for i in range(n):
            odds = math.log(pos / neg) + (1 if y[i] else -1) * LABEL_ODDS
            for j in range(m):
                odds += weight[j] * (math.log(on[j] / off[j]) if votes[i][j] else math.log((1 - on[j]) / (1 - off[j])))
            q[i] = 1 / (1 + math.exp(-odds))
    got, rates = label_model(votes, y, steps=5)
    assert np.allclose(got, q, atol=1e-6) and np.allclose(rates["weight"], weight, atol=1e-6)
    assert np.allclose(rates["on"], on) and np.allclose(rates["off"], off)


def test_label_model_finds_rates_and_mends_labels():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.25
    on, off = np.array([0.9, 0.8, 0.7, 0.85, 0.3]), np.array([0.02, 0.05, 0.1, 0.03, 0.3])
    votes = (rng.random((4000, 5)) < np.where(truth[:, None], on, off)).astype(float)
    given = np.where(rng.random(4000) < 0.03, ~truth, truth).astype(int)
    q, rates = label_model(votes, given)
    assert np.abs(rates["on"] - on).max() < 0.05 and np.abs(rates["off"] - off).max() < 0.05
    assert ((q > 0.5) != truth).mean() < (given != truth).mean() / 3
