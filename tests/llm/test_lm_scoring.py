import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from candlemill.llm import lm_scoring as lm
from candlemill.llm.lm_scoring import score_texts


def tokens(text):
    return [*(text or "").encode().lower().split(), None]  # None: the end


def base(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c = Counter(x for i, t in rows if not held[i] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        own = tokens(t)
        out.append((i, held[i], len(own), sum(c[x] > 0 for x in own), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)))
    return out


def assert_same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted((tuple(r)[:6] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("head", [lm.HEAD, 5])
def test_base_matches_brute_force(make_docs, words, monkeypatch, head):
    """With a short head nearly all words meet their counts in the join, also ones that are only held out."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "CLASSES", 2)
    monkeypatch.setattr(lm, "CLASS_WORDS", 4)
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "The", "a", f"w{rng.randrange(60)}", f"h{k}"]) for _ in range(rng.randrange(40)))) for k in range(150)]
    rows += [(None, "no id"), (5, rows[5][1]), (5, "another text of it"), (900, None), (901, "")]
    assert_same(score_texts(make_docs(rows)).collect(), base(rows))


def test_edges(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    got = score_texts(docs).collect()
    assert_same(got, base(edge_rows))
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert score_texts(docs.limit(0)).count() == 0


def test_nothing_to_learn_from(make_docs):
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, "some words") for i in ids]
    got = score_texts(make_docs(rows)).collect()
    assert_same(got, base(rows))
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in got)


def weights(seed=0, units=5):
    w = lm.first_weights(np.arange(1, 300)[::-1].astype(float), seed, units)
    rng = np.random.default_rng(seed)
    return {k: (v + rng.normal(0, 0.2, v.shape) * (v > -50)).astype(np.float32) for k, v in w.items()}


def plain(w, ids):
    """One text, one step after the other, over the whole vocabulary."""
    half = lambda x: 0.5 + 0.5 * x / (1 + np.abs(x))
    u = w["inner"].shape[0]
    h, last, total = np.zeros(u), lm.END, 0.0
    for i in ids:
        x = w["input"][last].astype(float)
        g = half(x[: 2 * u] + h @ w["gates"])
        c = x[2 * u :] + (g[u:] * h) @ w["inner"]
        c = c / (1 + np.abs(c))
        h = c + g[:u] * (h - c)
        a = np.exp(np.clip(h @ w["class_w"] + w["class_b"], -lm.BOUND, lm.BOUND))
        k, at = divmod(int(i), lm.CLASS_WORDS)
        b = np.exp(np.clip(h @ w["word_w"][k] + w["word_b"][k], -lm.BOUND, lm.BOUND))
        total += math.log(a[k] / a.sum()) + math.log(b[at] / b.sum())
        last = i
    return total


@pytest.mark.parametrize("lanes", [1, 3, 64])
def test_scores_carry_the_state_through_whole_texts(lanes):
    w, rng = weights(), np.random.default_rng(3)
    texts = [np.append(rng.integers(2, 290, n), lm.END) for n in (0, 1, 31, 32, 33, 200, 5, 64, 700)]
    got = lm.log_probabilities(w, np.concatenate(texts).astype(np.uint16), np.array([len(t) for t in texts]), lanes)
    assert got == pytest.approx([plain(w, t) for t in texts], rel=1e-4)


def test_it_is_a_distribution():
    w = weights()
    state = np.random.default_rng(1).normal(0, 1, (1, 5)).astype(np.float32)
    every = np.arange(lm.CLASSES * lm.CLASS_WORDS)
    logs, _, _ = lm.predict(w, np.repeat(state, len(every), axis=0), every, False)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_gradients(monkeypatch):
    """Of everything that is learned, against differences."""
    w = {k: v.astype(np.float64) for k, v in weights().items()}
    rng = np.random.default_rng(2)
    empty = np.empty
    monkeypatch.setattr(lm.np, "empty", lambda shape, dtype=None: empty(shape, np.float64 if dtype is np.float32 else dtype))
    ids, targets, state = rng.integers(0, 60, (7, 3)), rng.integers(0, 290, 21), rng.normal(0, 0.5, (3, 5))
    ids[3, 1] = lm.END

    def loss():
        states, _ = lm.run_window(w, ids, state.copy())
        return -lm.predict(w, states.reshape(-1, 5), targets, False)[0].sum()

    states, seen = lm.run_window(w, ids, state.copy())
    _, d, grads = lm.predict(w, states.reshape(-1, 5), targets, True)
    own, rows = lm.back_window(w, seen, d.reshape(states.shape))
    grads |= own
    grads["input"] = np.zeros_like(w["input"])
    np.add.at(grads["input"], ids.ravel(), rows)
    for k, g in grads.items():
        flat, where = w[k].reshape(-1), np.flatnonzero(np.abs(g).ravel() > 1e-4)
        assert len(where)
        for at in rng.choice(where, 12):
            old = flat[at]
            flat[at] = old + 1e-6
            up = loss()
            flat[at] = old - 1e-6
            down = loss()
            flat[at] = old
            assert g.ravel()[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_learns_order_and_language(make_docs, words):
    """Texts of two languages, and words in a fixed order: the recurrent model beats the counts on texts it hasn't seen."""
    rng, rows = random.Random(4), []
    for k in range(900):
        own = [f"{'abc'[k % 3]}{j}" for j in range(12)]
        text = [w for _ in range(15) for w in own[:6]] if k % 2 else [rng.choice(own) for _ in range(90)]
        rows.append((k, " ".join(text)))
    got = score_texts(make_docs(rows), rounds=2).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.92 * sum(r["base_score"] for r in got)  # both negative


def test_few_lanes_are_scored_in_long_windows(monkeypatch):
    """A text of 20,000 ids by itself is three windows, not one for every 32 ids, and scores the same."""
    w, rng, calls = weights(), np.random.default_rng(6), []
    ids = np.append(rng.integers(2, 290, 19_999), lm.END).astype(np.uint16)
    run = lm.run_window
    monkeypatch.setattr(lm, "run_window", lambda *args: calls.append(1) or run(*args))
    got = lm.log_probabilities(w, ids, np.array([len(ids)]))
    assert len(calls) == 3 and got == pytest.approx([plain(w, ids)], rel=1e-4)
