import zlib

import numpy as np
import pyarrow as pa
import pytest

from candlemill.llm.packing import Encoder, cut_at_sequences, digest, pack, sequence_bounds, service
from candlemill.llm.queries import tokenizer_path


def test_bounds_of_the_last_sequences():
    assert sequence_bounds(4096 * 2 + 11) == (8192, [8192, 8200, 8202]) and sequence_bounds(4096) == (4096, [])


@pytest.mark.parametrize("weight", [[0.5, 0.3, 0.0], [1000.0, 5000.0, 70.0], [1.0, 1.0, 1.0]])
def test_service_is_that_of_a_round_robin_played_token_by_token(weight):
    totals = np.array([1000, 5000, 70])
    plan = service(totals, np.array(weight))
    queue = np.repeat(np.arange(3), totals)
    x = np.concatenate([np.arange(n) for n in totals])
    window = plan.window(queue, x, 128)
    counts = np.array([np.bincount(window[queue == q], minlength=window.max() + 1) for q in range(3)])
    assert (np.abs(counts.sum(axis=0)[:-1] - 128) <= 3).all()
    served, debt = np.zeros(3), np.zeros(3)  # rounds of small quanta, what is left over being carried
    share = np.where(np.array(weight) > 0, weight, 1e-12)
    for w in range(window.max()):
        left = 128.0
        while left > 1e-9:
            open_ = served < totals - 1e-9
            rate = np.where(open_, share, 0) / np.where(open_, share, 0).sum()
            step = min(left, ((totals - served)[rate > 0] / rate[rate > 0]).min())
            served, left = served + rate * step, left - step
        debt = served - counts[:, : w + 1].sum(axis=1)
        assert (np.abs(debt) <= 3).all()
    owner, start, end, _ = plan.cuts(np.arange(3), np.zeros(3, dtype=np.int64), totals, 128)
    for q in range(3):
        s, e = start[owner == q], end[owner == q]
        assert s[0] == 0 and e[-1] == totals[q] and (s[1:] == e[:-1]).all()


def test_cuts_at_sequences_match_a_loop():
    rng = np.random.default_rng(0)
    length = rng.integers(1, 60, 50)
    at, total = np.cumsum(length) - length, int(length.sum())
    owner, inside, n, seq, offset = cut_at_sequences(at, length, total, 32)
    tail, late = sequence_bounds(total, 32)
    where = [(g // 32, g % 32) if g < tail else (tail // 32 + max(i for i, x in enumerate(late) if x <= g), g - max(x for x in late if x <= g)) for g in range(total)]
    got = {}
    for o, i, k, s, f in zip(owner, inside, n, seq, offset):
        for j in range(k):
            got[int(at[o] + i + j)] = (int(s), int(f + j))
    assert got == dict(enumerate(where)) and n.sum() == total


def test_ids_of_the_encoder_are_whole_text_ids(words):
    encoder = Encoder(tokenizer_path())
    assert encoder.by_word
    texts = [words(30, 1), "It's  ÉTÉ, d'accord!\n\tx99", "<|endoftext|> a", "中文 a\x1cb\x85c", "", "é   ß'LL", " A× b÷c ", "a.b,c! (x) 12", "x" * 20_000, None, words(30, 1, "de")]
    for _ in range(2):  # the second time from what it remembers
        seen = {}
        for rows, ids, starts in encoder.encode(pa.array(texts)):
            seen |= {r: ids[s:e].tolist() for r, s, e in zip(rows.tolist(), starts, starts[1:])}
        for i, t in enumerate(texts):
            assert seen[i] == encoder.tok.encode(t or "", add_special_tokens=False).ids + [2]


def test_round_trip(spark, make_docs, words, edge_rows):
    rows = [(100 + i, words(40 + 13 * (i % 50), i), "en", f"s{i % 3}" if i % 7 else None) for i in range(150)]
    rows += [(r[0], r[1] if r[0] != 6 else "x" * 20_000) for r in edge_rows]
    got = digest(pack(make_docs(rows), tokenizer_path()), "ids").collect()
    tok = Encoder(tokenizer_path()).tok
    pieces, sequences = {}, {}
    for r in got:
        raw = np.frombuffer(bytes(r["ids"]), dtype="<u2").astype("<u4")
        assert len(raw) == r["length"] and zlib.crc32(raw.tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], raw.tolist(), r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text, *_ in rows:
        if i in (None, 4):
            continue
        own = sorted(pieces[i])
        ids = [x for _, part, _ in own for x in part]
        assert ids == tok.encode(text or "", add_special_tokens=False).ids + [2] and {n for *_, n in own} == {len(ids)}
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = []
    for k in sorted(sequences):
        at = 0
        for offset, n in sorted(sequences[k]):
            assert offset == at
            at += n
        sizes.append(at)
    full = [n for n in sizes if n == 4096]
    assert sizes[: len(full)] == full and all(n & (n - 1) == 0 for n in sizes)
    assert pack(make_docs(rows).limit(0), tokenizer_path()).count() == 0


def test_windows_have_the_target_proportions(make_docs, words):
    rows = [(i, words(60, i), "en", "big" if i % 4 else "small") for i in range(400)]
    got = digest(pack(make_docs(rows), tokenizer_path(), sequence=256, window_sequences=4)).collect()
    total = sum(r["length"] for r in got)
    share = sum(r["length"] for r in got if r["source"] == "small") / total
    windows = {}
    for r in got:
        windows.setdefault((r["sequence_id"] * 256 + r["offset"]) // 1024, []).append(r)
    for w, own in windows.items():
        if w < total // 1024 - 1:
            assert sum(r["length"] for r in own if r["source"] == "small") / 1024 == pytest.approx(share, abs=0.02)


def test_windows_follow_given_targets_until_queues_run_dry(make_docs, words):
    rows = [(i, words(60, i), "en", ("a", "b", "b", "c")[i % 4]) for i in range(400)]
    got = digest(pack(make_docs(rows), tokenizer_path(), targets={"a": 0.6, "b": 0.4}, sequence=256, window_sequences=4)).collect()
    total, windows = sum(r["length"] for r in got), {}
    for r in got:
        w = (r["sequence_id"] * 256 + r["offset"]) // 1024
        windows.setdefault(w, dict.fromkeys("abc", 0))[r["source"]] += r["length"]
    tokens = {s: sum(w[s] for w in windows.values()) for s in "abc"}
    both = int(tokens["a"] / 0.6 // 1024)  # a runs dry first, then b, then c follows
    for w, own in windows.items():
        if w < both:
            assert own["a"] / 1024 == pytest.approx(0.6, abs=0.02) and own["c"] == 0
        elif both < w < (tokens["a"] + tokens["b"]) // 1024:
            assert own["b"] >= 1023
        elif (tokens["a"] + tokens["b"]) // 1024 < w < total // 1024 - 1:
            assert own["c"] >= 1023


def test_more_sources_than_queues_share_the_last_one(monkeypatch, make_docs, words):
    from candlemill.llm import packing

    monkeypatch.setattr(packing, "MOST_SOURCES", 3)
    rows = [(i, words(20, i), "en", f"s{i % 9}") for i in range(90)]
    got = digest(pack(make_docs(rows), tokenizer_path(), sequence=256)).collect()
    assert {r["doc_id"] for r in got} == set(range(90)) and len({r["source"] for r in got}) == 9
    assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
