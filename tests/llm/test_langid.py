import zlib

import numpy as np

from candlemill.llm.langid import Alphabet, identify, landmarks_model


def test_held_out_accuracy(make_docs, words):
    rows = [(i, words(3 + i % 40, i, lang).capitalize() + "!", lang) for i in range(600) for lang in [("en", "es", "de")[i % 3]]]
    got = {r["doc_id"]: r for r in identify(make_docs(rows)).collect()}
    test = [(lang, got[i]) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 100 and all(r["held_out"] for _, r in test)
    assert np.mean([r["lang_pred"] == lang for lang, r in test]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_edges(make_docs, words, edge_rows):
    rows = [(100 + i, words(10, i, lang), lang) for i in range(60) for lang in [("en", "es")[i % 2]]]
    odd = [(i, t, None) for i, t in edge_rows] + [(8, "123 !?", "en"), (9, "中文", "en")]
    got = identify(make_docs(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    assert {r["lang_pred"] for r in got if r["doc_id"] not in (1, 2, 3, 8, None)} <= {"en", "es"}
    nothing = identify(make_docs([(i, t, None) for i, t in edge_rows])).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert identify(make_docs(rows).limit(0)).count() == 0


def test_spectrum_is_the_same_both_ways():
    a = Alphabet([ord(c) for c in "abcde"])
    short = "abc de  xyz 中é1" * 3
    long = short * 1000
    assert set(a.spectrum(short).tolist()) <= set(a.spectrum(long).tolist())
    assert len(a.spectrum(long)) == len(np.unique(a.spectrum(long)))


def test_kernel_is_shared_grams_over_all_grams(words):
    """Against sets of strings: letters beyond the landmarks' are one letter, all else a space."""
    marks = [words(12, i, lang) for i, lang in enumerate(["en", "es", "de", "en"])]
    texts = [words(20, 50, "es"), "Ab, cd! 123", "中文 and ñu", "x", "", "a" * 30_000 + " b"]
    known = {c for t in marks for c in t}

    def grams(text):
        plain = "".join((c if c in known else "?") if c.isalpha() else " " for c in text.lower())
        return {plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)}

    want = [[len(grams(t) & grams(m)) / (len(grams(t)) * len(grams(m))) ** 0.5 if t else 0.0 for m in marks] for t in texts]
    assert np.allclose(landmarks_model(marks, ["en"]).kernel(texts), want, atol=1e-6)


def test_many_languages(make_docs, words):
    rows = [(i, words(8, i), f"l{i % 600:04d}") for i in range(2400)]
    got = identify(make_docs(rows)).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {r[2] for r in rows}
    assert len({r["lang_pred"] for r in got}) > 100
