import random
import re

from candlemill.llm.licenses import NAMES, PHRASES, TEMPLATES, digest, scan_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text):
    w = WORD.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(make_docs, words, edge_rows):
    rng = random.Random(4)
    bits = ["MIT License", "cc-by", "cc by", "Apache\nLicense", "the GNU General Public License", "gnu general", "CC BYE", "É License"]
    rows = [(100 + i, words(10, i) + " " + " ".join(rng.choice(bits) for _ in range(3)) + words(5, i)) for i in range(50)] + edge_rows
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    got = digest(scan_licenses(make_docs(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert tuple(r)[1:6] == brute(text[r["doc_id"]])
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert scan_licenses(make_docs(rows).limit(0)).count() == 0


def test_notices_with_gaps(make_docs, words):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    gap = bsd.replace("binary forms", "binary kinds of forms")
    rows = [(1, f"{words(30, 1)} {bsd} {words(9, 2)}"), (2, f"{words(7, 1)} {gap}"), (3, "redistribution and use in source " + words(30, 3)), (4, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in digest(scan_licenses(make_docs(rows + rows[:1]))).collect()}
    assert got[1]["labels"] == "bsd" and got[1]["score"] == 1.0
    assert got[2]["labels"] == "bsd" and 0.7 <= got[2]["score"] <= 1
    assert got[3]["labels"] == "" and got[3]["score"] < 0.7
    assert got[4]["labels"] == "cc-by,cc-by-nc" and got[4]["base_labels"] == "cc-by"


def test_each_notice_has_its_own_label_and_no_other(make_docs, words):
    rows = [(i, text) for i, (_, text) in enumerate(TEMPLATES)]
    rows += [(100 + i, f"{words(40, i)} {text} {words(40, -i)}") for i, (_, text) in enumerate(TEMPLATES)]
    got = {r["doc_id"]: r for r in digest(scan_licenses(make_docs(rows))).collect()}
    for i, (label, _) in enumerate(TEMPLATES):
        for r in (got[i], got[100 + i]):
            assert set(r["labels"].split(",")) == {label, *r["base_labels"].split(",")} - {""}, (label, r)


def test_notices_side_by_side_keep_their_labels(make_docs):
    known = {label: text for label, text in TEMPLATES}
    rows = [(1, f"{known['cc-by-sa']} {known['cc0']}"), (2, f"{known['lgpl']} {known['agpl']}"), (3, known["lgpl"].replace("GNU", "the GNU"))]
    got = {r["doc_id"]: r["labels"] for r in digest(scan_licenses(make_docs(rows))).collect()}
    assert got == {1: "cc-by,cc-by-sa,cc0", 2: "agpl,lgpl", 3: "lgpl"}


NEAR_MISSES = (
    "this work is licensed under a very different agreement altogether 4.0 international license",
    "this work is licensed under a Creative Commons Attribution-NoDerivs-Something 4.0 International License",
    "this work is licensed under a Creative Commons Zero 4.0 International License",
    "this work is licensed under a Creative Commons Sampling Plus 4.0 International License",
    "this work is licensed under a Creative Commons 4.0 International License of no kind",
    "this work is licensed under the GNU Free Documentation License, version 3",
    "this work is licensed under the GNU Verbatim Copying License, version 3",
    "this work is licensed under the General Public Transport License, version 3",
    "this work is licensed under the European Union Public License, version 3",
    "licensed under the Educational Community License, Version 2.0",
    "licensed under the Artistic License, Version 2.0",
    "licensed under the Apache Software License, Version 1.1",
    "released under the BSL License",
    "released under the X11 License",
    "released under the house rules",
    "licensed under CC 4.0 by someone",
    "licensed under BY NC 4.0",
    "licensed under CC NC 4.0",
    "this library is free software; you can redistribute it and/or modify it under the terms of the Library Club Card as published by the "
    "Reading Foundation; either version 2.1 of the License, or (at your option) any later version",
    "this program is free software: you can redistribute it and/or modify it under the terms of the Sleepycat Berkeley House Licence as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "permission is hereby granted, free of charge, to any person obtaining a copy of the font software, to use, study, copy, merge, embed, modify, "
    "redistribute, and sell modified and unmodified copies of the font software, subject to the following conditions:",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this book to lend it without restriction",
    "redistribution and use in any other form, with or without modification, are permitted provided that the following conditions are met:",
    "use in source and binary forms, with or without modification, are forbidden provided that the following conditions are met:",
    "permission to use, copy, modify, and distribute this database for any purpose with a fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies",
    "this source code form is subject to the terms of the Eclipse Public License, v. 2.0. If a copy of the EPL was not distributed with this file, "
    "You can obtain one at https://example.org/EPL/2.0/",
    "this is free and encumbered software never released. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "to the extent possible under law, the author has kept all copyright and related rights to this work",
    "the terms of the license are those of the general public, either version 3 of the license or any later version",
    "this work is licensed to the printer under a contract of 4.0 pages",
    "creative commons attribution share alike non commercial no derivatives license",
)


def test_near_misses_get_no_label(make_docs):
    got = digest(scan_licenses(make_docs(list(enumerate(NEAR_MISSES))))).collect()
    for r in got:
        assert r["labels"] == r["base_labels"] == "" and r["score"] < 0.7, (NEAR_MISSES[r["doc_id"]], r)


def brute_spans(text):
    """Votes, merging, cover, names and the best of overlapping spans, by words and loops."""
    w = WORD.findall(text.translate(LOWER))
    spans = []
    for t, (label, notice) in enumerate(TEMPLATES):
        q = WORD.findall(notice.translate(LOWER))
        needed = []
        for of, name in NAMES:
            n = WORD.findall(name.translate(LOWER))
            needed += [set(range(i, i + len(n))) for i in range(len(q)) if of == label and q[i : i + len(n)] == n]
        votes = {}
        for i in range(len(w) - 3):
            for at in range(len(q) - 3):
                if w[i : i + 4] == q[at : at + 4]:
                    votes.setdefault(i - at, set()).add(at)
        islands = []
        for d in sorted(votes):
            if not islands or d - islands[-1][-1] > 3:
                islands.append([])
            islands[-1].append(d)
        for island in islands:
            under = {d: {a + j for a in votes[d] for j in range(4)} for d in island}
            covered = len(set().union(*under.values()))
            first, last = min(d + min(votes[d]) for d in island), max(d + max(votes[d]) for d in island) + 3
            named = not needed or any(n <= under[d] for n in needed for d in island)
            if named and covered / len(q) >= 0.7 and last - first + 1 <= 1.5 * len(q):
                spans.append((2 * covered / (len(q) + last - first + 1), len(q), -t, -first, last, label))

    def beaten(x):
        return any(-y[3] <= x[4] and -x[3] <= y[4] and y[:4] > x[:4] for y in spans)

    return sorted((-x[3], x[4], x[5]) for x in spans if not beaten(x))


def test_spans_match_brute_force(make_docs, words):
    rng = random.Random(11)
    rows = []
    for i in range(200):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.choice((0, 0, 1, 3))):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = rng.choice(([], ["other"], ["NonCommercial"], ["the", "GNU"]))
                w = w or ["license"]
            parts += [" ".join(w), words(rng.choice((0, 2, 6)), i) if rng.random() < 0.6 else ""]
        rows.append((i, " ".join(parts)))
    got = {r["doc_id"]: sorted(map(tuple, r["spans"] or [])) for r in scan_licenses(make_docs(rows)).collect()}
    want = {i: brute_spans(text) for i, text in rows}
    assert sum(map(len, want.values())) > 150
    assert got == want
