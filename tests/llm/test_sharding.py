import zlib

import numpy as np
import pytest

from candlemill.llm.sharding import feistel, shard_rows


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_permutes(total):
    assert sorted(feistel(np.arange(total), total, 17).tolist()) == list(range(total))


def test_shards_differ_by_one_row_and_slots_are_gapless(make_docs, words):
    rows = [(i * 3, words(5, i)) for i in range(333)]
    got = shard_rows(make_docs(rows), 7).collect()
    assert len(got) == 333 and {r["law"] for r in got} == {"rows"} and all(r["grown_shard"] is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(v) for v in by.values()]
    assert set(by) == set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = dict(rows)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))


def test_place_does_not_depend_on_partitions(make_docs, words):
    docs = make_docs([(i, words(3, i)) for i in range(200)])
    once = {(r["doc_id"], r["shard"], r["slot"]) for r in shard_rows(docs, 8).collect()}
    assert once == {(r["doc_id"], r["shard"], r["slot"]) for r in shard_rows(docs.repartition(7), 8).collect()}


def test_edges(make_docs, edge_rows):
    got = shard_rows(make_docs(edge_rows), 3).collect()
    assert len(got) == len(edge_rows)
    assert len({(r["shard"], r["slot"]) for r in got}) == len(edge_rows)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 1} == {(16, 0)}
    assert shard_rows(make_docs(edge_rows).limit(0), 3).count() == 0
