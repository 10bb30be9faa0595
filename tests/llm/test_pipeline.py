import numpy as np
import pytest

import corpus_pipeline
from candlemill.llm.decontam import contamination
from candlemill.llm.minhash_dedup import near_duplicates
from candlemill.llm.packing import Encoder
from candlemill.llm.queries import tokenizer_path
from candlemill.llm.secrets import base_spans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = {}, spark.read.parquet(f"{DATA}/documents.parquet")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        docs.count()
        out[name] = docs
    return out


def test_columns_stay(stages):
    for name in ("quality", "near_dedup", "decontamination", "secrets"):
        assert stages[name].columns == stages["documents"].columns
        assert stages[name].count() > 0.5 * stages["documents"].count()


def test_each_stage_did_its_work(spark, stages):
    left = near_duplicates(stages["near_dedup"].select("doc_id", "text"), k=5)
    assert left.where("not kept").count() == 0
    before = near_duplicates(stages["quality"].select("doc_id", "text"), k=5)
    assert stages["near_dedup"].count() == before.where("kept").count()
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    leaks = contamination(stages["decontamination"], bench).selectExpr("explode(leaks) as x").count()
    assert leaks == 0
    assert not any(base_spans(r["text"]) for r in stages["secrets"].collect())
    same = {r["doc_id"]: r["text"] for r in stages["decontamination"].collect()}
    assert all(r["text"] == same[r["doc_id"]] for r in stages["secrets"].collect() if "[SECRET]" not in r["text"])


def test_packing_holds_every_token(stages):
    tok, got = Encoder(tokenizer_path()).tok, {}
    for r in stages["packing"].collect():
        got.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(bytes(r["ids"]), dtype="<u2").tolist()))
    for r in stages["secrets"].collect():
        ids = [x for _, part in sorted(got[r["doc_id"]]) for x in part]
        assert ids == tok.encode(r["text"], add_special_tokens=False).ids + [2]


def test_stage_edges(spark, make_docs, words, edge_rows):
    rows = [(100 + i, words(30, i)) for i in range(20)]
    docs = make_docs(rows + edge_rows)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == make_docs(rows).columns
    assert {r["doc_id"] for r in docs.collect()} >= {100 + i for i in range(20)}
    assert corpus_pipeline.STAGES[4][1](spark, docs, DATA).count() >= 20
    empty = make_docs(rows).limit(0)
    assert all(stage(spark, empty, DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)
