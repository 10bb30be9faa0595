import numpy as np
import pytest
from pyspark.sql import functions as F

from candlemill.llm.quality import Variances, judge, posteriors, variances
from candlemill.llm.queries import page_quality

LABELS = "doc_id long, quality int, toxic int"


def corpus(words, n=400):
    rows, marks = [], []
    for i in range(n):
        bad = i % 6 == 0
        body = words(60, i)
        if bad:
            body = " ".join(w + "!!" for w in body.upper().split()) if i % 12 else " ".join([body.split()[0]] * 60)
        rows.append((i, body, ("en", "de")[i % 2], f"s{i % 9}"))
        marks.append((i, int(not bad), 0))
    return rows, marks


def run(docs, labels):
    return judge(docs, labels, ["doc_id"], host=F.col("source"), path=F.col("lang")).collect()


def test_junk_goes_and_clean_documents_stay(spark, make_docs, words):
    rows, marks = corpus(words)
    known = spark.createDataFrame([m for m in marks if m[0] % 5], LABELS)
    got = {r["doc_id"]: r["quality_kept"] for r in run(make_docs(rows), known)}
    assert np.mean([got[i] == bool(q) for i, q, _ in marks]) > 0.98


def test_edges(spark, make_docs, words, edge_rows):
    rows, marks = corpus(words, 100)
    odd = spark.createDataFrame([*marks, (None, 0, 0), (3, None, 0), (5, 9, 0), (1, 1, 0)], LABELS)
    got = run(make_docs(rows + [(i, t, None, None) for i, t in [(1000 + (i or 0), t) for i, t in edge_rows]]), odd)
    assert len(got) == 100 + len(edge_rows)
    assert all(r["quality_score"] == 0 and not r["quality_kept"] for r in got if r["doc_id"] in (1001, 1002, 1003))
    none = run(make_docs(rows), odd.limit(0))
    assert all(r["quality_kept"] and r["quality_evidence"] == 0.5 for r in none)
    assert run(make_docs(rows).limit(0), odd) == []


SITES = "host string, path string, n long, s double, ss double"


def test_variances_and_posteriors_are_those_of_nested_random_effects(spark):
    """Estimates come near the truth they were drawn from; posteriors are held against plain loops."""
    rng = np.random.default_rng(6)
    rows, data = [], {}
    for h in range(60):
        top = 0.5 + 0.2 * rng.standard_normal()
        for p in range(int(rng.integers(1, 9))):
            x = top + 0.05 * rng.standard_normal() + 0.3 * rng.standard_normal(int(rng.integers(1, 200)))
            data[f"h{h}", f"p{p}"] = x
            rows.append((f"h{h}", f"p{p}", len(x), float(x.sum()), float((x * x).sum())))
    paths = spark.createDataFrame(rows, SITES)
    v = variances(paths)
    assert v.mean == pytest.approx(np.mean(np.concatenate(list(data.values())))) and v.document == pytest.approx(0.09, rel=0.1)
    assert v.path == pytest.approx(0.0025, rel=0.6) and v.host == pytest.approx(0.04, rel=0.5)
    for r in posteriors(paths, v).collect():
        own = {k: x for k, x in data.items() if k[0] == r["host"]}
        every = np.concatenate(list(own.values()))
        noise = v.document / len(every) + v.path * sum(len(x) ** 2 for x in own.values()) / len(every) ** 2
        host = (v.host * every.mean() + noise * v.mean) / (v.host + noise)
        x = data[r["host"], r["path"]]
        path = (v.path * x.mean() + v.document / len(x) * host) / (v.path + v.document / len(x))
        assert r["host_posterior"] == pytest.approx(host) and r["path_posterior"] == pytest.approx(path)


def test_hosts_that_differ_dont_make_paths_differ(spark):
    rows = [(f"h{h}", f"p{p}", 100, 100.0 * m, 100 * m * m + 9.0) for h, m in enumerate((0.1, 0.5, 0.9)) for p in range(3)]
    v = variances(spark.createDataFrame(rows, SITES))
    assert v.path < 1e-3 and v.host > 0.1
    assert variances(spark.createDataFrame([], SITES)) == Variances(0.5, 1.0, 0.0, 0.0)


def test_pages_are_judged_by_their_sites(spark, tmp_path, words):
    rows, marks = corpus(words, 300)
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    html = "<html><script>var x='</p>';</script><body><p>{}</p><!-- ad --></body></html>"
    pages = [(i, f"http://h{i % 3}.net/a{i % 2}/{i}", html.format(t)) for i, t, *_ in rows[:60]]
    pages += [(900, None, None), (901, "not a url [", "<p>"), (901, "not a url [", "<p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = page_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(pages) and all(r["score"] == 0 for r in got if r["page_id"] >= 900)
    quality = {i: q for i, q, _ in marks}
    assert np.mean([r["kept"] == bool(quality[r["page_id"]]) for r in got if r["page_id"] < 900]) > 0.95
