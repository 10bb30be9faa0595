import numpy as np
import pytest

from candlemill.llm.embedding_dedup import MOST_TABLES, fit_itq, link_vectors, planted_agreement, recall_of, tables_needed

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, key string, copies string"


def brute(rows, cosine):
    usable = [(i, np.array(v, dtype=float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == 32 and None not in v]
    usable = [(i, v) for i, v in usable if np.isfinite(v).all() and np.linalg.norm(v) > 0]
    ids = [i for i, _ in usable]
    x = np.stack([v / np.linalg.norm(v) for _, v in usable])
    link = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return {i: (int(link[k].sum()), int(label[k])) for k, i in enumerate(ids)}
        label = new


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, i = [], 0
    for group in range(150):
        centre = rng.standard_normal(32)
        for _ in range(int(rng.integers(1, 6)) if group else 700):  # one very large group
            v = centre + 0.12 * rng.standard_normal(32)
            rows.append((i, [float(x) for x in v], 0, "a", "b", "c"))
            i += 1
    got = {r["vec_id"]: r for r in link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute([(r["vec_id"], r["embedding"]) for r in spark.createDataFrame(rows, SCHEMA).collect()], 0.95)
    found, links = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
    assert links > 10_000 and 0.9 * links <= found <= links
    assert all(got[k]["n_links"] <= n for k, (n, _) in want.items())
    assert np.mean([got[k]["component_id"] == c for k, (_, c) in want.items()]) >= 0.9


def test_edges(spark):
    v = [1.0] + [0.0] * 31
    odd = [(10, None), (11, [0.0] * 32), (12, [None, *v[1:]]), (13, [float("nan"), *v[1:]]), (14, [float("inf"), *v[1:]]), (15, [1.0, 2.0]), (None, v)]
    rows = [(1, v), (2, v), (2, v), (3, [2.0] + v[1:])] + odd
    df = spark.createDataFrame([(*r, 0, "a", "b", "c") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in link_vectors(df).collect()), key=str)
    linked = [r for r in got if r[0] in (1, 2, 3)]
    assert [r[1:3] for r in linked] == [(3, 1)] * 4 and [r[3] for r in linked] == [True, False, False, False]
    assert all(r[1] == 0 and r[2] == r[0] and r[3] for r in got if r[0] not in (1, 2, 3))
    assert link_vectors(df.limit(0)).count() == 0
    assert link_vectors(df.where("vec_id = 11")).first()["n_links"] == 0


def test_components_of_any_finite_size(spark):
    v = np.random.default_rng(2).standard_normal((2, 8))
    rows = [(i, [float(x) for x in v[i % 2] * s]) for i, s in enumerate([1.0, 1.0, 1e200, 1e200, 1e-200, 1e-200, 1e308 / 4, 5e-324 / 1e-300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (3, i % 2) for i in range(8)}


def test_codes_are_balanced():
    x = np.random.default_rng(1).standard_normal((500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = fit_itq(x, 3)
    assert q.bits == 128 and np.abs(q.codes(x).mean(axis=0) - 0.5).max() < 0.15


def cone(rng, n, mean, d=32):
    """Vectors whose cosines to each other are ``mean`` on average."""
    around = rng.standard_normal((n, d))
    around /= np.linalg.norm(around, axis=1, keepdims=True)
    axis = np.zeros(d)
    axis[0] = 1
    return np.sqrt(mean) * axis + np.sqrt(1 - mean) * around


@pytest.mark.parametrize("mean,key_bits", [(0.0, None), (0.5, None), (0.8, None), (0.9, None), (0.0, 17), (0.0, 20), (0.5, 17), (0.5, 20), (0.8, 17), (0.9, 20)])
def test_recall_wherever_vectors_lie(spark, mean, key_bits):
    """Pairs just above the cosine in narrow and wide cones, with the substrings of 1e6 and 1e7 rows too."""
    rng = np.random.default_rng(int(10 * mean))
    x = cone(rng, 1000, mean)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = cone(rng, 1000, mean) - x  # towards others like them
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * turn
    rows = [(i, v.tolist(), 0, "a", "b", "c") for i, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    both = np.array([r[1] for r in rows])
    want = (both @ both.T >= 0.95).sum() - len(both)
    got = link_vectors(df, key_bits=key_bits).agg({"n_links": "sum"}).first()[0]
    assert want >= 2000 and 0.98 * want <= got <= want


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.8, 0.9])
@pytest.mark.parametrize("key_bits", [10, 17, 20])
def test_tables_reach_their_share(mean, key_bits):
    unit = cone(np.random.default_rng(1), 2000, mean)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    agreement = planted_agreement(fit_itq(unit, 3), unit, 0.95, 4)
    bits, tables = tables_needed(agreement, key_bits)
    assert bits <= key_bits and tables <= MOST_TABLES and recall_of(agreement, bits, tables) >= 0.99


def test_vectors_of_one_id_stay_apart(spark):
    a, b = np.eye(8)[0], np.eye(8)[1]
    near = lambda v: (v + 0.01 * np.eye(8)[5]).tolist()
    rows = [(5, a.tolist()), (5, b.tolist()), (6, near(a)), (7, near(b)), (4, near(b))]
    for order in (rows, rows[::-1]):
        got = link_vectors(spark.createDataFrame(order, "vec_id long, embedding array<double>")).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(4, 2, 4), (5, 1, 5), (5, 2, 4), (6, 1, 5), (7, 2, 4)]
