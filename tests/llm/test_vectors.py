import numpy as np
import pytest

from tessera.llm.ann import adaptive_scan, fit, nearest
from tessera.llm.topk import products, top_products


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i) if i is not None else None, None if v is None else [None if c is None else float(c) for c in v], "x", "x") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, query_id string, score string")


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 32))
    x = np.concatenate([centres[i % 40] + r.normal(size=32) * 0.6 for i in range(3_000)]).reshape(3_000, 32).astype("f4")
    x[50:90] = x[100]  # ties with a query, over its rank limit
    return x


def test_exact(spark, clustered):
    found = ranked(top_products(vectors(spark, clustered)))
    z = np.floor(clustered.astype(float) * 1024)
    for q in range(0, 3_000, 100):
        s = z @ z[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(3_000), -s))[:10]
        assert found[q] == [(i + 1, int(v), int(s[v])) for i, v in enumerate(order)]


def test_products_stay_exact():
    q, x = np.full((1, 4), 2.0**30 + 1), np.full((2, 4), 2.0**30 - 1)
    assert products(q, x).tolist() == [[4 * (2**60 - 1)] * 2]
    assert products(q * 2.0**4, x).tolist() == [[2**63 - 1] * 2] and products(-q * 2.0**4, x).tolist() == [[1 - 2**63] * 2]
    q, x = np.array([[3e41, 1, 0], [1, 2, 3]]), np.array([[1, 5, 0], [0, 7, 3e41], [0, 2, 1]])
    assert products(q, x).tolist() == [[2**63 - 1, 7, 2], [11, 2**63 - 1, 7]]


def test_huge_components(spark):
    """One vector that cannot be scored in 64 bits harms no other's scores."""
    found = ranked(top_products(vectors(spark, [[1, 2], [3e38, 0], [2, 2], [-3e38, 1]], [100, 1, 2, 3])))
    assert found == {100: [(1, 1, 2**63 - 1), (2, 2, 6 * 1024 * 1024), (3, 3, 1 - 2**63)]}


def test_many_blocks_and_shards(spark):
    """Results do not depend on how many queries and vectors meet at once."""
    x = np.random.default_rng(8).normal(size=(900, 8)).astype("f4")
    rows = vectors(spark, x)
    assert ranked(top_products(rows, query_rows=2, shard_bytes=4_096)) == ranked(top_products(rows))


def test_approximate(spark, clustered):
    found = ranked(nearest(vectors(spark, clustered)))
    x, hit, total = clustered.astype(float), 0, 0
    for q in range(0, 3_000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        order = np.lexsort((np.arange(3_000), d))[:10]
        got = found[q]
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in got)
        assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        hit, total = hit + len({v for _, v, _ in got} & set(order.tolist())), total + 10
    assert hit / total >= 0.95


def test_scan_equals_brute_force():
    r = np.random.default_rng(5)
    x = r.normal(size=(4_000, 48))
    turn, _ = np.linalg.qr(r.normal(size=(48, 48)))
    hits = 0
    for q in range(20):
        d, i = adaptive_scan(x[q], x[q] @ turn, x, x @ turn, np.arange(4_000), q, 10)
        true = np.sqrt(((x - x[q]) ** 2).sum(1))
        true[q] = np.inf
        hits += len(set(np.argsort(true)[:10]) & set(i.tolist()))
        assert np.allclose(true[i], d)
    assert hits >= 190


@pytest.mark.parametrize("search", [top_products, nearest])
def test_odd_rows(spark, search):
    nan, inf = float("nan"), float("inf")
    rows = [[1, 0], [0, 1], None, [1, None], [nan, 1], [inf, 0], [2, 0], [0.5, 0.5], []]
    ids = [0, 1, 2, 3, 4, 5, 6, 100, 7]
    found = ranked(search(vectors(spark, rows, ids)))
    assert set(found) == {0, 100} and sorted(v for _, v, _ in found[0]) == [1, 6, 100]
    assert ranked(search(vectors(spark, []))) == {}
    assert ranked(search(vectors(spark, [[1, 2]], [100]))) == {}
    assert ranked(search(vectors(spark, [[1, 2], [3, 4]], [1, None]))) == {}


def test_zero_vectors(spark):
    rows = [[0, 0], [1, 1], [2, 2]]
    assert {v for _, v, _ in ranked(top_products(vectors(spark, rows, [100, 1, 2])))[100]} == {1, 2}
    assert ranked(nearest(vectors(spark, rows, [100, 1, 2]))) == {}
    assert [v for _, v, _ in ranked(nearest(vectors(spark, [[1, 1], [0, 0], [2, 2]], [100, 1, 2])))[100]] == [2]


def test_repeated_rows(spark):
    rows, ids = [[1, 0], [1, 0], [0, 1], [0, 1], [0, 1]], [100, 100, 7, 7, 3]
    for search in (top_products, nearest):
        assert [v for _, v, _ in ranked(search(vectors(spark, rows, ids)))[100]] == [3, 7, 7]


def test_probes_reach_the_recall():
    x = np.random.default_rng(1).normal(size=(2_000, 16))
    index = fit(x, 2_000, 10)
    assert 1 <= index.probes <= len(index.centroids)
