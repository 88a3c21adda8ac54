"""Whitening against numpy's eigenvectors, and its edge cases."""

import numpy as np
import pytest

from queryforge.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n bigint, x string"


def brute(rows, components=4):
    """vec_id -> (deviation, whitened) by numpy, and (n, shares)."""
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(np.int64)) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    project = [(i, int(((n * x - sums) ** 2).sum()), (x - sums / n) @ vectors / np.sqrt(values)) for i, x in kept]
    return project, n, values / np.trace(centred.T @ centred / n)


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(3)
    for side in (1, 2, 3, 9, 40):
        a = rng.standard_normal((side, side))
        a = a + a.T
        np.fill_diagonal(a, 0)  # pivots of two rows
        values = np.linalg.eigvalsh(a)
        for shift in (*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1):
            assert whitening.inertia(a, shift) == ((values > shift).sum(), (values < shift).sum())


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1], [3, 3 - 1e-9, 3 - 2e-9, 1], [1e-12, 1e-13], [7, 0, 0], [4, 2, 1, 0.5, 0.25, 0.1]])
def test_leading_components(values):
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found = whitening.leading(matrix, 4)
    wanted = [v for v in sorted(values, reverse=True)[:4] if v]
    assert np.allclose([e for e, _ in found], wanted, rtol=1e-12, atol=1e-15 * max(values))
    vectors = np.array([v for _, v in found])
    assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-12)
    for e, v in found:
        assert np.linalg.norm(matrix @ v - e * v) < 1e-14 * max(values) * len(values)


def test_leading_of_nothing():
    assert whitening.leading(np.zeros((3, 3)), 4) == [] and whitening.leading(np.zeros((0, 0)), 4) == []


def test_whiten_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(6) * [4, 3, 2, 1, .5, .1]]) for i in range(60)]
    copies = [(100 + i, good[0][1]) for i in range(50)] + [(3, good[3][1]), (None, good[4][1])]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, [])]
    rows = good + copies + bad + [(205, [1.0, 2.0])]  # another length
    df = spark.createDataFrame([(i, v, 1, 7, "x") for i, v in rows], SCHEMA).repartition(5)
    got = whitening.whiten(df).collect()
    wanted, n, shares = brute(good + copies)
    assert {r["n"] for r in got} == {n} == {60} and len(got) == 4 * len(wanted)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-12
    for c in range(4):
        key = lambda x: (x[0] is None, x[0] or 0, round(abs(x[2]), 6))
        own = sorted(((r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1), key=key)
        true = sorted(((i, d, w[c]) for i, d, w in wanted), key=key)
        assert [x[:2] for x in own] == [x[:2] for x in true]
        a, b = np.array([x[2] for x in own]), np.array([x[2] for x in true])
        assert np.allclose(a, b * np.sign(a @ b), atol=1e-9)
        assert all(abs(r["explained"] / shares[c] - 1) < 1e-9 for r in got if r["component"] == c + 1)


def test_few_vectors(spark):
    def ids(rows):
        return sorted((r["vec_id"], r["component"]) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect())

    assert ids([]) == [] and ids([(1, None)]) == [] and ids([(1, [1.0, 2.0])]) == [] and ids([(1, [1.0]), (2, [1.0])]) == []
    assert ids([(1, [1.0]), (2, [2.0])]) == [(1, 1), (2, 1)]
    assert ids([(1, [1.0, 0.0, 0.0]), (2, [2.0, 1.0, 0.0]), (3, [5.0, 1.0, 0.0])]) == [(i, c) for i in (1, 2, 3) for c in (1, 2)]


def test_entries_beyond_long(spark):
    rows = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.5, 4.0])], "vec_id bigint, embedding array<float>")
    got = whitening.whiten(rows).collect()
    assert {r["deviation"] for r in got if r["vec_id"] == 1} == {None} and {r["component"] for r in got} >= {1}


def test_registered_query_has_every_row(spark):
    from queryforge.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_embedding_whitening"](spark, sf)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 4 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
