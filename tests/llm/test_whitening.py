"""Whitening against whole-number arithmetic over all rows, and its edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from aforo.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows):
    """Sums and n**2 times the covariance of whole numbers, cross products and all, as Python's integers."""
    whole = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(whole), len(whole[0])
    sums = [sum(v[i] for v in whole) for i in range(d)]
    centred = [[n * v[i] - sums[i] for i in range(d)] for v in whole]
    return n, sums, [[Fraction(sum(v[i] * v[j] for v in centred), n**3) for j in range(d)] for i in range(d)], [sum(c * c for c in v) for v in centred]


def random_rows(n, d, seed=1, size=3.0):
    rnd = np.random.default_rng(seed)
    mixed = rnd.normal(size=(n, d)) @ rnd.normal(size=(d, d)) * size + rnd.normal(size=d) * 50
    return mixed.astype(np.float32).astype(float).tolist()


def test_against_whole_numbers(frame):
    vectors = random_rows(300, 7)
    n, sums, matrix, deviations = exact(vectors)
    model = whitening.fit(frame(SCHEMA, list(enumerate(vectors))), "embedding")
    assert (model.n, list(model.sums)) == (n, sums)
    expected = np.array([[float(c) for c in row] for row in matrix])
    values = np.linalg.eigvalsh(expected)[::-1]
    np.testing.assert_allclose(model.variances, values, rtol=1e-12)
    np.testing.assert_allclose(expected @ model.directions, model.directions * model.variances, atol=1e-9 * values[0])

    got = {r.vec_id: r for r in whitening.whiten(frame(SCHEMA, list(enumerate(vectors)))).collect()}
    assert {i: int(r.deviation) for i, r in got.items()} == dict(enumerate(deviations))
    white = np.array([got[i].whitened for i in range(n)])
    x = np.floor(np.array(vectors) * 64) + 1_000_000
    plain = (x - np.array(sums) / n) @ model.directions / np.sqrt(model.variances)
    np.testing.assert_allclose(white, plain, atol=1e-8)
    np.testing.assert_allclose(np.cov(white.T, bias=True), np.eye(7), atol=1e-9)
    assert all(r.identity_error < 1e-9 and r.n == n for r in got.values())
    np.testing.assert_allclose(got[0].explained, values / values.sum(), rtol=1e-9)


@pytest.mark.parametrize("size", [1.0, 1e5, 1e10])
def test_matrix_is_exact_whatever_the_size(size):
    """Beyond 64 bits too: each entry is the exact one, rounded once."""
    vectors = random_rows(40, 5, 3, size)
    n, sums, matrix, _ = exact(vectors)
    whole = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=np.int64)
    centres, left = np.array([s // n for s in sums]), np.array([s % n for s in sums])
    found = whitening.covariance([int(s) for s in whitening.pair_squares(whole - centres)], left, n)
    assert found.tolist() == [[float(c) for c in row] for row in matrix]


def test_bad_vectors_take_no_part(frame):
    good = random_rows(60, 4)
    rows = [*enumerate(good), (100, None), (101, [1.0, None, 2.0, 3.0]), (102, [math.nan] * 4), (103, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0, 0.0]), (None, good[0]), (3, good[3])]
    got = whitening.whiten(frame(SCHEMA, rows)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in got) == sorted([*range(60), -1, 3])
    assert {r.n for r in got} == {62}
    assert len({(r.vec_id, tuple(np.round(r.whitened, 12))) for r in got if r.vec_id == 3}) == 1


def test_fewer_directions_than_dimensions(frame):
    """Equal rows have none, three rows two, and a constant dimension adds none."""
    assert [r.whitened for r in whitening.whiten(frame(SCHEMA, [(i, [1.0, 2.0]) for i in range(9)])).collect()] == [[]] * 9
    assert whitening.by_component(whitening.whiten(frame(SCHEMA, [(1, [1.0, 2.0])]))).count() == 0
    rows = [(1, [1.0, 2.0, 5.0, 0.0]), (2, [3.0, -2.0, 5.0, 1.0]), (3, [0.5, 8.0, 5.0, -7.0])]
    got = whitening.whiten(frame(SCHEMA, rows)).collect()
    assert {len(r.whitened) for r in got} == {2} and all(r.identity_error < 1e-9 for r in got)
    assert sum(got[0].explained) == pytest.approx(1)


def test_empty_and_clashing_columns(frame):
    assert whitening.whiten(frame(SCHEMA, [])).count() == 0
    assert whitening.whiten(frame(SCHEMA, [(1, None)])).count() == 0
    rows = [(i, v, 1, "x", 2.0) for i, v in enumerate(random_rows(20, 3))]
    clashing = frame(f"{SCHEMA}, n int, place string, deviation double", rows)
    assert whitening.whiten(clashing).collect()[0].n == 20


def test_long_vectors(frame):
    got = whitening.whiten(frame(SCHEMA, list(enumerate(random_rows(150, 300)))), components=5).collect()
    assert {len(r.whitened) for r in got} == {5} and got[0].identity_error < 1e-8


def test_query(spark):
    got = queries.QUERIES["op12_polarised_whitening"](spark, "/root/testdata/sf0.01")
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    rows = got.collect()
    vectors = [r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()]
    n, _, matrix, deviations = exact(vectors)
    values = np.linalg.eigvalsh(np.array([[float(c) for c in row] for row in matrix]))[::-1]
    assert len(rows) == n * 32 and max(r.identity_error for r in rows) < 1e-4
    assert sorted({r.deviation for r in rows}) == sorted(set(deviations))
    for r in rows[:64]:
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
