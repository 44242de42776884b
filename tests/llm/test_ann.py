import numpy as np
import pytest

from aforo.llm.ann import Tree, chi_square_quantile, fit, nearest

SCHEMA = "vec_id long, embedding array<float>"


def brute_force(rows, queries, k=10):
    """(query, rank, id, distance), ties to the smaller id, over the rows that take part."""

    def valid(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    taken = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and valid(v)]
    asked = {i: np.array(v, dtype=np.float32).astype(float) for i, v in queries if i is not None and valid(v)}
    out = []
    for q, v in asked.items():
        found = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in taken if i != q)[:k]
        out += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(found)]
    return out


def got_rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def recall(got, expected):
    got, expected = ({(q, i) for q, _, i, _ in rows} for rows in (got, expected))
    return len(got & expected) / max(1, len(expected))


def vectors(n, dims=32, seed=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((10, dims))
    return [(i, (centres[i % 10] * 0.5 + rnd.standard_normal(dims)).tolist()) for i in range(n)]


def test_quantiles():
    # Fixed values of the chi-square distribution.
    assert chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)
    assert chi_square_quantile(0.99, 8) == pytest.approx(20.0902, abs=1e-3)


@pytest.mark.parametrize("cell_rows, query_rows", [(100, 7), (8192, 4096)])
def test_recall_and_exact_distances(frame, cell_rows, query_rows):
    rows = vectors(1500)
    queries = rows[::50]
    got = got_rows(nearest(frame(SCHEMA, rows), frame(SCHEMA, queries), cell_rows=cell_rows, query_rows=query_rows))
    expected = brute_force(rows, queries)
    assert recall(got, expected) >= 0.95
    distance = {(q, i): d for q, _, i, d in brute_force(rows, queries, 1500)}
    assert all(d == pytest.approx(distance[q, i], rel=1e-12) for q, _, i, d in got)
    for q in {r[0] for r in got}:
        mine = [r for r in got if r[0] == q]
        assert [r[1] for r in mine] == list(range(1, 11))
        assert [(r[3], r[2]) for r in mine] == sorted((r[3], r[2]) for r in mine)


def test_certain_search_is_exact(frame):
    rows = vectors(600, 8)
    queries = rows[::20]
    got = nearest(frame(SCHEMA, rows), frame(SCHEMA, queries), confidence=1 - 1e-9, cell_rows=50)
    assert [r[:3] for r in got_rows(got)] == [r[:3] for r in sorted(brute_force(rows, queries))]


def test_hot_vector_and_ties(frame):
    """A third of the rows, and of the queries, are one vector: the smallest ids win."""
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(i % 7), float(i % 11), 1.0 + i % 5]) for i in range(900)]
    queries = rows[::30]
    got = nearest(frame(SCHEMA, rows), frame(SCHEMA, queries), confidence=1 - 1e-9, cell_rows=64)
    assert [r[:3] for r in got_rows(got)] == [r[:3] for r in sorted(brute_force(rows, queries))]


def test_vectors_that_take_no_part(frame):
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, [0.0, 0.0]), (102, [nan, 1.0]), (103, [inf, 1.0]), (104, [None, 1.0]), (None, [1.0, 1.0]), (105, [])]
    rows = [(i, [1.0 + i, 2.0]) for i in range(6)] + bad
    got = got_rows(nearest(frame(SCHEMA, rows), frame(SCHEMA, rows)))
    expected = sorted(brute_force(rows, rows))
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected])
    assert {r[0] for r in got} == set(range(6)) and len(got) == 30


def test_repeated_rows_clashing_columns_and_empty_tables(frame):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5])]
    df = frame(SCHEMA + ", rank int, score string", [(*r, 7, "s") for r in rows])
    got = nearest(df, df.filter("vec_id = 1"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert [r[:3] for r in got_rows(got)] == [(1, 1, 3), (1, 2, 2)]
    assert nearest(df, df.limit(0)).count() == 0
    assert nearest(df.limit(0), df).count() == 0


def test_tree_gives_leaves_in_order_of_distance():
    rnd = np.random.default_rng(3)
    points = rnd.standard_normal((1000, 4))
    tree = Tree(points)
    assert sorted(tree.order.tolist()) == list(range(1000))
    leaves, distances = tree.leaves_by_distance(np.zeros(4))
    for leaf, bound in zip(leaves, distances):
        inside = points[tree.order[tree.begins[leaf] : tree.ends[leaf]]]
        assert np.sqrt((inside**2).sum(axis=1)).min() >= bound - 1e-12


def test_upper_tree_deals_all_rows():
    rnd = np.random.default_rng(3)
    points = rnd.standard_normal((4000, 16))
    fitted = fit(points, 4000, 16, cell_rows=500)
    sizes = np.bincount(fitted.cells(fitted.project(points)))
    assert len(sizes) == 8 and sizes.min() > 400


def test_a_few_vectors_of_other_lengths_cost_no_others(frame):
    """Whatever their hashes: among so many odd ones some has the least of all."""
    rows = vectors(120, dims=8)
    odd = [(1000 + i, [float(i + 1)] * (7 if i % 2 else 9)) for i in range(80)]
    queries = [*rows[::20], odd[0]]
    got = got_rows(nearest(frame(SCHEMA, rows + odd), frame(SCHEMA, queries)))
    expected = brute_force(rows, rows[::20])
    assert {(q, r) for q, r, _, _ in got} == {(q, r) for q, r, _, _ in expected} and recall(got, expected) > 0.95
    # Of tied lengths the larger counts.
    pair = [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 2.0, 4.0])]
    assert [(r[0], r[2]) for r in got_rows(nearest(frame(SCHEMA, pair), frame(SCHEMA, pair)))] == [(3, 4), (4, 3)]
