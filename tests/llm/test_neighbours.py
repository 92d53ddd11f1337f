"""Cross-polytope search against brute force."""

import numpy as np
import pytest

from splicelake.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, query_id string, rank int"


def brute(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        s[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order if s[j] > -np.inf]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) / len(w) for q, w in want.items()])


def test_recall_on_the_driver_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got, want = found(neighbours.search(df)), brute(ids, x, 20, 20)
    assert recall(got, want) >= 0.9
    by_id = dict(zip(ids.tolist(), x))
    for q, some in got.items():
        assert all(abs(s - float((by_id[q] * by_id[v]).sum())) < 1e-12 for v, s in some)
        assert [(-s, v) for v, s in some] == sorted((-s, v) for v, s in some)


def test_copies_lengths_and_two_hashes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24)).astype(np.float32) * rng.uniform(0.5, 3, (400, 1)).astype(np.float32)
    x[100:250] = x[100]
    df = spark.createDataFrame([(i, v.tolist(), 0, "q", 1) for i, v in enumerate(x)], SCHEMA)
    want = brute(np.arange(400), x.astype(np.float64), 20, 20)
    got = found(neighbours.search(df, block_rows=64))
    assert recall(got, want) > 0.9
    assert [v for v, _ in got[120]] == [v for v, _ in want[120]]  # copies: ties to the smaller id
    assert recall(found(neighbours.search(df, hashes=2, tables=32, probes=400)), want) > 0.9


def test_one_long_vector_hides_no_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 1000
    df = spark.createDataFrame([(i, v.tolist(), 0, "q", 1) for i, v in enumerate(x)], SCHEMA)
    want = brute(np.arange(600), x.astype(np.float64), 20, 20)
    assert recall(found(neighbours.search(df, block_rows=64)), want) > 0.9


@pytest.mark.parametrize("n", [1, 2, 3, 10, 19, 20, 21, 22])
def test_small_tables_give_all_candidates(spark, n):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0, "q", 1) for i, v in enumerate(x)], SCHEMA)
    want = {q: some for q, some in brute(np.arange(n), x.astype(np.float64), 20, 20).items() if some}
    got = found(neighbours.search(df))
    assert {q: len(some) for q, some in got.items()} == {q: min(n - 1, 20) for q in want}
    if n <= 21:  # all candidates, if fewer
        assert {q: [v for v, _ in some] for q, some in got.items()} == {q: [v for v, _ in some] for q, some in want.items()}


def test_crowded_cells_of_rows_and_queries(spark):
    """A third of all rows is one vector, another third lies close around it."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[::3] = x[0]
    x[1::3] = x[0] + rng.normal(scale=0.05, size=(300, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0, "q", 1) for i, v in enumerate(x)], SCHEMA)
    want = brute(np.arange(900), x.astype(np.float64), 5, 20)
    got = found(neighbours.search(df, every=5, block_rows=16))
    assert recall(got, want) >= 0.9
    assert all(len(some) == 20 for some in got.values())


def test_probe_ranks_are_the_probe_order():
    rng = np.random.default_rng(3)
    q, v = (rng.normal(size=(40, 12)) for _ in range(2))
    for hashes in (1, 2):
        model = neighbours.CrossPolytope(12, 2, hashes)
        rank, cells, order = model.ranks(q, v, 1), model.cells(v, 1), model.probes(q, 1, model.all_cells)
        assert [int(np.flatnonzero(o == c)[0]) for o, c in zip(order, cells)] == rank.tolist()


def test_odd_vectors(spark):
    good = [float(v) for v in range(1, 9)]
    rows = [(0, good), (1, None), (2, [0.0] * 8), (3, [None] + good[1:]), (4, [float("nan")] + good[1:]), (5, good[:3]), (6, good), (7, [float("inf")] + good[1:]), (None, good), (20, [-v for v in good]), (6, good)]
    df = spark.createDataFrame([(*r, 0, "q", 1) for r in rows], SCHEMA)
    got = found(neighbours.search(df))
    assert got[0][0] == (6, 204.0) and {v for v, _ in got[0]} <= {6, 20} and set(got) <= {0, 20}
    assert neighbours.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert neighbours.search(spark.createDataFrame([(0, good, 0, "q", 1)], SCHEMA)).count() == 0


def test_hash_is_a_rotation():
    model = neighbours.CrossPolytope(10, 2, 1)
    x = np.random.default_rng(0).normal(size=(5, 10))
    r = model._rotate(model._padded(x), 0, 0)
    assert np.allclose((r * r).sum(axis=1), (x * x).sum(axis=1), rtol=1e-5)
    assert (model.probes(x, 1, 4)[:, 0] == model.cells(x, 1)).all()
