import numpy as np
from pyspark.sql import functions as F

from envspark.llm.neighbours import hilbert_keys, nearest_neighbours, op2_hilbert_neighbours


def brute(rows, queries, k):
    """All candidates of every query in order of distance, then id."""
    out = {}
    for q in queries:
        x = np.asarray(rows[q], np.float64)
        apart = sorted((float(np.sqrt(((np.asarray(v, np.float64) - x) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = apart[:k]
    return out


def test_curve_visits_every_cell_once_by_single_steps():
    for n, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def as_rows(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def test_odd_vectors_ties_and_copies(spark, clashing):
    rng = np.random.default_rng(0)
    rows = {i: [float(x) for x in rng.normal(size=6).round(1)] for i in range(300)}
    for i in range(40, 90):
        rows[i] = rows[0]
    odd = [(1000, None), (1100, [0.0] * 6), (1200, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1300, [float("nan")] * 6), (1400, [float("inf")] * 6), (1500, [1.0]), (None, rows[1]), (1600, [])]
    full = [*rows.items(), *odd, (7, rows[7])]
    vectors = clashing(spark.createDataFrame(full, "vec_id long, embedding array<double>"))
    got = as_rows(nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, k=10, block=64))
    wanted = brute(rows, [i for i in rows if i % 20 == 0], 10)
    assert set(got) == set(wanted)
    for q, near in wanted.items():
        assert [x[0] for x in got[q]] == list(range(1, 11))
        assert [(i, round(s, 9)) for _, i, s in got[q]] == [(i, round(s, 9)) for s, i in near], q


def test_few_and_no_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (100, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = as_rows(nearest_neighbours(vectors, F.col("vec_id") % 100 == 0))
    assert got == {0: [(1, 100, 0.0), (2, 1, 1.0)], 100: [(1, 0, 0.0), (2, 1, 1.0)]}
    assert nearest_neighbours(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest_neighbours(vectors.filter("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_over_blocks(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    rows = {i: (centres[i % 40] + 0.4 * rng.normal(size=32)).tolist() for i in range(3000)}
    got = as_rows(nearest_neighbours(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, block=100))
    wanted = brute(rows, [i for i in rows if i % 100 == 0], 10)
    hits = sum(len({i for _, i in near} & {i for _, i, _ in got[q]}) for q, near in wanted.items())
    assert hits >= 0.9 * 10 * len(wanted)
    for q in wanted:
        assert all(abs(s - np.linalg.norm(np.array(rows[i]) - rows[q])) < 1e-12 for _, i, s in got[q])


def test_query(spark, sf_dir):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = as_rows(op2_hilbert_neighbours(spark, sf_dir))
    wanted = brute(rows, [i for i in rows if i % 100 == 0], 10)
    assert {q: [i for _, i, _ in near] for q, near in got.items()} == {q: [i for _, i in near] for q, near in wanted.items()}


def test_the_window_follows_the_table(spark):
    rng = np.random.default_rng(9)
    rows = {i: rng.normal(size=32).tolist() for i in range(4000)}
    vectors = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = as_rows(nearest_neighbours(vectors, F.col("vec_id") % 100 == 0, block=20))
    wanted = brute(rows, [i for i in rows if i % 100 == 0], 10)
    hits = sum(len({i for _, i in near} & {i for _, i, _ in got[q]}) for q, near in wanted.items())
    assert hits >= 0.75 * 10 * len(wanted)
