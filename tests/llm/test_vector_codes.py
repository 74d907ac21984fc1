import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from envspark.llm import vector_codes as vc


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, label, vector) rows coded one by one with whole numbers of Python."""
    ok = [(i, lab, [int(np.floor(scale * float(x))) for x in v]) for i, lab, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    ok = [r for r in ok if len(r[2]) == len(ok[0][2])]
    width = len(ok[0][2]) // parts if ok else 0
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in ok[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, _, v in ok:
            out.append([min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, _, v), f in zip(ok, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, sum(x for x, (_, other, _) in zip(errors, ok) if other == lab), digest) for (i, lab, _), f, e in zip(ok, found, errors)), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-40, 40), min_size=3, max_size=3), min_size=1, max_size=70), st.lists(st.lists(st.integers(-50, 50), min_size=3, max_size=3), min_size=1, max_size=20))
def test_nearest_is_exact_and_ties_go_to_the_lower_entry(entries, points):
    slices = vc.Slices(np.array(entries, np.int64))
    points = np.array(points, np.int64)
    found, distance = slices.nearest(points)
    every = ((points[:, None, :] - slices.entries[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    held = slices.candidates(points)
    within = (np.abs(points[:, None, :] - slices.entries[None]) <= slices.radius(points)[:, None, None]).all(axis=2)
    masks = (held[:, np.arange(len(entries)) // 64] >> (np.arange(len(entries)) % 64).astype(np.uint64)) & np.uint64(1)
    assert (masks.astype(bool) == within).all()


def test_candidates_are_few():
    rng = np.random.default_rng(3)
    entries, points = rng.integers(-700, 700, (16, 8)), rng.integers(-700, 700, (2000, 8))
    held = vc.Slices(entries).candidates(points)
    assert np.bitwise_count(held).mean() < 14
    grouped = entries[rng.integers(0, 16, 2000)] + rng.integers(-40, 40, (2000, 8))
    assert np.bitwise_count(vc.Slices(entries).candidates(grouped)).mean() < 2


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [None, 1, 2][i % 3], [float(np.float32(x)) for x in rng.normal(0, 0.1, 16)]) for i in rng.permutation(60) + 1]
    same = [0.25] * 16
    rows += [(100 + k, 7, same) for k in range(20)] + [(5, 2, same), (5, 2, same), (None, 1, same), (None, None, same)]
    rows += [(0, 1, None), (-1, 1, []), (-2, 1, [0.5] * 15 + [None]), (-3, 1, [float("nan")] + [0.1] * 15), (-4, 1, [float("-inf")] + [0.1] * 15), (70, 1, [0.1] * 8), (71, 1, [0.0] * 16), (72, 1, [-1.0 / 4096] * 16)]
    return rows, spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def run(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return vc.op11_vector_codes(spark, str(tmp_path))


def test_odd_rows_match_brute_force(spark, odd_vectors, clashing, tmp_path):
    rows, df = odd_vectors
    more = clashing(df).withColumns({c: F.lit(f"extra {c}") for c in ("code", "error", "_vector", "_label", "label_error")})
    assert sorted(map(tuple, run(spark, more, tmp_path).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("n", [1, 5, 17])
def test_fewer_vectors_than_entries(spark, odd_vectors, tmp_path, n):
    rows = odd_vectors[0][:n]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert sorted(map(tuple, run(spark, df, tmp_path).collect()), key=repr) == brute(rows)


def test_no_vectors(spark, odd_vectors, tmp_path):
    assert run(spark, odd_vectors[1].limit(0), tmp_path).collect() == []
    assert run(spark, odd_vectors[1].filter("embedding is null"), tmp_path).collect() == []


def test_codes_stand_for_near_vectors(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = vc.train_codebooks(vectors)
    coded = vc.encode(vectors, books, keep=("vec_id", "embedding")).collect()
    back = vc.decode([r.code for r in coded], books)
    own = np.floor(4096 * np.array([r.embedding for r in coded]))
    assert (((own - back * 4096) ** 2).sum(axis=1) == [r.error for r in coded]).all()
    first = vc.first_codebooks(vectors, 8, 16, 4096, "vec_id", "embedding")
    assert sum(r.error for r in coded) < 0.8 * sum(r.error for r in vc.encode(vectors, first).collect())


def test_limits_are_stated(spark, odd_vectors):
    with pytest.raises(ValueError, match="equal parts"):
        vc.train_codebooks(odd_vectors[1], parts=5)
    far = spark.createDataFrame([(1, [1e30] * 8)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="smaller scale"):
        vc.train_codebooks(far)
