"""Whitening against NumPy's eigenvectors of the whole covariance."""
import math

import numpy as np
import pytest

from cohortlake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, components=4):
    """Distinct integer vectors, mean, leading eigenpairs, trace."""
    x = np.unique(np.floor(256 * np.array(vectors, float)).astype(np.int64), axis=0)
    mean = x.mean(0)
    v = (x - mean).T @ (x - mean) / len(x)
    values, turn = np.linalg.eigh(v)
    return x, mean, values[::-1][:components], turn[:, ::-1][:, :components], np.trace(v)


def check(rows, got, components=4):
    ok = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x, mean, values, turn, trace = brute([v for _, v in ok])
    n, total = len(x), [int(s) for s in x.sum(0)]
    for k in range(1, components + 1):
        part = [r for r in got if r.component == k]
        assert sorted((r.vec_id is None, r.vec_id or 0) for r in part) == sorted((i is None, i or 0) for i, _ in ok)
        want = {i: (np.floor(256 * np.array(v, float)) - mean) @ turn[:, k - 1] / math.sqrt(values[k - 1]) for i, v in ok}
        sign = np.sign(sum(r.whitened * want[r.vec_id] for r in part))
        for r in part:
            assert r.n == n and abs(r.whitened * sign - want[r.vec_id]) < 1e-9 and abs(r.explained / (values[k - 1] / trace) - 1) < 1e-10 and r.identity_error < 1e-9
    dev = {i: sum((n * int(c) - s) ** 2 for c, s in zip(np.floor(256 * np.array(v, float)), total)) for i, v in ok}
    assert all(r.deviation == dev[r.vec_id] for r in got)


def test_query_equals_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, queries.QUERIES["op13_embedding_whitening"](spark, sf).collect())


def test_awkward_rows(spark):
    r = np.random.default_rng(2)
    data = (r.standard_normal((300, 40)) * np.linspace(3, 1, 40)).astype(np.float32).tolist()
    rows = [*enumerate(data), (500, None), (501, [None, *data[0][1:]]), (502, [float("nan"), *data[0][1:]]), (503, [float("inf"), *data[0][1:]]), (504, []), (None, data[3])]
    rows += [(600 + i, data[7]) for i in range(200)]  # copies count once
    df = spark.createDataFrame([(i, v, "x", 9) for i, v in rows], SCHEMA + ", x string, n int").repartition(5)
    check(rows, whitening.whiten(df).collect())
    short = spark.createDataFrame([(900 + i, [1.0, float(i)]) for i in range(20)], SCHEMA)
    assert whitening.whiten(df.select("vec_id", "embedding").unionByName(short)).where("vec_id >= 900").count() == 0


def test_no_or_one_vector_and_low_rank(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == [] and whitening.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    got = whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r.component for r in got} == {1}
    check(line, got, 1)


def test_equal_eigenvalues_and_wide_vectors(spark):
    corners = [(i, [float(i >> b & 1) for b in range(5)]) for i in range(32)]
    got = whitening.whiten(spark.createDataFrame(corners, SCHEMA)).collect()
    assert len(got) == 128 and all(abs(r.explained - 0.2) < 1e-12 and r.identity_error < 1e-9 for r in got)
    r = np.random.default_rng(4)
    wide = [(i, (r.standard_normal(200) + 5).tolist()) for i in range(400)]
    check(wide, whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect())


def test_huge_entries(spark):
    big = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(big).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(1, None), (2, None), (3, 1 + 768 ** 2)} and all(math.isfinite(r.whitened) for r in got)


def test_degree_and_guards_do_not_show(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate((r.standard_normal((200, 30)) * np.linspace(2, 1, 30)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(whitening, "GUARDS", 4)
    monkeypatch.setattr(whitening, "DEGREE", 5)
    monkeypatch.setattr(whitening, "BLOCK", 7)
    found = whitening.fit(df)
    assert found.residual <= whitening.TOLERANCE
    _, _, values, turn, _ = brute([v for _, v in rows])
    assert np.allclose(found.values, values, rtol=1e-12) and np.allclose(np.abs(found.vectors.T @ turn), np.eye(4), atol=1e-10)


@pytest.mark.parametrize("raw", [[0, 1, -128], [300, -5], [1 << 40], [-(1 << 63), (1 << 63) - 1], []])
def test_packing(raw):
    x = np.array(raw, np.int64)
    assert whitening.unpacked(whitening.packed(x)).tolist() == raw
