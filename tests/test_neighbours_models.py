"""Exact k-NN on clustered / duplicated / sparse points, exact quantiles, and the grid-search path."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import models as M
from cohortlake.operators import ordered as O
from cohortlake.operators import oversample as OV


def brute(points, k):
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    out = {}
    for i in range(len(points)):
        order = sorted((d[i, j], j) for j in range(len(points)) if j != i)[:k]
        out[i] = [j for _, j in order]
    return out


def test_knn_exact_with_clusters_duplicates_and_outliers(spark):
    rng = np.random.default_rng(3)
    dense = rng.normal(0, 0.01, (150, 4))
    dups = np.repeat(rng.normal(5, 1, (1, 4)), 8, axis=0)
    far = rng.normal(0, 50, (12, 4))
    pts = np.round(np.vstack([dense, dups, far]), 6)
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    got = {}
    for r in OV.knn_exact(df, "id", "v", k=5).collect():
        got.setdefault(r.id, []).append((r.nn_rank, r.nn_id))
    want = brute(pts, 5)
    for i in range(len(pts)):
        assert [j for _, j in sorted(got[i])] == want[i], i


def test_smote_balances_and_interpolates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 3)], 1 if i < 20 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    out = OV.smote(df, "id", "v", "y")
    counts = {(r.y, r.synthetic): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert counts == {(0, False): 80, (1, False): 20, (1, True): 60}
    minority = np.array([r[1] for r in rows if r[2] == 1])
    lo, hi = minority.min(0), minority.max(0)
    for r in out.filter("synthetic").collect():
        assert np.all(np.array(r.v) >= lo - 1e-9) and np.all(np.array(r.v) <= hi + 1e-9)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.random(2001), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "p double")
    qs = [0.1, 0.25, 0.5, 0.9]
    assert O.exact_quantiles(df, "p", qs) == pytest.approx(np.percentile(x, [q * 100 for q in qs]).tolist(), abs=1e-12)


def test_grid_search_path(spark):
    """A tiny grid over explicit inner folds, oversampled inside each; the choice is noted."""
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.random() * 10), "a" if i % 3 else "b", int(rng.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, x double, c string, y int")
    cfg = M.RunConfig(task="t", algorithm="xgboost", label="y", numeric=["x"], categorical=["c"], use_grid=True,
                      grid={"maxDepth": (2, 3), "maxIter": (3,)}, trees=3)
    res = M.nested_cv(df, cfg)
    assert res["oof"].count() == 300
    assert sum(n.startswith("grid=maxDepth:") for n in res["notes"]) == 3
    assert "gridsearch=true" in res["notes"] and "oversampling=true" in res["notes"]
    assert {r.fold for r in res["fold_metrics"].collect()} == {0, 1, 2}


def test_knn_exact_heavy_duplicates(spark):
    rng = np.random.default_rng(11)
    hot = np.repeat(np.array([[1.0, 2.0, 3.0]]), 200, axis=0)
    near = np.round(hot[:3] + rng.normal(0, 0.001, (3, 3)), 6)
    rest = np.round(rng.normal(0, 3, (40, 3)), 6)
    pts = np.vstack([hot, near, rest])
    order = rng.permutation(len(pts))  # ids not aligned with the duplicate block
    pts = pts[order]
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    got = {}
    for r in OV.knn_exact(df, "id", "v", k=5).collect():
        got.setdefault(r.id, []).append((r.nn_rank, r.nn_id))
    want = brute(pts, 5)
    assert all([j for _, j in sorted(got[i])] == want[i] for i in range(len(pts)))


def test_final_fit_best_params(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.random() * 10), int(rng.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, x double, y int")
    cfg = M.RunConfig(task="t", algorithm="xgboost", label="y", numeric=["x"], categorical=[],
                      final_params="best", oversample=False, grid={"maxDepth": (2, 3), "maxIter": (3,)}, trees=3)
    ff = M.final_fit(df, cfg)
    assert ff["holdout"].count() == 60
    assert ff["best_threshold"].first().threshold is not None


def test_knn_over_many_blocks_with_groups_and_missing_vectors(spark, monkeypatch):
    """Blocks of a few rows; a null vector has null distances, after all others, and is last of its group's neighbours."""
    monkeypatch.setattr(OV, "BLOCK", 16)
    monkeypatch.setattr(OV, "PART_BLOCKS", 2)
    rng = np.random.default_rng(13)
    pts = np.round(rng.normal(0, 0.01, (130, 8)), 3)
    rows = [(f"r{i:03d}", None if i == 7 else [float(x) for x in p], i % 2 if i < 126 else 2) for i, p in enumerate(pts)]
    df = spark.createDataFrame([*rows, ("none", [0.0] * 8, None)], "id string, v array<double>, g int")
    got = {}
    for r in OV.knn_exact(df, "id", "v", k=5, by="g").collect():
        got.setdefault(r.id, []).append((r.nn_rank, r.nn_id, r.dist))
    assert set(got) == {r[0] for r in rows}
    for i, (name, v, g) in enumerate(rows):
        def dist(j):
            if v is None or rows[j][1] is None:
                return np.inf
            total = 0.0
            for a, b in zip(v, rows[j][1]):  # in order, as Spark and SQL add (sum() compensates)
                total += (a - b) * (a - b)
            return total ** 0.5
        want = sorted((dist(j), rows[j][0]) for j in range(130) if j != i and rows[j][2] == g)[:5]
        assert [(n, d) for _, n, d in sorted(got[name])] == [(n, None if d == np.inf else d) for d, n in want], name


def test_knn_leaves_far_blocks_out_unread(spark, monkeypatch):
    """Points spread over two entries: a block meets those around it, not a band of all that are as far along one direction."""
    monkeypatch.setattr(OV, "BLOCK", 16)
    monkeypatch.setattr(OV, "PART_BLOCKS", 16)
    met = spark.sparkContext.accumulator(0)
    search = OV._search

    def counted(*args):
        run = search(*args)

        def count(batches):
            for b in batches:
                met.add(b.num_rows)
                yield from run(iter([b]))
        return count

    monkeypatch.setattr(OV, "_search", counted)
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, [1000, 150, 1], (1500, 3)), 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in OV.knn_exact(df, "id", "v", k=5).collect():
        got.setdefault(r.id, []).append((r.nn_rank, r.nn_id))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == {i: np.lexsort((np.arange(len(x)), d[i]))[:5].tolist() for i in range(len(x))}
    blocks = -(-1500 // 16)
    assert blocks <= met.value < blocks * blocks / 4


def test_knn_shuffles_no_pairs_of_vectors(spark, monkeypatch):
    """Vectors meet in a cartesian product of blocks; its rows are pairs of blocks, and shuffles after it hold keys and distances."""
    monkeypatch.setattr(OV, "BLOCK", 16)
    seen = []
    search = OV._search

    def counted(dim, k):
        run = search(dim, k)

        def both(batches):
            for out in run(batches):
                assert out.schema.names == ["ord", "nord", "dist"] and out.num_rows <= 16 * (k + 1)
                yield out
        seen.append(dim)
        return both
    monkeypatch.setattr(OV, "_search", counted)
    rng = np.random.default_rng(17)
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(rng.normal(0, 1, (200, 6)))], "id long, v array<double>")
    assert OV.knn_exact(df, "id", "v", k=5).count() == 1000 and seen == [6]


def test_nested_cv_of_the_network(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.random() * 10), "a" if i % 3 else "b", int(rng.random() < 0.4)) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, x double, c string, y int")
    res = M.nested_cv(df, M.RunConfig(task="response", algorithm="tabnet", label="y", numeric=["x"], categorical=["c"], oversample=False))
    got = res["oof"].collect()
    assert sorted(r.row_id for r in got) == list(range(120)) and all(0 <= r.p <= 1 for r in got)
    assert {r.fold for r in res["fold_metrics"].collect()} == {0, 1, 2}
