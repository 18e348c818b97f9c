"""Evaluation operators: golden fold vectors from the published run reports, and properties."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import evaluate as V
from cohortlake.operators import serve as J
from cohortlake.operators import uncertainty as U

# Published per-fold values of two run reports (AUC, Brier) and their summary figures.
GOLDEN = {
    ("mortality", "lightgbm"): ([0.8115462470063657, 0.8104948006823971, 0.8124535568944501],
                                [0.17421259653535498, 0.1742641126643216, 0.1735588764428064]),
    ("response", "xgboost"): ([0.8996039603960396, 0.9122250000000001, 0.8894749999999999],
                              [0.10173615436783462, 0.10134573393784589, 0.12178526296746534]),
}
EXPECTED = {
    ("mortality", "lightgbm"): dict(mean=0.8114982015277376, std=0.0009802615725287287,
                                    lower=0.8103889311334972, upper=0.8126074719219779),
    ("response", "xgboost"): dict(mean=0.900434653465, lower=0.887536912063, upper=0.913332394868),
}


def fold_table(spark):
    rows = [(t, a, i + 1, auc, br) for (t, a), (aucs, brs) in GOLDEN.items()
            for i, (auc, br) in enumerate(zip(aucs, brs))]
    return spark.createDataFrame(rows, "task string, algorithm string, fold int, auc double, brier double")


def test_fold_summary_and_ci_golden(spark):
    fm = fold_table(spark)
    s = {(r.task, r.algorithm): r for r in V.fold_summary(fm, ["task", "algorithm"], ["auc", "brier"]).collect()}
    c = {(r.task, r.algorithm): r for r in V.auc_ci(fm, ["task", "algorithm"]).collect()}
    e = EXPECTED[("mortality", "lightgbm")]
    assert s[("mortality", "lightgbm")].auc_mean == pytest.approx(e["mean"], abs=1e-12)
    assert s[("mortality", "lightgbm")].auc_std == pytest.approx(e["std"], abs=1e-12)
    assert c[("mortality", "lightgbm")].lower == pytest.approx(e["lower"], abs=1e-12)
    assert c[("mortality", "lightgbm")].upper == pytest.approx(e["upper"], abs=1e-12)
    e = EXPECTED[("response", "xgboost")]
    assert c[("response", "xgboost")].mean == pytest.approx(e["mean"], abs=1e-11)
    assert c[("response", "xgboost")].lower == pytest.approx(e["lower"], abs=1e-11)
    assert c[("response", "xgboost")].upper == pytest.approx(e["upper"], abs=1e-11)


def test_ci_needs_two_finite_folds(spark):
    fm = spark.createDataFrame([("a", 0.7), ("b", 0.6), ("b", float("nan"))], "task string, auc double")
    r = {x.task: x for x in V.auc_ci(fm, ["task"]).collect()}
    assert r["a"].n_folds == 1 and r["a"].lower is None and r["a"].mean == 0.7
    assert r["b"].n_folds == 1 and r["b"].upper is None


def test_selection_from_report_means(spark):
    # outer_mean AUC / Brier of the six published reports; a missing report ranks last
    runs = spark.createDataFrame([
        ("mortality", "lightgbm", 0.8114982015277376, 0.17401186188082765, 0.38, "ok"),
        ("mortality", "xgboost", 0.81051, 0.17443, 0.41, "ok"),
        ("mortality", "tabnet", 0.79210, 0.19246, 0.34, "ok"),
        ("response", "lightgbm", 0.89428, 0.11528, 0.58, "ok"),
        ("response", "xgboost", 0.900434653465, 0.10829, 0.51, "ok"),
        ("response", "tabnet", None, None, None, "ok"),
    ], "task string, algorithm string, auc double, brier double, threshold double, status string")
    runs = runs.withColumn("error", F.lit(None).cast("string"))
    sel = {r.task: r for r in J.select_runs(J.rank_runs(runs)).collect()}
    assert sel["mortality"].algorithm == "lightgbm"
    assert sel["response"].algorithm == "xgboost"
    ranked = {(r.task, r.algorithm): r["rank"] for r in J.rank_runs(runs).collect()}
    assert ranked[("response", "tabnet")] == 3


def test_first_usable_run_skips_failed(spark):
    runs = spark.createDataFrame([("t", "a", 0.9, 0.1, "failed", "boom"), ("t", "b", 0.8, 0.1, "ok", None)],
                                 "task string, algorithm string, auc double, brier double, status string, error string")
    s = J.select_runs(J.rank_runs(runs.withColumn("threshold", F.lit(0.5)))).collect()[0]
    assert s.algorithm == "b" and s.skipped == ["a: boom"]


def scores(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.clip(0.35 * y + rng.random(n) * 0.65, 0, 1).round(3)  # ties on purpose
    return spark.createDataFrame([(int(i), float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))],
                                 "row_id long, p double, y int"), p, y


def brute_auc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def test_auc_matches_brute_force_and_symmetry(spark):
    df, p, y = scores(spark)
    auc = V.roc_auc(df).collect()[0].auc
    assert auc == pytest.approx(brute_auc(p, y), abs=1e-12)
    flipped = V.roc_auc(df.withColumn("p", 1 - F.col("p"))).collect()[0].auc
    assert auc + flipped == pytest.approx(1.0, abs=1e-9)
    assert V.roc_auc(df.filter("y = 1")).collect()[0].auc is None


def test_roc_curve_monotone_and_area(spark):
    df, p, y = scores(spark)
    pts = sorted((r.fpr, r.tpr) for r in V.roc_curve(df).collect())
    pts = [(0.0, 0.0)] + pts
    assert all(b[0] >= a[0] and b[1] >= a[1] for a, b in zip(pts, pts[1:]))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert area == pytest.approx(brute_auc(p, y), abs=1e-9)


def test_histogram_counts_sum(spark):
    df, p, y = scores(spark)
    h = V.probability_histogram(df).collect()
    assert sum(r.n for r in h) == len(p)
    for cls in (0, 1):
        counts, _ = np.histogram(p[y == cls], bins=np.linspace(0.0, 1.0, 21))
        got = {r.bin: r.n for r in h if r.y == cls}
        assert [got.get(i, 0) for i in range(20)] == counts.tolist()


def test_best_threshold_brute_force(spark):
    df, p, y = scores(spark)
    best = None
    for t in [0.5] + V.THRESHOLD_GRID:
        pred = p >= t
        tp, fp = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum())
        fn = int((~pred & (y == 1)).sum())
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        acc = float((pred == (y == 1)).mean())
        if best is None or f1 > best[1] or (f1 == best[1] and acc > best[2]):
            best = (t, f1, acc)
    got = V.best_threshold(df).collect()[0]
    assert got.threshold == best[0] and got.f1 == pytest.approx(best[1], abs=1e-12)


def test_conformal_coverage(spark):
    df, p, y = scores(spark)
    q = U.conformal_quantile(df, alpha=0.1)
    qv = q.collect()[0].q
    s = U.prediction_sets(df, q.select("q").scalar())
    covered = s.select(F.avg(F.when(F.col("y") == 1, F.col("set_contains_1")).otherwise(F.col("set_contains_0")))).first()[0]
    assert covered >= 0.9
    k = math.ceil((len(p) + 1) * 0.9)
    sc = np.sort(1 - np.where(y == 1, p, 1 - p))
    assert qv == pytest.approx(sc[k - 1], abs=1e-12)


def test_calibration_matches_numpy(spark):
    df, p, y = scores(spark)
    edges = np.percentile(p, np.linspace(0, 1, 11) * 100)
    bins = np.searchsorted(edges[1:-1], p)
    got = {r.bin: r for r in V.calibration_curve(df).collect()}
    for b in np.unique(bins):
        m = bins == b
        assert got[int(b)].n == int(m.sum())
        assert got[int(b)].fraction_positive == pytest.approx(y[m].mean(), abs=1e-12)


def test_roc_curve_drops_collinear_points_like_the_usual_default(spark):
    df, p, y = scores(spark)
    order = np.argsort(-p, kind="mergesort")
    ps, ys = p[order], y[order]
    last = np.r_[np.where(np.diff(ps))[0], len(ps) - 1]
    tps = np.cumsum(ys)[last]
    fps = 1 + last - tps
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    want = sorted([(float(ps[last][i]), int(tps[i]), int(fps[i])) for i in keep] + [(float("inf"), 0, 0)])
    got = sorted((r.threshold, r.tps, r.fps) for r in V.roc_curve(df).collect())
    assert got == want
