"""The proportional-hazards fit against plain NumPy, its baseline against the event-time table, concordance against all pairs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import hazards as HZ
from cohortlake.operators import uncertainty as U


def table(seed, n, ties):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(60, 10, n), r.integers(0, 2, n), r.normal(0, 1, n)])
    t = r.exponential(np.exp(-(0.03 * (x[:, 0] - 60) + 0.5 * x[:, 1])) * 10)
    t = np.ceil(t) if ties else t
    return t, (r.random(n) < 0.7).astype(float), x


def efron(t, e, x, beta):
    """Log likelihood, gradient and second derivatives, a tie's place at a time."""
    p, value = x.shape[1], 0.0
    slope, info = np.zeros(p), np.zeros((p, p))
    w = np.exp(x @ beta)
    for at in np.unique(t[e > 0]):
        risk, dead = t >= at, (t == at) & (e > 0)
        value += (x[dead] @ beta).sum()
        slope += x[dead].sum(0)
        for place in range(dead.sum()):
            v = w * (risk - place / dead.sum() * dead)
            z = (v[:, None] * x).sum(0) / v.sum()
            value -= np.log(v.sum())
            slope -= z
            info += (v[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / v.sum() - np.outer(z, z)
    return value, slope, info


def frame(spark, t, e, x):
    return spark.createDataFrame([(float(a), float(b), *map(float, c)) for a, b, c in zip(t, e, x)], "duration double, event double, " + ", ".join(f"x{i} double" for i in range(x.shape[1]))).repartition(4)


@pytest.mark.parametrize("ties,block", [(False, 4096), (True, 4096), (True, 3)])
def test_fit_equals_numpy(spark, monkeypatch, ties, block):
    monkeypatch.setattr(HZ, "TIE_BLOCK", block)  # ties are split among rows
    t, e, x = table(1, 120, ties)
    fit = HZ.fit_hazards(frame(spark, t, e, x), ["x0", "x1", "x2"])
    mean = x.mean(0)
    beta = np.zeros(3)
    for _ in range(30):
        _, slope, info = efron(t, e, x - mean, beta)
        beta = beta + np.linalg.solve(info, slope)
    value, _, info = efron(t, e, x - mean, beta)
    assert fit.converged and (fit.n, fit.events) == (120, int(e.sum()))
    assert np.allclose(fit.coefficients, beta, rtol=1e-8, atol=1e-9)
    assert np.allclose(fit.errors, np.sqrt(np.diag(np.linalg.inv(info))), rtol=1e-8)
    assert abs(fit.log_likelihood - value) < 1e-8 * abs(value)
    assert abs(fit.null_log_likelihood - efron(t, e, x - mean, np.zeros(3))[0]) < 1e-8 * abs(value)
    rows = fit.summary(spark).orderBy("covariate").collect()
    assert [r.covariate for r in rows] == ["x0", "x1", "x2"] and all(r.lower_95 < r.coefficient < r.upper_95 for r in rows)


def test_baseline_without_covariates_is_the_event_time_table(spark):
    df = frame(spark, *table(2, 90, True))
    fit = HZ.fit_hazards(df, [])
    key = lambda rows: [(r.duration, round(r.hazard, 10), round(r.cumulative_hazard, 10), round(r.survival, 10)) for r in rows]
    assert fit.converged and key(HZ.baseline_hazard(df, fit).orderBy("duration").collect()) == key(U.event_time_table(df).orderBy("duration").collect())


def test_awkward_tables(spark):
    df = frame(spark, *table(3, 40, True))
    known = HZ.fit_hazards(df, ["x0"])
    more = df.withColumn("same", F.lit(0.1)).unionByName(spark.createDataFrame([(None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, None), (float("nan"), 1.0, 1.0)], "duration double, event double, x0 double"), allowMissingColumns=True)
    fit = HZ.fit_hazards(more.withColumn("same", F.lit(0.1)), ["same", "x0"])
    assert fit.n == 40 and fit.coefficients[0] == 0.0 and fit.errors[0] is None
    assert fit.coefficients[1] == pytest.approx(known.coefficients[0], rel=1e-9)
    for none in (df.limit(0), df.withColumn("event", F.lit(0.0))):
        fit = HZ.fit_hazards(none, ["x0"])
        assert fit.converged and fit.events == 0 and fit.log_likelihood == 0.0 and fit.coefficients == [0.0] and fit.errors == [None]
        row = HZ.concordance(none, F.col("x0")).first()
        assert row.pairs == 0 and row.concordance is None
    assert HZ.baseline_hazard(df.limit(0), known).count() == 0


@pytest.mark.parametrize("ties", [False, True])
def test_concordance_equals_all_pairs(spark, ties):
    t, e, x = table(4, 130, ties)
    s = np.round(x[:, 2], 1)  # scores tie as well
    pairs = right = same = 0
    for i in np.flatnonzero(e):
        for j in range(len(t)):
            if t[j] > t[i] or (t[j] == t[i] and not e[j]):
                pairs, right, same = pairs + 1, right + (s[i] > s[j]), same + (s[i] == s[j])
    row = HZ.concordance(frame(spark, t, e, x), F.round("x2", 1)).first()
    assert (row.pairs, row.concordant, row.tied) == (pairs, right, same) and row.concordance == pytest.approx((right + same / 2) / pairs)
