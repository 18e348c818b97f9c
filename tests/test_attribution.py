"""Attribution: the permutation-sampled estimate equals the closed form on a linear scorer."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import attribution as A
from cohortlake.operators.serve import LinearScorer


def test_sampled_shapley_matches_linear_closed_form(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal(60, 8)), float(rng.normal(30, 10))) for i in range(64)]
    df = spark.createDataFrame(rows, "row_id long, age double, tumor_size_mm double")
    scorer = LinearScorer(intercept=-1.0, numeric={"age": 0.03, "tumor_size_mm": -0.02})
    closed = {r.feature: r.mean_abs for r in A.linear_attribution(df, scorer).collect()}
    means = df.agg(F.avg("age").alias("age"), F.avg("tumor_size_mm").alias("tumor_size_mm")).first().asDict()
    est = A.sampled_shapley(df, means, ["age", "tumor_size_mm"],
                            lambda d: d.withColumn("_score", scorer.logit()), n_perm=4)
    got = {r.feature: r.mean_abs for r in est.collect()}
    for f in closed:
        assert got[f] == pytest.approx(closed[f], rel=1e-9)
