"""Sampling and ranking: exact sizes, balanced folds, two-level ranks equal a global row_number."""
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlake.operators import ordered as O
from cohortlake.operators import sampling as S


def table(spark, n=5000):
    return spark.range(n).select(F.col("id").alias("row_id"),
                                 F.when(F.col("id") % 7 < 2, 1).otherwise(0).alias("y"))


def test_stratified_rank_equals_row_number(spark):
    df = table(spark)
    w = Window.partitionBy("y").orderBy(O.hash_key(42, "row_id"), "row_id")
    want = {r.row_id: r.rn for r in df.select("row_id", F.row_number().over(w).alias("rn")).collect()}
    got = {r.row_id: r._rank for r in O.stratified_rank(df, ["y"], "row_id", 42).collect()}
    assert got == want


def test_cap_exact_and_stratified(spark):
    df = table(spark)
    out = S.stratified_cap(df, "y", "row_id", 1000)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert sum(counts.values()) == 1000
    assert abs(counts[1] - 1000 * 2 / 7) <= 1
    assert S.stratified_cap(df, "y", "row_id", 10**9).count() == 5000
    assert S.stratified_cap(df, "y", "row_id", None).count() == 5000


def test_folds_balanced(spark):
    f = S.stratified_folds(table(spark), "y", "row_id")
    sizes = {}
    for r in f.groupBy("y", "fold").count().collect():
        sizes.setdefault(r.y, []).append(r["count"])
    for v in sizes.values():
        assert len(v) == 3 and max(v) - min(v) <= 1


def test_inner_folds_cover_training_rows(spark):
    f = S.stratified_folds(table(spark, 600), "y", "row_id")
    inner = S.inner_folds(f, "y", "row_id")
    assert inner.count() == 2 * 600
    assert inner.filter(F.col("outer_fold") == F.col("fold")).count() == 0


def test_holdout_size(spark):
    h = S.holdout_split(table(spark, 901), "y", "row_id")
    assert h.filter("split = 'test'").count() == math.ceil(0.2 * 901)


def test_weights(spark):
    w = {r.y: r.weight for r in S.balanced_weights(table(spark, 700), "y").collect()}
    assert abs(w[1] - 700 / (2 * 200)) < 1e-12 and abs(w[0] - 700 / (2 * 500)) < 1e-12


def test_cumulative_before_descending(spark):
    df = spark.createDataFrame([(0.1, 1), (0.5, 2), (0.9, 3), (1.0, 4)], "k double, m long")
    got = {r.k: r.m_before for r in O.cumulative_before(df, "k", ["m"], O.prob_bucket(F.col("k")),
                                                          descending=True).collect()}
    assert got == {1.0: 0, 0.9: 4, 0.5: 7, 0.1: 9}
