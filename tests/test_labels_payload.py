"""Labels (D1-D3) and payload typing."""
from pyspark.sql import functions as F

from cohortlake.functions import labels as L
from cohortlake.functions import text as T
from cohortlake.functions.catalog import FEATURES


def test_registry_mortality(spark):
    df = spark.createDataFrame([("6", "Dead"), ("13", "Dead"), ("12", "Alive"), ("5", "Alive"), ("NA", "Dead"),
                                ("12", None)], "s string, v string")
    got = [r[0] for r in df.select(L.registry_mortality(F.col("s"), F.col("v"))).collect()]
    assert got == [1.0, 0.0, 0.0, None, None, None]


def test_case_mortality_and_response(spark):
    df = spark.createDataFrame([("Dead", 100.0, None), ("Dead", None, 400.0), ("Alive", None, 365.0),
                                (None, None, 500.0), ("Alive", None, 10.0)], "v string, d double, f double")
    got = [r[0] for r in df.select(L.case_mortality(F.col("v"), F.col("d"), F.col("f"))).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0, None]
    r = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (0, 0, "TF-Tumor Free"), (0, 0, "nothing")],
                              "tf int, wt int, t string")
    got = [x[0] for x in r.select(L.case_response(F.col("tf"), F.col("wt"), F.col("t"))).collect()]
    assert got == [0.0, 1.0, 1.0, None]


def test_normalize_payload_defaults_and_truncation(spark):
    df = spark.createDataFrame([("1.9", "", "junk"), ("-1.9", None, "12.5")], "age string, sex string, tumor_size_mm string")
    out = T.normalize_payload(df).collect()
    assert out[0]["age"] == 1 and out[1]["age"] == -1
    assert out[0]["sex"] == "Male" and out[1]["sex"] == "Male"
    assert out[0]["tumor_size_mm"] == 35.0 and out[1]["tumor_size_mm"] == 12.5
    assert out[0]["egfr_mutation"] == "Wild_type"  # absent column -> default


def test_constraints(spark):
    df = spark.createDataFrame([(95.0, "T2A", 3.0), (50.0, "T9", 0.0)], "age double, t_stage string, mets_lung_dx double")
    v = [sorted(r[0]) for r in df.select(T.constraint_violations(FEATURES, present=df.columns)).collect()]
    assert v == [["age:range", "mets_lung_dx:choice"], ["t_stage:choice"]]


def test_score_payload_single_row(spark):
    from cohortlake.operators import serve as J
    from cohortlake.plans.queries import MORTALITY_SCORER, RESPONSE_SCORER
    r = J.score_payload(spark, {"age": "70", "cancer_stage": "IV", "drug_name": " "}, RESPONSE_SCORER,
                        MORTALITY_SCORER).collect()[0]
    assert r.drug_name == "Cisplatin" and 0 < r.probability < 1 and r.label.endswith("response expected")
    assert r.mortality_label in ("Higher mortality risk", "Lower mortality risk")


def test_normalize_fail_mode_raises(spark):
    import pytest
    from pyspark.errors import PySparkException
    df = spark.createDataFrame([("abc",)], "age string")
    with pytest.raises((PySparkException, Exception)):
        T.normalize_payload(df, on_invalid="fail").collect()


def test_coverage_matches_published_report(spark):
    """Published coverage figures: 585,148 rows; age 582,371 -> 99.53 %, performance_status 568 -> 0.1 %,
    egfr_mutation 4,512 -> 0.77 %, response 901 -> 0.15 %."""
    from cohortlake.operators import cohort as E
    n = 585148
    df = spark.range(n).select(
        F.when(F.col("id") < 582371, 60.0).alias("age"),
        F.when(F.col("id") < 568, 1.0).alias("performance_status"),
        F.when(F.col("id") < 4512, "Wild_type").alias("egfr_mutation"),
        F.when(F.col("id") < 901, 1.0).alias("response"))
    got = {r.column: (r.non_null, r.coverage_pct) for r in E.coverage(df, df.columns).collect()}
    assert got == {"age": (582371, 99.53), "performance_status": (568, 0.1), "egfr_mutation": (4512, 0.77),
                   "response": (901, 0.15)}
