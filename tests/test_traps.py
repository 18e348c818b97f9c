"""Rows that the cyclic fixtures don't hold: repeated cases, missing attributes, odd numbers, tiny scores, small groups."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import text as T
from cohortlake.operators import cohort as E
from cohortlake.operators import evaluate as V
from cohortlake.operators import ordered as O
from cohortlake.operators import oversample as OV
from cohortlake.operators import uncertainty as U
from cohortlake.sources import readers as RD


def test_pivot_drops_rows_without_attribute(spark):
    rows = [("s1", "p", "x", None, "9", 1), ("s2", "p", "x", "AGE_AT_SEQ_REPORTED_YEARS", "60", 2), ("s2", "p", "x", None, "1", 3)]
    got = E.eav_pivot(spark.createDataFrame(rows, "sample_id string, patient_id string, study_id string, attr string, value string, seq long")).collect()
    assert [(r.sample_id, r.AGE_AT_SEQ_REPORTED_YEARS) for r in got] == [("s2", "60")]


def test_repeated_case_documents_are_one_case(spark):
    schema = "case_id string, follow_ups array<struct<ecog_performance_status:string,karnofsky_performance_status:string>>, diagnoses array<struct<prior_treatment:string>>"
    rows = [("c1", [("1", "80")], [("No",)]), ("c1", [("2", None)], [("Yes",)]), (None, [("4", "10")], None), ("", [("4", "10")], None), ("c2", None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = {r.case_id: (r.ecog_max, r.karnofsky_max, r.prior_treatment) for r in E.case_document_values(docs).collect()}
    assert got == {"c1": (2.0, 80.0, 1.0), "c2": (None, None, None)}
    cases = spark.createDataFrame([("c1",), ("c3",)], "id string")
    assert E.lookup_join(cases, E.case_document_values(docs), "id", "case_id", ["ecog_max"]).count() == 2


def test_payload_numbers_are_whole_numbers_of_text(spark):
    df = spark.createDataFrame([("12d", "7f"), ("nan", "Infinity"), ("61.9", "1e1"), ("", None)], "age string, tumor_size_mm string")
    got = T.normalize_payload(df).select("age", "tumor_size_mm").collect()
    default = T.normalize_payload(spark.createDataFrame([(None,)], "x string")).select("age", "tumor_size_mm").first()
    assert [tuple(r) for r in got] == [tuple(default), tuple(default), (61, 10.0), tuple(default)]
    with pytest.raises(Exception, match="not a number"):
        T.normalize_payload(df, on_invalid="fail").collect()


def test_categorical_sentinels_are_missing(spark):
    df = spark.createDataFrame([("nan", float("nan"), "3"), ("Male", 1.5, "x")], "sex string, tumor_size_mm double, age string")
    assert [tuple(r) for r in T.coerce_feature_types(df).collect()] == [(None, None, 3.0), ("Male", 1.5, None)]


def test_readiness_report_without_labels_counts_zero(spark):
    df = spark.createDataFrame([("SEER", None, None)], "source string, mortality_1yr double, response double")
    r = E.readiness_report(df).first()
    assert (r.total_rows_harmonized, r.rows_mortality_ready, r.rows_response_ready) == (1, 0, 0)


def test_panel_without_sample_id_has_no_sample_flag(spark):
    rows = [(None, "p1", "EGFR"), ("s1", "p1", "KRAS"), (None, None, "EGFR")]
    df = spark.createDataFrame(rows, "sample_id string, patient_id string, gene string")
    samples, patients = E.mutation_flags(df)
    assert [r.sample_id for r in samples.collect()] == ["s1"] == [r.sample_id for r in E.sample_mutation_flags(df).collect()]
    assert {r.patient_id: r.egfr_mutation for r in patients.collect()} == {"p1": "Exon19del"} == {r.patient_id: r.egfr_mutation for r in E.patient_mutation_flags(df).collect()}


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(40):
        d = tmp_path / f"study{i}"
        d.mkdir()
        cols = "sampleId,clinicalAttributeId,value" + (",extra" if i % 2 else "") if i != 7 else "sampleId,value"
        (d / "clinical_data.csv").write_text(cols + "\n" + ",".join("abcd"[:cols.count(",") + 1]) + "\n")
    tracker, group = spark.sparkContext.statusTracker(), "headers"
    spark.sparkContext.setJobGroup(group, group)
    found = RD.files_with_columns(spark, f"{tmp_path}/*/clinical_data.csv", RD.STUDY_REQUIRED)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(len(v) for v in found.values()) == [19, 20] and jobs <= 4
    assert RD.read_study_tables(spark, str(tmp_path)).count() == 39
    assert RD.files_with_columns(spark, f"{tmp_path}/none/*.csv", ["a"]) == {}


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e9])
def test_buckets_spread_scores_of_any_scale(spark, scale):
    x = np.sort(np.random.default_rng(1).random(5000)) * scale
    fn = O.prob_bucket if scale < 1 else O.signed_log_bucket
    b = [r.b for r in spark.createDataFrame([(float(v),) for v in x], "x double").orderBy("x").select(fn(F.col("x")).alias("b")).collect()]
    assert b == sorted(b) and max(np.unique(b, return_counts=True)[1]) <= 0.05 * len(x)


def test_buckets_are_monotone_over_signs_and_ends(spark):
    xs = [-1e300, -5.0, -1e-300, 0.0, 1e-300, 0.3, 0.5, 0.5000001, 0.999999999, 1.0, 7.0, 1e300]
    df = spark.createDataFrame([(v,) for v in xs], "x double").orderBy("x")
    for fn in (O.signed_log_bucket, O.prob_bucket, O.duration_bucket):
        b = [r.b for r in df.select(fn(F.col("x")).alias("b")).collect()]
        assert b == sorted(b)


def test_auc_of_tiny_scores(spark):
    rng = np.random.default_rng(2)
    p, y = rng.random(400) * 1e-7, (rng.random(400) < 0.3).astype(int)
    got = V.roc_auc(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")).first().auc
    pos, neg = p[y == 1], p[y == 0]
    assert got == pytest.approx((pos[:, None] > neg[None, :]).mean())


def test_event_table_of_a_small_sample(spark):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(1, 6)], "duration double, event double")
    assert U.event_time_table(df).count() == 5 and U.event_time_table(df, min_rows=100).count() == 0


def test_neighbours_in_groups_smaller_than_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(0, 10.0 ** (i % 4), 3)], "small" if i < 4 else "one" if i == 4 else "large") for i in range(60)]
    got = OV.knn_exact(spark.createDataFrame(rows, "id long, v array<double>, g string"), "id", "v", k=5, by="g").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.nn_rank, r.nn_id))
    for i, v, g in rows:
        others = sorted((float(np.linalg.norm(np.subtract(v, w))), j) for j, w, h in rows if h == g and j != i)[:5]
        assert [n for _, n in sorted(by.get(i, []))] == [j for _, j in others]
