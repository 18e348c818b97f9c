"""Scans: BOM'd JSON array, first existing path, header checks, corrupt reports."""
import json
import os
import tempfile

from pyspark.sql import types as T

from cohortlake.operators import cohort as E
from cohortlake.sources import readers as RD


def test_case_documents_bom_array(spark):
    d = tempfile.mkdtemp(prefix="cl-json-")
    docs = [{"case_id": "c1", "follow_ups": [{"ecog_performance_status": "2", "karnofsky_performance_status": "80"},
                                             {"ecog_performance_status": "x", "karnofsky_performance_status": None}],
             "diagnoses": [{"prior_treatment": "No"}, {"prior_treatment": " yes "}]},
            {"case_id": "c2", "follow_ups": None, "diagnoses": [{"prior_treatment": "no"}]}]
    with open(os.path.join(d, "cases.json"), "w", encoding="utf-8-sig") as fh:
        json.dump(docs, fh)
    df = RD.read_case_documents(spark, d)
    m = {r.case_id: r for r in E.follow_up_maxima(df).collect()}
    assert m["c1"].ecog_max == 2.0 and m["c1"].karnofsky_max == 80.0 and m["c2"].ecog_max is None
    p = {r.case_id: r.prior_treatment for r in E.prior_treatment_flag(df).collect()}
    assert p == {"c1": 1.0, "c2": 0.0}


def test_first_existing_and_missing(spark):
    d = tempfile.mkdtemp(prefix="cl-csv-")
    with open(os.path.join(d, "a.csv"), "w") as fh:
        fh.write("Sex,Survival months\nMale,NA\nNULL,3\n")
    df = RD.first_existing_csv(spark, [os.path.join(d, "nope.csv"), os.path.join(d, "a.csv")])
    rows = df.collect()
    assert rows[0]["Survival months"] is None and rows[1]["Sex"] is None
    assert RD.first_existing_csv(spark, [os.path.join(d, "nope.csv")]) is None


def test_study_files_skip_bad_header(spark):
    d = tempfile.mkdtemp(prefix="cl-study-")
    for study, header in (("s1", "sampleId,patientId,studyId,clinicalAttributeId,value"), ("s2", "foo,bar")):
        os.makedirs(os.path.join(d, study))
        with open(os.path.join(d, study, "clinical_data.csv"), "w") as fh:
            fh.write(header + "\n" + ("S1,P1,s1,AGE_AT_SEQ_REPORTED_YEARS,61\n" if study == "s1" else "1,2\n"))
    df = RD.read_study_tables(spark, d)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].study_dir == "s1" and rows[0].value == "61"


def test_reports_corrupt_and_missing(spark):
    d = tempfile.mkdtemp(prefix="cl-rep-")
    with open(os.path.join(d, "good.json"), "w") as fh:
        json.dump({"task": "mortality", "algorithm": "lightgbm", "outer_mean": {"auc": 0.81}}, fh, indent=2)
    with open(os.path.join(d, "bad.json"), "w") as fh:
        fh.write("{ not json")
    schema = T.StructType([T.StructField("task", T.StringType()), T.StructField("algorithm", T.StringType()),
                           T.StructField("outer_mean", T.StructType([T.StructField("auc", T.DoubleType())]))])
    rows = RD.read_reports(spark, d, schema).collect()
    assert [(r.task, r.outer_mean.auc) for r in rows] == [("mortality", 0.81)]
    assert RD.read_reports(spark, os.path.join(d, "missing"), schema).count() == 0
