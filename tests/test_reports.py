"""Value counts (NULL group kept) and the nested readiness report from grouping-sets aggregates."""
from cohortlake.operators import cohort as E


def cohort(spark):
    rows = [("SEER", 1.0, None), ("SEER", 0.0, None), ("SEER", None, None), ("GDC", 1.0, 0.0), ("GDC", None, 1.0),
            ("cBio", None, None)]
    return spark.createDataFrame(rows, "source string, mortality_1yr double, response double")


def test_value_counts_keep_null_group(spark):
    got = {(r.column, r.value): r.n for r in E.value_counts(cohort(spark), ["source", "mortality_1yr", "response"]).collect()}
    assert got == {("source", "SEER"): 3, ("source", "GDC"): 2, ("source", "cBio"): 1,
                   ("mortality_1yr", "1.0"): 2, ("mortality_1yr", "0.0"): 1, ("mortality_1yr", None): 3,
                   ("response", "0.0"): 1, ("response", "1.0"): 1, ("response", None): 4}


def test_readiness_report_shape(spark):
    r = E.readiness_report(cohort(spark)).first()
    assert (r.total_rows_harmonized, r.rows_mortality_ready, r.rows_response_ready) == (6, 3, 2)
    assert r.source_counts == {"SEER": 3, "GDC": 2, "cBio": 1}
    assert r.mortality_label_counts == {"0.0": 1, "1.0": 2}
    assert r.response_label_counts == {"0.0": 1, "1.0": 1}
    flat = E.readiness(cohort(spark)).first()
    assert (flat.rows_seer, flat.rows_gdc, flat.rows_cbio, flat.mortality_pos, flat.response_neg) == (3, 2, 1, 2, 1)
