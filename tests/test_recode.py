"""Rule-table recoders: documented cases, legacy vs corrected order, null tokens."""
import pytest
from pyspark.sql import functions as F

from cohortlake.functions import recode as R
from cohortlake.functions import text as T


def run(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x")).alias("y")).collect()]


def test_clean_text_tokens_and_whitespace(spark):
    got = run(spark, T.clean_text, [" a ", "\tb\n", "", "  ", "NaN", "na", "Not Available", "[Not Available]",
                                    "UNKNOWN", None, "n/a"])
    assert got == ["a", "b", None, None, None, None, None, None, None, None, "n/a"]


def test_to_number_is_lenient(spark):
    got = run(spark, T.to_number, ["12", " 3.5 ", "1e3", ".5", "-2", "12d", "abc", "NaN", "", None])
    assert got == [12.0, 3.5, 1000.0, 0.5, -2.0, None, None, None, None, None]


def test_age_recode(spark):
    got = run(spark, R.age_recode, ["60-64 years", "90+ years", "00 years", "72", "Unknown", "abc", None])
    assert got == [62.0, 92.0, 0.0, 72.0, None, None, None]


@pytest.mark.parametrize("legacy,expected", [(True, ["Male", "Male", "Male", "Intersex"]),
                                             (False, ["Male", "Female", "Female", "Intersex"])])
def test_sex_female_overlap(spark, legacy, expected):
    got = run(spark, lambda c: R.sex_recode(c, legacy), ["Male", "FEMALE", " female ", "Intersex"])
    assert got == expected


def test_stage(spark):
    assert run(spark, lambda c: R.stage_recode(c, True), ["Stage IIIA", "stage  I B", "Stage", "STAGE IIB"]) == \
        ["IIIA", "IB", None, "STAGEIIB"]
    assert run(spark, lambda c: R.stage_recode(c, False), ["STAGE IIB", "Stage"]) == ["IIB", None]


def test_histology_non_small(spark):
    vals = ["Adenocarcinoma, NOS", "Non-small cell carcinoma", "Small cell", "Large cell", "8140"]
    assert run(spark, lambda c: R.histology_recode(c, True), vals) == \
        ["Adenocarcinoma", "Small_cell", "Small_cell", "Large_cell", "8140"]
    assert run(spark, lambda c: R.histology_recode(c, False), vals) == \
        ["Adenocarcinoma", "Non-small cell carcinoma", "Small_cell", "Large_cell", "8140"]


def test_race_caucasian(spark):
    assert run(spark, lambda c: R.race_recode(c, True), ["Caucasian", "Multi", "Unknown race"]) == \
        ["Asian_or_Pacific_Islander", "Other", "Unknown"]
    assert run(spark, lambda c: R.race_recode(c, False), ["Caucasian", "Asian"]) == ["Other", "Asian_or_Pacific_Islander"]


def test_marital_order(spark):
    vals = ["Single (never married)", "Unmarried or Domestic Partner", "Married (including common law)"]
    assert run(spark, lambda c: R.marital_recode(c, True), vals) == ["Married", "Married", "Married"]
    assert run(spark, lambda c: R.marital_recode(c, False), vals) == ["Single", "Unmarried_partner", "Married"]


def test_radiation_combination(spark):
    vals = ["Combination of beam with implants", "None/Unknown", "Recommended, unknown if given", "x"]
    assert run(spark, lambda c: R.radiation_recode(c, True), vals) == \
        ["Beam_radiation", "None_or_Unknown", "Recommended_unknown", "Other"]
    assert run(spark, lambda c: R.radiation_recode(c, False), vals)[0] == "Combination_radiation"


def test_tnm_three_digit_yes_no_gene(spark):
    assert run(spark, R.tnm_recode, ["t 1b", "Blank(s)", "N/A"]) == ["T1B", "Unknown", "Unknown"]
    assert run(spark, R.three_digit_number, ["035", "999", "1000", "Unable to calculate"]) == [35.0, None, 100.0, None]
    assert run(spark, R.yes_no, ["Yes, distant", "No/Unknown", "Unknown", "maybe"]) == [1.0, 0.0, None, None]
    assert run(spark, R.gene_symbol, ["hugoGeneSymbol=EGFR;id=1956", "tp53", "kras", "123", "NA"]) == \
        ["EGFR", None, "KRAS", None, None]
