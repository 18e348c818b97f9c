"""Selection and scoring helpers."""
import pytest
from pyspark.sql import functions as F

from cohortlake.functions.catalog import FEATURE_ORDER
from cohortlake.operators import serve as J


def test_report_features_last_note_wins(spark):
    runs = spark.createDataFrame([("t", ["x=1", "dropped_features=age,sex", "dropped_features=egfr_mutation,"]),
                                  ("u", None), ("v", [])], "task string, notes array<string>")
    r = {x.task: x for x in J.report_features(runs).collect()}
    assert r["t"].dropped_features == ["egfr_mutation"]
    assert r["t"].used_features == [f for f in FEATURE_ORDER if f != "egfr_mutation"]
    assert r["v"].dropped_features == [] and r["v"].used_features == FEATURE_ORDER


def test_decision_threshold_bounds(spark):
    df = spark.createDataFrame([(0.38,), (1.7,), (None,), (-0.1,)], "t double")
    assert [r[0] for r in df.select(J.decision_threshold(F.col("t"))).collect()] == [0.38, 0.5, 0.5, 0.5]


def test_shared_and_active_features(spark):
    df = spark.createDataFrame([(["age", "sex", "histology"], ["sex", "age"], ["tumor_size_mm", "sex", "age",
                                                                               "mets_lung_dx"])],
                               "r array<string>, m array<string>, extras array<string>")
    row = df.select(J.shared_features(F.col("r"), F.col("m")).alias("s")).first()
    assert row.s == ["age", "sex"]  # catalog order
    act = df.select(J.active_features(J.shared_features(F.col("r"), F.col("m")), F.col("extras"), k=1)).first()[0]
    assert act == ["age", "sex", "tumor_size_mm"]
    empty = spark.createDataFrame([([], ["age"])], "r array<string>, m array<string>")
    assert empty.select(J.shared_features(F.col("r"), F.col("m"))).first()[0] == FEATURE_ORDER


def test_input_completeness_and_rejection(spark):
    batch = spark.createDataFrame([("70", None), ("", "Male")], "age string, sex string")
    got = {r.feature: r for r in J.input_completeness(batch, ["age", "sex", "histology"]).collect()}
    assert (got["age"].n_supplied, got["age"].n_defaulted) == (1, 1)
    assert got["histology"].column_present is False and got["histology"].n_defaulted == 2
    with pytest.raises(ValueError):
        J.input_completeness(batch, ["histology"])


def test_confidence_levels(spark):
    df = spark.createDataFrame([(0.95,), (0.27,), (0.55,)], "p double")
    c = J.confidence_columns(F.col("p"))
    rows = df.select(c["confidence"], c["confidence_level"]).collect()
    assert [tuple(r) for r in rows] == [("95.0%", "High"), ("73.0%", "Medium"), ("55.0%", "Low")]


def test_availability_gate_messages(spark):
    batch = spark.createDataFrame([("70",)], "age string")
    r = J.score_batch(batch, None, None, keep=(), load_errors={"response": ["a: x", "b: y", "c: z"]}).first()
    assert r.label == "Model not trained" and r.probability is None
    assert "Response load: a: x; b: y." in r.mortality_message and "Mortality load: none." in r.mortality_message
