"""Harmonization plan: three differently shaped sources -> one canonical cohort table.

The registry path (the dominant source) is a map-only projection; the case
and study paths add small keyed aggregates joined by key.  The whole thing
is one lazy plan; persist it once (``sources.writers.write_cohort``) and
derive the reports from the readback.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import recode as R
from ..functions.catalog import REGISTRY_COLUMNS, conform
from ..functions.text import clean_text, to_number
from ..operators import cohort as E

# --- fixed values: source tags ---------------------------------------------------
REGISTRY_SOURCE, REGISTRY_STUDY = "SEER", "SEER_LUNG_EXPORTNEW"
CASE_SOURCE, CASE_STUDY_DEFAULT = "GDC", "GDC"
STUDY_SOURCE = "cBio"
# --- end of fixed values --------------------------------------------------------


def registry_cohort(df: DataFrame, mapping: Mapping[str, str] = REGISTRY_COLUMNS,
                    legacy: bool = False, id_col: str | None = "row_id") -> DataFrame:
    """A1 output -> canonical rows.

    A source column absent from ``df`` gives an all-NULL canonical column.
    """
    # Stage 1 projects each source column's cleaned text once; stage 2 recodes it.
    # The optimizer keeps the two projections apart (the cleaned text is reused
    # by many rules), which keeps each generated method small.
    present = {k: n for k, n in mapping.items() if n in df.columns}
    raw_keys = ("survival_months", "vital_status")
    rid = (F.col(id_col).cast("string") if id_col and id_col in df.columns
           else F.monotonically_increasing_id().cast("string"))
    staged = df.select(rid.alias("_rid"),
                       *[(df[n] if k in raw_keys else clean_text(df[n])).alias(f"_t_{k}") for k, n in present.items()])

    def src(key: str) -> Column | None:
        return F.col(f"_t_{key}") if key in present else None

    def use(key: str, fn) -> Column:
        c = src(key)
        return fn(c) if c is not None else F.lit(None)

    size_parts = [R.three_digit_number(c, cleaned=True) for c in (src("tumor_size_recode"), src("tumor_size_summary"))
                  if c is not None]
    surv, vital = src("survival_months"), src("vital_status")
    exprs = {
        "source": F.lit(REGISTRY_SOURCE),
        "source_study": F.lit(REGISTRY_STUDY),
        "age": use("age", lambda c: R.age_recode(c, cleaned=True)),
        "sex": use("sex", lambda c: R.sex_recode(c, legacy, cleaned=True)),
        "race_recode": use("race_recode", lambda c: R.race_recode(c, legacy, cleaned=True)),
        "marital_status": use("marital_status", lambda c: R.marital_recode(c, legacy, cleaned=True)),
        "histology": use("histology", lambda c: R.histology_recode(c, legacy, cleaned=True)),
        "cancer_stage": use("cancer_stage", lambda c: R.stage_recode(c, legacy, cleaned=True)),
        "t_stage": use("t_stage", lambda c: R.tnm_recode(c, cleaned=True)),
        "n_stage": use("n_stage", lambda c: R.tnm_recode(c, cleaned=True)),
        "m_stage": use("m_stage", lambda c: R.tnm_recode(c, cleaned=True)),
        "tumor_size_mm": F.coalesce(*size_parts) if size_parts else F.lit(None),
        "mets_lung_dx": use("mets_lung_dx", lambda c: R.yes_no(c, cleaned=True)),
        "chemotherapy_cycles": use("chemotherapy_cycles", lambda c: R.yes_no(c, cleaned=True)),
        "radiation_recode": use("radiation_recode", lambda c: R.radiation_recode(c, legacy, cleaned=True)),
        "treatment_delay_days": use("treatment_delay_days", lambda c: R.three_digit_number(c, cleaned=True)),
        "mortality_1yr": (L.registry_mortality(surv, vital) if surv is not None and vital is not None
                          else F.lit(None)),
    }
    return conform(staged.withColumn("row_id", F.concat(F.lit("SEER:"), F.col("_rid"))), exprs, extra=["row_id"])


def case_cohort(cases: DataFrame, nested: DataFrame | None = None, patient_flags: DataFrame | None = None,
                legacy: bool = False, ecog_col: str = "ecog_worst", karnofsky_col: str = "karnofsky_best") -> DataFrame:
    """A2/A3 output -> canonical rows."""
    df = cases
    ecog = to_number(F.col(ecog_col)) if ecog_col in cases.columns else F.lit(None).cast("double")
    karn = to_number(F.col(karnofsky_col)) if karnofsky_col in cases.columns else F.lit(None).cast("double")
    chemo = F.lit(None)
    egfr = F.lit(None)
    if nested is not None:
        nested_vals = E.case_document_values(nested)
        df = E.lookup_join(df, nested_vals, "case_id", "case_id", ["ecog_max", "karnofsky_max", "prior_treatment"])
        ecog, karn = E.column_fallbacks(cases, [(ecog, F.col("ecog_max")), (karn, F.col("karnofsky_max"))])
        chemo = F.col("prior_treatment")
    if patient_flags is not None:
        flags = patient_flags.select(F.col("patient_id").alias("_pid"), F.col("egfr_mutation").alias("_egfr"))
        df = E.lookup_join(df, flags, "submitter_id", "_pid", ["_egfr"])
        egfr = F.col("_egfr")
    g = lambda name: F.col(name) if name in cases.columns else F.lit(None)
    exprs = {
        "source": F.lit(CASE_SOURCE),
        "source_study": F.coalesce(g("project_id").cast("string"), F.lit(CASE_STUDY_DEFAULT)),
        "case_id": g("case_id").cast("string"),
        "age": E.days_to_years(g("age_at_diagnosis_days")),
        "sex": R.sex_recode(g("gender"), legacy),
        "histology": R.histology_recode(g("primary_diagnosis"), legacy),
        "cancer_stage": R.stage_recode(g("tumor_stage"), legacy),
        "performance_status": E.karnofsky_to_ecog(ecog, karn),
        "chemotherapy_cycles": chemo,
        "egfr_mutation": egfr,
        "mortality_1yr": L.case_mortality(g("vital_status"), g("days_to_death"), g("days_to_last_follow_up")),
        "response": L.case_response(g("tf_tumor_free_count"), g("wt_with_tumor_count"), g("best_disease_response")),
    }
    df = df.withColumn("row_id", F.concat(F.lit("GDC:"), g("case_id").cast("string")))
    return conform(df, exprs, extra=["row_id"])


def study_cohort(eav: DataFrame, sample_flags: DataFrame | None = None, legacy: bool = False) -> DataFrame:
    """A4 output -> canonical rows."""
    piv = E.eav_pivot(eav)
    egfr = F.lit(None)
    if sample_flags is not None:
        piv = E.lookup_join(piv, sample_flags.withColumnRenamed("egfr_mutation", "_egfr"),
                            "sample_id", "sample_id", ["_egfr"])
        egfr = F.col("_egfr")
    exprs = {
        "source": F.lit(STUDY_SOURCE),
        "source_study": F.col("study_id"),
        "case_id": F.col("patient_id"),
        "sample_id": F.col("sample_id"),
        "age": to_number(F.col("AGE_AT_SEQ_REPORTED_YEARS")),
        "histology": R.histology_recode(F.col("PREDOMINANT_HISTOLOGIC_SUBTYPE"), legacy),
        "cancer_stage": R.stage_recode(F.col("PATHOLOGIC_STAGE"), legacy),
        "egfr_mutation": egfr,
    }
    piv = piv.withColumn("row_id", F.concat_ws(":", F.lit("cBio"), "study_id", "patient_id", "sample_id"))
    return conform(piv, exprs, extra=["row_id"])


def harmonize(frames: list[DataFrame]) -> DataFrame:
    """E7 + D4: union of the canonical sources, rows with no useful feature dropped."""
    return L.keep_useful_rows(E.union_sources(frames))


def run_harmonization(spark, *, registry_paths, case_table: str | None, case_documents: str | None,
                      study_base: str | None, panel_base: str | None, out_dir: str,
                      study_pattern: str = "*/clinical_data.csv", legacy: bool = False,
                      documents_multi_line: bool = True) -> dict:
    """End-to-end harmonization: scan the three sources, build the cohort, write it and its reports.

    Steps: mutation panels -> sample/patient flags (one aggregate); registry
    export; case table + case documents; study EAV files; union + useful-row
    filter; write the cohort (partitioned by source), the per-task
    label-ready tables and the coverage / readiness reports, each derived
    from the written cohort.  Returns the output paths and the readback.
    """
    from ..sources import readers as RD
    from ..sources import writers as WR
    from ..functions.catalog import CANONICAL_COLUMNS

    frames = []
    samples = patients = None
    if panel_base:
        panels = RD.read_mutation_panels(spark, panel_base)
        samples, patients = E.mutation_flags(panels.select(F.col("sampleId").alias("sample_id"),
                                                           F.col("patientId").alias("patient_id"), "gene"))
    reg = RD.first_existing_csv(spark, registry_paths)
    if reg is not None:
        frames.append(registry_cohort(reg, legacy=legacy, id_col=None if "row_id" not in reg.columns else "row_id"))
    if case_table:
        cases = RD.first_existing_csv(spark, [case_table])
        if cases is not None:
            docs = RD.read_case_documents(spark, case_documents, documents_multi_line) if case_documents else None
            frames.append(case_cohort(cases, docs, patients, legacy=legacy))
    if study_base:
        eav = RD.read_study_tables(spark, study_base, study_pattern)
        eav = eav.select(F.col("sampleId").alias("sample_id"), F.col("patientId").alias("patient_id"),
                         F.col("studyId").alias("study_id"), F.col("clinicalAttributeId").alias("attr"), "value",
                         F.col("seq").cast("long").alias("seq") if "seq" in eav.columns
                         else F.monotonically_increasing_id().alias("seq"))
        frames.append(study_cohort(eav, samples, legacy=legacy))
    if not frames:
        from ..functions.catalog import empty_cohort
        frames = [empty_cohort(spark).withColumn("row_id", F.lit(None).cast("string"))]
    cohort = harmonize(frames)
    path = WR.write_cohort(cohort, f"{out_dir.rstrip('/')}/harmonized")
    written = spark.read.parquet(path).select("row_id", *CANONICAL_COLUMNS)
    tasks = WR.write_task_tables(written, out_dir)
    reports = WR.write_reports(E.coverage(written), E.readiness_report(written), f"{out_dir.rstrip('/')}/reports")
    return {"harmonized": path, "tasks": tasks, "reports": reports, "cohort": written}
