"""End-to-end harmonization over files in the source formats (BOM, quoted headers, JSON array, nested panels)."""
import json
import os
import tempfile

from cohortlake.plans import harmonize as H


def write(path, text, bom=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8") as fh:
        fh.write(text)


def test_run_harmonization_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="cl-run-")
    write(f"{d}/seer/exportnew.csv",
          '"Age recode with <1 year olds and 90+","Sex","Survival months","Vital status recode (study cutoff used)",'
          '"Derived AJCC Stage Group, 7th ed (2010-2015)"\n'
          '"60-64 years","Male","5","Dead","Stage IIIA"\n'
          '"90+ years","Female","24","Alive","IV"\n'
          '"Unknown","","NA","Alive",""\n', bom=True)
    write(f"{d}/gdc/cases.csv",
          "case_id,submitter_id,project_id,gender,primary_diagnosis,tumor_stage,age_at_diagnosis_days,vital_status,"
          "days_to_death,days_to_last_follow_up,ecog_worst,karnofsky_best,tf_tumor_free_count,wt_with_tumor_count,"
          "best_disease_response\n"
          "c1,S1,TCGA-LUAD,female,Adenocarcinoma,stage ia,21915,Dead,200,,,,1,0,\n"
          "c2,S2,,male,Squamous cell,stage iv,25000,Alive,,400,,,0,1,\n")
    write(f"{d}/gdc/cases.json", json.dumps([
        {"case_id": "c1", "follow_ups": [{"ecog_performance_status": "1", "karnofsky_performance_status": "90"}],
         "diagnoses": [{"prior_treatment": "Yes"}]},
        {"case_id": "c2", "follow_ups": None, "diagnoses": [{"prior_treatment": "no"}]}]), bom=True)
    write(f"{d}/cbio/study1/clinical_data.csv",
          "sampleId,patientId,studyId,clinicalAttributeId,value\n"
          "T1,P1,study1,AGE_AT_SEQ_REPORTED_YEARS,61\nT1,P1,study1,PATHOLOGIC_STAGE,Stage IB\n"
          "T2,P2,study1,OTHER,x\n")
    write(f"{d}/cbio/study2/clinical_data.csv", "foo,bar\n1,2\n")
    write(f"{d}/cbio/study1/deep/mutations_panel_x_mutations.csv",
          "sampleId,patientId,gene\nT1,S1,hugoGeneSymbol=EGFR;id=1956\nT2,S2,KRAS\n")
    out = H.run_harmonization(spark, registry_paths=[f"{d}/seer/missing.csv", f"{d}/seer/exportnew.csv"],
                              case_table=f"{d}/gdc/cases.csv", case_documents=f"{d}/gdc/cases.json",
                              study_base=f"{d}/cbio", panel_base=f"{d}/cbio", out_dir=f"{d}/out")
    rows = {r.row_id: r for r in out["cohort"].collect()}
    seer = [r for r in rows.values() if r.source == "SEER"]
    assert len(seer) == 2  # the all-unknown registry row has no useful feature
    assert sorted(r.age for r in seer) == [62.0, 92.0]
    assert sorted(r.mortality_1yr for r in seer) == [0.0, 1.0]
    c1 = rows["GDC:c1"]
    assert c1.sex == "Female" and c1.performance_status == 1.0 and c1.chemotherapy_cycles == 1.0
    assert c1.egfr_mutation == "Exon19del" and c1.mortality_1yr == 1.0 and c1.response == 1.0
    c2 = rows["GDC:c2"]
    assert c2.source_study == "GDC" and c2.egfr_mutation == "Wild_type" and c2.response == 0.0
    t1 = [r for r in rows.values() if r.sample_id == "T1"][0]
    assert t1.age == 61.0 and t1.cancer_stage == "IB" and t1.egfr_mutation == "Exon19del"
    t2 = [r for r in rows.values() if r.sample_id == "T2"][0]
    assert t2.egfr_mutation == "Wild_type" and t2.age is None
    rep = spark.read.json(out["reports"]["readiness"]).first()
    assert rep.total_rows_harmonized == len(rows) == 6
    assert rep.source_counts.SEER == 2 and rep.source_counts.GDC == 2 and rep.source_counts.cBio == 2
