"""Registered queries: one per operator, each with its DuckDB oracle where SQL can express it.

Every query reads the driver's tables (through ``fixtures``), so its work
grows with the scale factor.  Real-valued outputs that depend on
summation order are rounded to 9 decimals on both sides.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import recode as R
from ..functions import text as T
from ..functions.catalog import LABEL_COLUMNS, USEFUL_FEATURES, FEATURE_ORDER
from ..operators import cohort as E
from . import fixtures as X
from . import harmonize as H
from . import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
DIGITS = 9


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _cte(**recipes: str) -> str:
    return "with " + ", ".join(f"{alias} as ({X.duck(name)})" for alias, name in recipes.items()) + " "


REG = _cte(r="registry_raw")

# ---------------------------------------------------------------- B: shaping

@query("text_cleaning", REG + f"select row_id, {O.clean('sex_raw')} as sex_clean, {O.clean('age_raw')} as age_clean, "
       f"{O.clean('hist_raw')} as hist_clean, {O.clean('chemo_raw')} as chemo_clean from r")
def q_text_cleaning(spark, sf):
    r = X.registry_raw(spark, sf)
    return r.select("row_id", T.clean_text("sex_raw").alias("sex_clean"), T.clean_text("age_raw").alias("age_clean"),
                    T.clean_text("hist_raw").alias("hist_clean"), T.clean_text("chemo_raw").alias("chemo_clean"))


@query("numeric_coercion", REG + f"select row_id, {O.num('survival_raw')} as survival_months, "
       f"{O.num('delay_raw')} as delay_days, {O.num('age_raw')} as age_number from r")
def q_numeric_coercion(spark, sf):
    r = X.registry_raw(spark, sf)
    return r.select("row_id", T.to_number("survival_raw").alias("survival_months"),
                    T.to_number("delay_raw").alias("delay_days"), T.to_number("age_raw").alias("age_number"))


@query("registry_canonical", REG + "select concat('SEER:', cast(row_id as varchar)) as row_id, 'SEER' as source, "
       "'SEER_LUNG_EXPORTNEW' as source_study, cast(null as varchar) as case_id, cast(null as varchar) as sample_id, "
       + O.registry_row() + " from r")
def q_registry_canonical(spark, sf):
    """B1 + B2 + B12 + C* + D1: registry export (real header names) -> 22 canonical columns."""
    return H.registry_cohort(X.registry_export(spark, sf))


@query("registry_canonical_legacy", REG + "select concat('SEER:', cast(row_id as varchar)) as row_id, 'SEER' as source, "
       "'SEER_LUNG_EXPORTNEW' as source_study, cast(null as varchar) as case_id, cast(null as varchar) as sample_id, "
       + O.registry_row(legacy=True) + " from r")
def q_registry_canonical_legacy(spark, sf):
    return H.registry_cohort(X.registry_export(spark, sf), legacy=True)


@query("registry_missing_columns", REG + "select concat('SEER:', cast(row_id as varchar)) as row_id, "
       f"{O.age('age_raw')} as age, cast(null as varchar) as sex, cast(null as double) as tumor_size_mm, "
       "cast(null as double) as mortality_1yr from r")
def q_registry_missing_columns(spark, sf):
    """B1/B2 tolerance: absent source columns become typed NULL columns."""
    exp = X.registry_export(spark, sf)
    from ..functions.catalog import REGISTRY_COLUMNS as RC
    keep = ["row_id", RC["age"], RC["vital_status"]]
    return H.registry_cohort(exp.select(*keep)).select("row_id", "age", "sex", "tumor_size_mm", "mortality_1yr")


@query("tumor_size_fallback", REG + f"select row_id, coalesce({O.three('tumor_raw')}, {O.three('tumor_summary_raw')}) "
       "as tumor_size_mm from r")
def q_tumor_size_fallback(spark, sf):
    """B12."""
    r = X.registry_raw(spark, sf)
    return r.select("row_id", F.coalesce(R.three_digit_number(F.col("tumor_raw")),
                                         R.three_digit_number(F.col("tumor_summary_raw"))).alias("tumor_size_mm"))


# ---------------------------------------------------------------- C: recoders

def _recode_query(name: str, col: str, fn, ofn, legacy_variant: bool):
    for legacy in ([False, True] if legacy_variant else [False]):
        qname = name + ("_legacy" if legacy else "")
        osql = REG + f"select row_id, {col}, " + (f"{ofn(col, legacy)}" if legacy_variant else f"{ofn(col)}") + \
            f" as {name.removeprefix('recode_')} from r"

        def run(spark, sf, _legacy=legacy):
            r = X.registry_raw(spark, sf)
            out = fn(F.col(col), _legacy) if legacy_variant else fn(F.col(col))
            return r.select("row_id", col, out.alias(name.removeprefix("recode_")))
        query(qname, osql)(run)


_recode_query("recode_age", "age_raw", R.age_recode, O.age, False)
_recode_query("recode_sex", "sex_raw", R.sex_recode, O.sex, True)
_recode_query("recode_stage", "stage_raw", R.stage_recode, O.stage, True)
_recode_query("recode_histology", "hist_raw", R.histology_recode, O.histology, True)
_recode_query("recode_race", "race_raw", R.race_recode, O.race, True)
_recode_query("recode_marital", "marital_raw", R.marital_recode, O.marital, True)
_recode_query("recode_tnm", "t_raw", R.tnm_recode, O.tnm, False)
_recode_query("recode_three_digit", "tumor_raw", R.three_digit_number, O.three, False)
_recode_query("recode_yes_no", "mets_raw", R.yes_no, O.yesno, False)
_recode_query("recode_radiation", "radiation_raw", R.radiation_recode, O.radiation, True)


@query("recode_gene_symbol", _cte(m="mutation_raw") + f"select sample_key, gene, {O.gene('gene')} as symbol from m")
def q_gene_symbol(spark, sf):
    m = X.mutation_raw(spark, sf)
    return m.select("sample_key", "gene", R.gene_symbol(F.col("gene")).alias("symbol"))


# ---------------------------------------------------------------- D: labels and filters

@query("label_registry_mortality", REG + f"select row_id, survival_raw, vital_raw, "
       f"{O.registry_mortality('survival_raw', 'vital_raw')} as mortality_1yr from r")
def q_label_registry_mortality(spark, sf):
    r = X.registry_raw(spark, sf)
    return r.select("row_id", "survival_raw", "vital_raw",
                    L.registry_mortality(F.col("survival_raw"), F.col("vital_raw")).alias("mortality_1yr"))


_REG_CANON = (REG + ", c as (select concat('SEER:', cast(row_id as varchar)) as row_id, 'SEER' as source, "
              "'SEER_LUNG_EXPORTNEW' as source_study, cast(null as varchar) as case_id, "
              "cast(null as varchar) as sample_id, " + O.registry_row() + " from r) ")
_USEFUL_OR = " or ".join(f"{c} is not null" for c in USEFUL_FEATURES)


@query("useful_row_filter", _REG_CANON + f"select row_id from c where {_USEFUL_OR}")
def q_useful_row_filter(spark, sf):
    """D4 over the canonical registry rows."""
    return L.keep_useful_rows(H.registry_cohort(X.registry_export(spark, sf))).select("row_id")


@query("mortality_ready_rows", _REG_CANON + f"select row_id, mortality_1yr from c where ({_USEFUL_OR}) "
       "and mortality_1yr is not null")
def q_mortality_ready(spark, sf):
    """D5."""
    c = L.keep_useful_rows(H.registry_cohort(X.registry_export(spark, sf)))
    return L.labeled(c, "mortality_1yr").select("row_id", "mortality_1yr")


def _coverage_sql(src: str) -> str:
    cols = FEATURE_ORDER + LABEL_COLUMNS
    parts = [f"select '{c}' as \"column\", count({c}) as non_null, count(*) as total from {src}" for c in cols]
    return ("select \"column\", cast(non_null as bigint) as non_null, "
            "case when total > 0 then round_even(100.0 * non_null / total, 2) else 0.0 end as coverage_pct from ("
            + " union all ".join(parts) + ")")


@query("registry_coverage", _REG_CANON + ", u as (select * from c where " + _USEFUL_OR + ") "
       + _coverage_sql("u"))
def q_registry_coverage(spark, sf):
    """Flagship: registry export -> recode -> label -> useful-row filter -> coverage."""
    return E.coverage(L.keep_useful_rows(H.registry_cohort(X.registry_export(spark, sf))))


# ---------------------------------------------------------------- cases

CASES = _cte(c="case_raw")
CASES_FULL = _cte(c="case_raw", f="follow_up_raw", m="mutation_raw")


def _mutation_flags(spark, sf):
    """E2 + E3 from one scan of the mutation recipe; ids re-keyed to the study samples and case submitters."""
    m = X.mutation_raw(spark, sf).select(
        F.concat(F.lit("S"), F.col("sample_key").cast("string")).alias("sample_id"),
        F.concat(F.lit("SUB"), F.substring("patient_id", 2, 64)).alias("patient_id"), "gene")
    return E.mutation_flags(m)


def _patient_flags(spark, sf):
    return _mutation_flags(spark, sf)[1]


def _sample_flags(spark, sf):
    return _mutation_flags(spark, sf)[0]


@query("label_case_mortality", CASES + f"select case_id, vital_status, "
       f"{O.case_mortality('vital_status', 'days_to_death', 'days_to_last_follow_up')} as mortality_1yr from c")
def q_case_mortality(spark, sf):
    c = X.case_raw(spark, sf)
    return c.select("case_id", "vital_status", L.case_mortality(F.col("vital_status"), F.col("days_to_death"),
                                                                F.col("days_to_last_follow_up")).alias("mortality_1yr"))


@query("label_case_response", CASES + f"select case_id, "
       f"{O.case_response('tf_tumor_free_count', 'wt_with_tumor_count', 'best_disease_response')} as response from c")
def q_case_response(spark, sf):
    c = X.case_raw(spark, sf)
    return c.select("case_id", L.case_response(F.col("tf_tumor_free_count"), F.col("wt_with_tumor_count"),
                                               F.col("best_disease_response")).alias("response"))


@query("days_to_years", CASES + f"select case_id, {O.num('age_at_diagnosis_days')} / 365.25 as age_years from c")
def q_days_to_years(spark, sf):
    c = X.case_raw(spark, sf)
    return c.select("case_id", E.days_to_years(F.col("age_at_diagnosis_days")).alias("age_years"))


@query("karnofsky_to_ecog", CASES + "select case_id, coalesce(ecog_half_null, least(4.0, greatest(0.0, "
       "round_even((100.0 - karnofsky_best) / 20.0, 0)))) as performance_status from c")
def q_karnofsky_to_ecog(spark, sf):
    c = X.case_raw(spark, sf)
    return c.select("case_id", E.karnofsky_to_ecog(F.col("ecog_half_null"), F.col("karnofsky_best"))
                    .alias("performance_status"))


@query("follow_up_maxima", _cte(f="follow_up_raw") + "select cast(k as varchar) as case_id, ecog_max, karnofsky_max "
       "from (" + O.nested_lookup_cte("f") + ")")
def q_follow_up_maxima(spark, sf):
    """E4 over nested case documents."""
    return E.follow_up_maxima(X.nested_cases(spark, sf))


@query("prior_treatment_flag", _cte(f="follow_up_raw") + "select k as case_id, prior_treatment from ("
       + O.nested_lookup_cte("f") + ")")
def q_prior_treatment(spark, sf):
    """E5 over nested case documents."""
    return E.prior_treatment_flag(X.nested_cases(spark, sf))


@query("column_level_fallback", CASES + ", f as (" + X.duck("follow_up_raw") + "), n as (" + O.nested_lookup_cte("f")
       + ") select cast(c.case_id as varchar) as case_id, "
       "case when (select count(ecog_all_null) from c) = 0 then n.ecog_max else ecog_all_null end as ecog_from_all_null, "
       "case when (select count(ecog_half_null) from c) = 0 then n.ecog_max else ecog_half_null end as ecog_from_half_null "
       "from c left join n on cast(c.case_id as varchar) = n.k")
def q_column_fallback(spark, sf):
    """B13 + E6: lookup used only when the whole primary column is NULL."""
    c = X.case_raw(spark, sf)
    looked = E.lookup_join(c, E.follow_up_maxima(X.nested_cases(spark, sf)), "case_id", "case_id", ["ecog_max"])
    return looked.select(F.col("case_id").cast("string").alias("case_id"),
                         E.column_fallback(c, F.col("ecog_all_null"), F.col("ecog_max")).alias("ecog_from_all_null"),
                         E.column_fallback(c, F.col("ecog_half_null"), F.col("ecog_max")).alias("ecog_from_half_null"))


_CASE_CANON = (CASES_FULL + ", n as (" + O.nested_lookup_cte("f") + "), pf as ("
               + O.patient_flags_cte("m", "concat('SUB', substr(patient_id, 2))") + ") ")


def _case_canon_spark(spark, sf):
    return H.case_cohort(X.case_raw(spark, sf), X.nested_cases(spark, sf), _patient_flags(spark, sf),
                         ecog_col="ecog_all_null")


@query("case_canonical", _CASE_CANON + O.case_canonical())
def q_case_canonical(spark, sf):
    """A2/A3 shapes -> canonical GDC rows."""
    return _case_canon_spark(spark, sf)


# ---------------------------------------------------------------- studies and mutations

@query("eav_pivot", _cte(e="eav_raw") + O.eav_pivot_cte("e"))
def q_eav_pivot(spark, sf):
    return E.eav_pivot(X.eav_raw(spark, sf))


@query("sample_mutation_flags", _cte(m="mutation_raw") + "select sid as sample_id, egfr_mutation from ("
       + O.sample_flags_cte("m") + ")")
def q_sample_flags(spark, sf):
    return E.sample_mutation_flags(X.mutation_raw(spark, sf).withColumnRenamed("sample_key", "sample_id"))


@query("patient_mutation_flags", _cte(m="mutation_raw") + "select pid as patient_id, egfr_mutation from ("
       + O.patient_flags_cte("m") + ")")
def q_patient_flags(spark, sf):
    return E.patient_mutation_flags(X.mutation_raw(spark, sf))


_STUDY_CANON = (_cte(e="eav_raw", m="mutation_raw") + ", p as (" + O.eav_pivot_cte("e") + "), sfl as ("
                + O.sample_flags_cte("m", "concat('S', cast(sample_key as varchar))") + ") ")


def _study_canon_spark(spark, sf):
    return H.study_cohort(X.eav_raw(spark, sf), _sample_flags(spark, sf))


@query("study_canonical", _STUDY_CANON + O.study_canonical())
def q_study_canonical(spark, sf):
    """A4 shape -> canonical cBio rows (E1 + E6 sample lookup)."""
    return _study_canon_spark(spark, sf)


# ---------------------------------------------------------------- union and reports

_ALL = (REG + ", c as (" + X.duck("case_raw") + "), f as (" + X.duck("follow_up_raw") + "), m as ("
        + X.duck("mutation_raw") + "), e as (" + X.duck("eav_raw") + "), n as (" + O.nested_lookup_cte("f")
        + "), pf as (" + O.patient_flags_cte("m", "concat('SUB', substr(patient_id, 2))") + "), p as ("
        + O.eav_pivot_cte("e") + "), sfl as (" + O.sample_flags_cte("m", "concat('S', cast(sample_key as varchar))")
        + "), h0 as (select concat('SEER:', cast(row_id as varchar)) as row_id, 'SEER' as source, "
        "'SEER_LUNG_EXPORTNEW' as source_study, cast(null as varchar) as case_id, cast(null as varchar) as sample_id, "
        + O.registry_row() + " from r union all " + O.case_canonical() + " union all " + O.study_canonical()
        + "), h as (select * from h0 where " + _USEFUL_OR + ") ")


def harmonized(spark, sf) -> DataFrame:
    """E7 + D4 over the three canonical sources (mutation flags computed once for both lookups)."""
    samples, patients = _mutation_flags(spark, sf)
    cases = H.case_cohort(X.case_raw(spark, sf), X.nested_cases(spark, sf), patients, ecog_col="ecog_all_null")
    studies = H.study_cohort(X.eav_raw(spark, sf), samples)
    return H.harmonize([H.registry_cohort(X.registry_export(spark, sf)), cases, studies])


@query("harmonized_union", _ALL + "select * from h")
def q_harmonized(spark, sf):
    return harmonized(spark, sf)


@query("harmonized_coverage", _ALL + _coverage_sql("h"))
def q_harmonized_coverage(spark, sf):
    return E.coverage(harmonized(spark, sf))


@query("harmonized_value_counts", _ALL + "select 'source' as \"column\", cast(source as varchar) as value, "
       "count(*) as n from h group by 1, 2 union all select 'mortality_1yr', cast(mortality_1yr as varchar), count(*) "
       "from h group by 1, 2 union all select 'response', cast(response as varchar), count(*) from h group by 1, 2")
def q_value_counts(spark, sf):
    """E9 (NULL group kept)."""
    return E.value_counts(harmonized(spark, sf), ["source", "mortality_1yr", "response"])


@query("readiness_summary", _ALL + "select count(*) as total_rows_harmonized, count(mortality_1yr) as "
       "rows_mortality_ready, count(response) as rows_response_ready, "
       + ", ".join(f"cast(count_if({c}) as bigint) as {a}" for c, a in [
           ("source = 'SEER'", "rows_seer"), ("source = 'GDC'", "rows_gdc"), ("source = 'cBio'", "rows_cbio"),
           ("mortality_1yr = 1.0", "mortality_pos"), ("mortality_1yr = 0.0", "mortality_neg"),
           ("response = 1.0", "response_pos"), ("response = 0.0", "response_neg")]) + " from h")
def q_readiness(spark, sf):
    """E10."""
    return E.readiness(harmonized(spark, sf))


# ---------------------------------------------------------------- evaluation

from ..operators import evaluate as V  # noqa: E402
from ..operators import hazards as HZ  # noqa: E402
from ..operators import sampling as S  # noqa: E402
from ..operators import uncertainty as U  # noqa: E402

SC = _cte(s="scored")


def _r(c: str, alias: str | None = None):
    return F.round(F.col(c), DIGITS).alias(alias or c)


def _rs(c: str, alias: str | None = None) -> str:
    return f"round({c}, {DIGITS}) as {alias or c}"


def _counts_sql(src: str, thr: str) -> str:
    return (f"select count_if(p >= {thr} and y = 1) as tp, count_if(p >= {thr} and y = 0) as fp, "
            f"count_if(p < {thr} and y = 0) as tn, count_if(p < {thr} and y = 1) as fn, "
            f"avg(power(p - y, 2)) as brier from {src}")


def _metrics_sql(tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    return (f"case when {tp}+{fp}+{tn}+{fn} > 0 then ({tp}+{tn})::double/({tp}+{fp}+{tn}+{fn}) else 0.0 end as accuracy, "
            f"case when {tp}+{fn} > 0 and {tn}+{fp} > 0 then ({tp}::double/({tp}+{fn}) + {tn}::double/({tn}+{fp}))/2 "
            f"when {tp}+{fn} > 0 then {tp}::double/({tp}+{fn}) when {tn}+{fp} > 0 then {tn}::double/({tn}+{fp}) "
            f"else 0.0 end as balanced_accuracy, "
            f"case when {tp}+{fp} > 0 then {tp}::double/({tp}+{fp}) else 0.0 end as precision, "
            f"case when {tp}+{fn} > 0 then {tp}::double/({tp}+{fn}) else 0.0 end as recall, "
            f"case when 2*{tp}+{fp}+{fn} > 0 then 2.0*{tp}/(2*{tp}+{fp}+{fn}) else 0.0 end as f1")


@query("threshold_metrics", SC + "select " + ", ".join(_rs(m) for m in V.METRIC_NAMES + ["brier"]) + " from (select "
       + _metrics_sql() + ", brier from (" + _counts_sql("s", "0.5") + "))")
def q_threshold_metrics(spark, sf):
    """I1 + I3."""
    m = V.threshold_metrics(X.scored(spark, sf))
    return m.select(*[_r(c) for c in V.METRIC_NAMES + ["brier"]])


_AUC_SQL = ("select round(sum(pos * (2.0 * neg_before + neg)) / (2.0 * sum(pos) * sum(neg)), 9) as auc from ("
            "select pos, neg, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) "
            "as neg_before from (select p, sum(y) as pos, sum(1 - y) as neg from s group by p))")


@query("roc_auc", SC + _AUC_SQL)
def q_roc_auc(spark, sf):
    """I2."""
    return V.roc_auc(X.scored(spark, sf)).select(_r("auc"))


@query("roc_auc_orders", "with s as (select o_orderkey as row_id, o_totalprice as p, case when o_orderpriority in "
       "('1-URGENT','2-HIGH') then 1 else 0 end as y from orders) " + _AUC_SQL.replace("from s group by p",
                                                                                   "from s group by p"))
def q_roc_auc_orders(spark, sf):
    """I2 on raw order prices as scores (unbounded scores, log-scale buckets)."""
    o = X.table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("p"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("y"))
    return V.roc_auc(o, probabilities=False).select(_r("auc"))


@query("brier_score", SC + "select round(avg(power(p - y, 2)), 9) as brier from s")
def q_brier(spark, sf):
    """I3."""
    return V.brier(X.scored(spark, sf)).select(_r("brier"))


_GRID_SQL = "cast([" + ", ".join(repr(t) for t in V.THRESHOLD_GRID) + "] as double[])"


@query("best_threshold", SC + ", g as (select unnest(range(61)) as i), t as (select i, " + _GRID_SQL
       + "[i + 1] as threshold from g), c as (select t.i, t.threshold, count_if(s.p >= t.threshold and s.y = 1) as tp, "
       "count_if(s.p >= t.threshold and s.y = 0) as fp, count_if(s.p < t.threshold and s.y = 0) as tn, "
       "count_if(s.p < t.threshold and s.y = 1) as fn from t, s group by t.i, t.threshold), "
       "m as (select i, threshold, " + _metrics_sql() + " from c) "
       "select threshold, " + ", ".join(_rs(x) for x in V.METRIC_NAMES) + " from m order by f1 desc, accuracy desc, "
       "case when threshold = 0.5 then -1 else i end asc limit 1")
def q_best_threshold(spark, sf):
    """I6 (the oracle brute-forces every threshold against every row)."""
    b = V.best_threshold(X.scored(spark, sf))
    return b.select("threshold", *[_r(c) for c in V.METRIC_NAMES])


@query("roc_curve", SC + ", d as (select p, sum(y) as pos, sum(1 - y) as neg from s group by p), "
       "c as (select p, sum(pos) over (order by p desc) as tps, sum(neg) over (order by p desc) as fps, "
       "sum(pos) over () as tot_pos, sum(neg) over () as tot_neg from d), "
       "k as (select *, lag(tps) over (order by p desc) as ptps, lag(fps) over (order by p desc) as pfps, "
       "lead(tps) over (order by p desc) as ntps, lead(fps) over (order by p desc) as nfps from c), "
       "pts as (select p as threshold, tps, fps, tot_pos, tot_neg from k where ptps is null or ntps is null "
       "or pfps - 2 * fps + nfps <> 0 or ptps - 2 * tps + ntps <> 0 union all select 'inf'::double, 0, 0, "
       "(select sum(pos) from d), (select sum(neg) from d)) "
       "select threshold, cast(tps as bigint) as tps, cast(fps as bigint) as fps, round(fps / tot_neg, 9) as fpr, "
       "round(tps / tot_pos, 9) as tpr from pts")
def q_roc_curve(spark, sf):
    """I7 (collinear points dropped, origin at threshold +inf)."""
    r = V.roc_curve(X.scored(spark, sf))
    return r.select("threshold", F.col("tps").cast("bigint").alias("tps"), F.col("fps").cast("bigint").alias("fps"),
                    _r("fpr"), _r("tpr"))


_CAL_Q = ", ".join(repr(v) for v in V.CALIBRATION_QUANTILES)


@query("calibration_curve", SC + ", e as (select quantile_cont(p, [" + _CAL_Q + "]) as edges from s) "
       "select bin, count(*) as n, round(avg(p), 9) as mean_predicted, round(avg(y::double), 9) as fraction_positive "
       "from (select p, y, len(list_filter(edges, lambda x: x < p)) as bin from s, e) group by bin")
def q_calibration_curve(spark, sf):
    """I8."""
    c = V.calibration_curve(X.scored(spark, sf))
    return c.select(F.col("bin").cast("bigint").alias("bin"), "n", _r("mean_predicted"), _r("fraction_positive"))


_EDGES_SQL = "cast([" + ", ".join(repr(v) for v in V.HISTOGRAM_EDGES) + "] as double[])"


@query("probability_histogram", SC + ", b as (select y, case when p = 1.0 then 19 else "
       "len(list_filter(" + _EDGES_SQL + ", lambda x: x <= p)) - 1 end as bin from s where p >= 0 and p <= 1) "
       "select y, bin, " + _EDGES_SQL + "[bin + 1] as bin_lo, " + _EDGES_SQL + "[bin + 2] as bin_hi, count(*) as n "
       "from b group by y, bin")
def q_probability_histogram(spark, sf):
    """I9."""
    h = V.probability_histogram(X.scored(spark, sf))
    return h.select("y", F.col("bin").cast("bigint").alias("bin"), "bin_lo", "bin_hi", "n")


@query("conformal_quantile", SC + ", sc as (select 1.0 - case when y = 1 then p else 1.0 - p end as score from s), "
       "k as (select count(*) as n, cast(least(count(*), greatest(1, ceil((count(*) + 1) * 0.9))) as bigint) as k "
       "from sc), o as (select score, row_number() over (order by score) as rn from sc) "
       "select k.n, k.k, 0.1::double as alpha, round(o.score, 9) as q from o, k where o.rn = k.k")
def q_conformal_quantile(spark, sf):
    """I11."""
    c = U.conformal_quantile(X.scored(spark, sf))
    return c.select("n", "k", "alpha", _r("q"))


@query("prediction_sets", SC + ", sc as (select 1.0 - case when y = 1 then p else 1.0 - p end as score from s), "
       "k as (select cast(least(count(*), greatest(1, ceil((count(*) + 1) * 0.9))) as bigint) as k from sc), "
       "q as (select score as q from (select score, row_number() over (order by score) as rn from sc), k "
       "where rn = k.k) select row_id, case when p > 0.5 then 1.0 else 0.0 end::double as prediction, "
       "case when 1.0 - p >= 1.0 - q.q then 1.0 else 0.0 end::double as set_contains_0, "
       "case when p >= 1.0 - q.q then 1.0 else 0.0 end::double as set_contains_1 from s, q")
def q_prediction_sets(spark, sf):
    """I12 with the I11 quantile of the same table."""
    s = X.scored(spark, sf)
    q = U.conformal_quantile(s).select("q").scalar()
    return U.prediction_sets(s.select("row_id", "p"), q).select("row_id", "prediction", "set_contains_0",
                                                                "set_contains_1")


@query("event_time_table", _cte(c="case_raw") + ", ev as (select coalesce(" + O.num("days_to_death") + ", "
       + O.num("days_to_last_follow_up") + ") as t, " + O.case_mortality('vital_status', 'days_to_death',
                                                                     'days_to_last_follow_up')
       + " as e from c), u as (select * from ev where t is not null and e is not null), "
       "d as (select t, count(*) as c, sum(e) as d from u group by t), "
       "r as (select t, c, d, (select count(*) from u) - coalesce(sum(c) over (order by t rows between unbounded "
       "preceding and 1 preceding), 0) as at_risk from d), hz as (select *, d / at_risk as hazard from r), "
       "ch as (select *, sum(hazard) over (order by t) as cumulative_hazard from hz) "
       "select t as duration, cast(at_risk as bigint) as at_risk, d as events, c - d as censored, "
       "round(hazard, 9) as hazard, round(cumulative_hazard, 9) as cumulative_hazard, "
       "round(exp(-cumulative_hazard), 9) as survival from ch")
def q_event_time(spark, sf):
    """duration = death days, else follow-up days; event = the D2 label."""
    c = X.case_raw(spark, sf)
    ev = c.select(F.coalesce(T.to_number(F.col("days_to_death")), T.to_number(F.col("days_to_last_follow_up")))
                  .alias("duration"),
                  L.case_mortality(F.col("vital_status"), F.col("days_to_death"),
                                   F.col("days_to_last_follow_up")).alias("event"))
    t = U.event_time_table(ev)
    return t.select("duration", "at_risk", "events", "censored", _r("hazard"), _r("cumulative_hazard"),
                    _r("survival"))


_EVENTS = (_cte(c="case_raw") + ", ev as (select coalesce(" + O.num("days_to_death") + ", " + O.num("days_to_last_follow_up") + ") as t, "
           + O.case_mortality('vital_status', 'days_to_death', 'days_to_last_follow_up') + " as e, age_at_diagnosis_days / 365.25 as age from c), "
           "u as (select t, e, age, age - avg(age) over () as x from ev where t is not null and e is not null and age is not null)")


def _newton_sql(steps: int) -> str:
    """Newton steps with Efron's ties for the one covariate x of u, from b0; the last one's sums are in o{steps}."""
    out = ", b0 as (select 0.0::double as b)"
    for k in range(steps + 1):
        out += (f", g{k} as materialized (select t, sum(e) as d, sum(e * x) as sx, any_value(b) as b, " + ", ".join(f"sum(w{m}) as s{i}, sum(e * w{m}) as e{i}" for i, m in enumerate(("", " * x", " * x * x")))
                + f" from (select u.*, b, exp(b * x) as w from u, b{k}) group by t), q{k} as (select *, " + ", ".join(f"sum(s{i}) over (order by t desc) as r{i}" for i in range(3))
                + f" from g{k}), l{k} as (select *, unnest(generate_series(0, d::bigint - 1)) / d as f from q{k} where d > 0), "
                f"o{k} as materialized (select any_value(b) as b, sum(b * sx / d - ln(r0 - f * e0)) as value, sum(sx / d - (r1 - f * e1) / (r0 - f * e0)) as slope, "
                f"sum((r2 - f * e2) / (r0 - f * e0) - ((r1 - f * e1) / (r0 - f * e0)) ** 2) as info from l{k}), b{k + 1} as (select b + slope / info as b from o{k})")
    return out


def _events(spark, sf) -> DataFrame:
    """(duration, event, age in years) of the cases."""
    return X.case_raw(spark, sf).select(
        F.coalesce(T.to_number(F.col("days_to_death")), T.to_number(F.col("days_to_last_follow_up"))).alias("duration"),
        L.case_mortality(F.col("vital_status"), F.col("days_to_death"), F.col("days_to_last_follow_up")).alias("event"),
        (F.col("age_at_diagnosis_days") / 365.25).alias("age"))


@query("proportional_hazards_fit", _EVENTS + _newton_sql(7) + " select 'age' as covariate, round(o7.b, 7) as coefficient, round(exp(o7.b), 7) as hazard_ratio, "
       "round(1 / sqrt(o7.info), 7) as standard_error, round(o7.value, 5) as log_likelihood, round(o0.value, 5) as null_log_likelihood, "
       "(select count(*) from u) as n, (select count(*) from u where e > 0) as events from o7, o0")
def q_hazards_fit(spark, sf):
    """The fit on age; the oracle takes Newton steps in SQL."""
    fit = HZ.fit_hazards(_events(spark, sf), ["age"])
    return fit.summary(spark).select("covariate", F.round("coefficient", 7).alias("coefficient"), F.round("hazard_ratio", 7).alias("hazard_ratio"), F.round("standard_error", 7).alias("standard_error"), F.round(F.lit(fit.log_likelihood), 5).alias("log_likelihood"),
                                     F.round(F.lit(fit.null_log_likelihood), 5).alias("null_log_likelihood"), F.lit(fit.n).cast("long").alias("n"), F.lit(fit.events).cast("long").alias("events"))


@query("concordance_index", _EVENTS + ", p as (select a.age > b.age as more, a.age = b.age as same from u as a, u as b where a.e > 0 and (b.t > a.t or (b.t = a.t and b.e = 0))) "
       "select count(*)::double as pairs, count_if(more)::double as concordant, count_if(same)::double as tied, round((count_if(more) + 0.5 * count_if(same)) / count(*), 9) as concordance from p")
def q_concordance(spark, sf):
    """Harrell's index of age; the oracle compares all pairs."""
    return HZ.concordance(_events(spark, sf), F.col("age")).select("pairs", "concordant", "tied", _r("concordance"))


# ---------------------------------------------------------------- sampling

def _rank_sql(src: str, strata: str, seed: str, id_col: str = "row_id") -> str:
    return (f"row_number() over (partition by {strata} order by md5(concat('{seed}:', cast({id_col} as varchar))), "
            f"{id_col})")


def _quota_sql(src: str, label: str, total: str) -> str:
    return (f"select {label}, base + case when row_number() over (order by rem desc, {label} asc) <= q - sum(base) "
            f"over () then 1 else 0 end as quota from (select {label}, nc, q, floor(q * nc / n) as base, "
            f"(q * nc) % n as rem from (select {label}, count(*) as nc, sum(count(*)) over () as n, {total} as q "
            f"from {src} group by {label}))")


@query("stratified_cap", SC + ", qt as (" + _quota_sql("s", "y", "least(5000, (select count(*) from s))")
       + "), rk as (select row_id, y, " + _rank_sql("s", "y", "42") + " as rk from s) "
       "select rk.row_id, rk.y from rk join qt on rk.y = qt.y where rk.rk <= qt.quota")
def q_stratified_cap(spark, sf):
    """exactly 5,000 rows (or all when smaller), class mix kept."""
    return S.stratified_cap(X.scored(spark, sf), "y", "row_id", 5000).select("row_id", "y")


@query("stratified_folds", SC + "select row_id, y, cast((" + _rank_sql("s", "y", "42") + " - 1) % 3 as integer) "
       "as fold from s")
def q_stratified_folds(spark, sf):
    """K=3 stratified folds."""
    return S.stratified_folds(X.scored(spark, sf), "y", "row_id").select("row_id", "y", "fold")


@query("order_status_folds", "with s as (select o_orderkey as row_id, o_orderstatus as y from orders) "
       "select row_id, y, cast((" + _rank_sql("s", "y", "7") + " - 1) % 3 as integer) as fold from s")
def q_order_status_folds(spark, sf):
    """F2 on a 3-class label (order status), another seed."""
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y"))
    return S.stratified_folds(o, "y", "row_id", seed=7).select("row_id", "y", "fold")


@query("inner_folds", SC + ", f as (select row_id, y, (" + _rank_sql("s", "y", "42") + " - 1) % 3 as fold from s), "
       "x as (select f.row_id, f.y, o.outer_fold from f, (select unnest(range(3)) as outer_fold) o "
       "where o.outer_fold <> f.fold) select row_id, y, cast(outer_fold as integer) as outer_fold, "
       "cast((" + _rank_sql("x", "outer_fold, y", "42:inner") + " - 1) % 2 as integer) as inner_fold from x")
def q_inner_folds(spark, sf):
    """inner K=2 folds inside each outer training set."""
    f = S.stratified_folds(X.scored(spark, sf), "y", "row_id")
    return S.inner_folds(f, "y", "row_id").select("row_id", "y", "outer_fold", "inner_fold")


@query("holdout_split", SC + ", qt as (" + _quota_sql("s", "y", "ceil(0.2 * (select count(*) from s))")
       + "), rk as (select row_id, y, " + _rank_sql("s", "y", "42") + " as rk from s) "
       "select rk.row_id, rk.y, case when rk.rk <= qt.quota then 'test' else 'train' end as split "
       "from rk join qt on rk.y = qt.y")
def q_holdout_split(spark, sf):
    """stratified 80/20 holdout, test size ceil(0.2 n)."""
    return S.holdout_split(X.scored(spark, sf), "y", "row_id").select("row_id", "y", "split")


@query("attribution_sample", SC + "select row_id, p, y from s order by md5(concat('42:', cast(row_id as varchar))), "
       "row_id limit 256")
def q_attribution_sample(spark, sf):
    """the 256-row attribution sample (the limit is the operator)."""
    return S.attribution_sample(X.scored(spark, sf), "row_id").select("row_id", "p", "y")


@query("class_weights", "with d as (" + X.DOC_LABELS_SQL + ") select quality, count(*) as n_class, "
       "round(sum(count(*)) over () / (count(*) over () * count(*)), 9) as weight from d group by quality")
def q_class_weights(spark, sf):
    """balanced class weights on document quality labels."""
    w = S.balanced_weights(X.doc_labels(spark, sf), "quality")
    return w.select("quality", "n_class", _r("weight"))


# ---------------------------------------------------------------- runs: fold metrics, summary, CI (H5 eval, I4, I5)

from . import runs as RN  # noqa: E402
from ..operators import serve as J  # noqa: E402
from ..functions.catalog import DROP_FEATURES_BY_TASK  # noqa: E402

_METRIC_COLS = V.METRIC_NAMES + ["auc", "brier"]
_FOLDS_SQL = (
    "with " + X.duck_run_scores_long()
    + ", fo as (select *, (row_number() over (partition by task, algorithm, y order by "
    "md5(concat('42:', cast(row_id as varchar))), row_id) - 1) % 3 as fold from lg), "
    "fc as (select task, algorithm, fold, count_if(p >= 0.5 and y = 1) as tp, count_if(p >= 0.5 and y = 0) as fp, "
    "count_if(p < 0.5 and y = 0) as tn, count_if(p < 0.5 and y = 1) as fn, avg(power(p - y, 2)) as brier "
    "from fo group by task, algorithm, fold), "
    "fd as (select task, algorithm, fold, p, sum(y) as pos, sum(1 - y) as neg from fo group by task, algorithm, fold, p), "
    "fa as (select task, algorithm, fold, sum(pos * (2.0 * neg_before + neg)) / (2.0 * sum(pos) * sum(neg)) as auc "
    "from (select *, coalesce(sum(neg) over (partition by task, algorithm, fold order by p rows between unbounded "
    "preceding and 1 preceding), 0) as neg_before from fd) group by task, algorithm, fold), "
    "fm as (select fc.task, fc.algorithm, fc.fold, " + _metrics_sql("fc.tp", "fc.fp", "fc.tn", "fc.fn")
    + ", fc.brier, fa.auc from fc join fa on fc.task = fa.task and fc.algorithm = fa.algorithm and fc.fold = fa.fold), "
    "sm as (select task, algorithm, "
    + ", ".join(f"avg({m}) as {m}_mean, stddev_samp({m}) as {m}_std" for m in _METRIC_COLS)
    + " from fm group by task, algorithm), "
    "ci as (select task, algorithm, count(*) as n_folds, avg(auc) as mean, "
    "case when count(*) >= 2 then greatest(0.0, avg(auc) - 1.96 * stddev_samp(auc) / sqrt(count(*))) end as lower, "
    "case when count(*) >= 2 then least(1.0, avg(auc) + 1.96 * stddev_samp(auc) / sqrt(count(*))) end as upper "
    "from fm where auc is not null and not isnan(auc) group by task, algorithm), "
    "hq as (select task, algorithm, y, base + case when row_number() over (partition by task, algorithm order by "
    "rem desc, y asc) <= q - sum(base) over (partition by task, algorithm) then 1 else 0 end as quota from ("
    "select task, algorithm, y, q, floor(q * nc / n) as base, (q * nc) % n as rem from (select task, algorithm, y, "
    "count(*) as nc, sum(count(*)) over (partition by task, algorithm) as n, ceil(0.2 * sum(count(*)) over "
    "(partition by task, algorithm)) as q from lg group by task, algorithm, y))), "
    "ht as (select lg.* from (select *, row_number() over (partition by task, algorithm, y order by "
    "md5(concat('42:', cast(row_id as varchar))), row_id) as rk from lg) lg join hq on lg.task = hq.task "
    "and lg.algorithm = hq.algorithm and lg.y = hq.y where lg.rk <= hq.quota), "
    "tg as (select i, " + _GRID_SQL + "[i + 1] as threshold from (select unnest(range(61)) as i)), "
    "tc as (select ht.task, ht.algorithm, tg.i, tg.threshold, count_if(ht.p >= tg.threshold and ht.y = 1) as tp, "
    "count_if(ht.p >= tg.threshold and ht.y = 0) as fp, count_if(ht.p < tg.threshold and ht.y = 0) as tn, "
    "count_if(ht.p < tg.threshold and ht.y = 1) as fn from ht, tg group by ht.task, ht.algorithm, tg.i, tg.threshold), "
    "tm as (select task, algorithm, i, threshold, " + _metrics_sql() + " from tc), "
    "bt as (select task, algorithm, threshold, f1 from (select *, row_number() over (partition by task, algorithm "
    "order by f1 desc, accuracy desc, case when threshold = 0.5 then -1 else i end) as r from tm) where r = 1), "
    "runs as (select sm.task, sm.algorithm, sm.auc_mean as auc, sm.brier_mean as brier, bt.threshold, "
    "'ok' as status, cast(null as varchar) as error, case sm.task "
    + " ".join(f"when '{t}' then ['dropped_features={','.join(sorted(d))}']" for t, d in DROP_FEATURES_BY_TASK.items())
    + " end as notes from sm join bt on sm.task = bt.task and sm.algorithm = bt.algorithm) ")


@query("fold_metrics", _FOLDS_SQL + "select task, algorithm, cast(fold as integer) as fold, "
       + ", ".join(_rs(m) for m in _METRIC_COLS) + " from fm")
def q_fold_metrics(spark, sf):
    """Outer-fold evaluation of every run at once (the evaluation half of H5)."""
    fm = RN.fold_metrics(X.run_scores(spark, sf))
    return fm.select("task", "algorithm", "fold", *[_r(m) for m in _METRIC_COLS])


@query("fold_summary", _FOLDS_SQL + "select task, algorithm, "
       + ", ".join(f"{_rs(m + '_mean')}, {_rs(m + '_std')}" for m in _METRIC_COLS) + " from sm")
def q_fold_summary(spark, sf):
    """I4: fold mean and sample std of each metric, per run."""
    s = V.fold_summary(RN.fold_metrics(X.run_scores(spark, sf)), RN.RUN, _METRIC_COLS)
    return s.select("task", "algorithm", *[c for m in _METRIC_COLS for c in (_r(f"{m}_mean"), _r(f"{m}_std"))])


@query("auc_confidence_interval", _FOLDS_SQL + "select task, algorithm, 'normal_approx_over_outer_folds' as method, "
       "n_folds, round(mean, 9) as mean, round(lower, 9) as lower, round(upper, 9) as upper from ci")
def q_auc_ci(spark, sf):
    """I5."""
    c = V.auc_ci(RN.fold_metrics(X.run_scores(spark, sf)), RN.RUN)
    return c.select("task", "algorithm", "method", "n_folds", _r("mean"), _r("lower"), _r("upper"))


@query("holdout_best_threshold", _FOLDS_SQL + "select task, algorithm, threshold, round(f1, 9) as f1 from bt")
def q_holdout_best_threshold(spark, sf):
    """F4 + I6 per run: best F1 threshold on each run's stratified 20 % holdout."""
    s = X.run_scores(spark, sf)
    test = S.holdout_split(s, "y", "row_id", by=RN.RUN).filter(F.col("split") == "test")
    return V.best_threshold(test, groups=RN.RUN).select("task", "algorithm", "threshold", _r("f1"))


def _runs(spark, sf):
    return RN.runs_table(X.run_scores(spark, sf))


@query("run_ranking", _FOLDS_SQL + "select task, algorithm, round(auc, 9) as auc, round(brier, 9) as brier, "
       "row_number() over (partition by task order by auc desc nulls last, brier asc nulls last, algorithm desc) "
       "as rank from runs")
def q_run_ranking(spark, sf):
    """J2."""
    r = J.rank_runs(_runs(spark, sf))
    return r.select("task", "algorithm", _r("auc"), _r("brier"), F.col("rank").cast("bigint").alias("rank"))


_SELECTED_SQL = (", rk as (select *, row_number() over (partition by task order by auc desc nulls last, "
                 "brier asc nulls last, algorithm desc) as rank from runs), "
                 "sel as (select * from rk where rank = (select min(rank) from rk r2 where r2.task = rk.task "
                 "and r2.status = 'ok')) ")


@query("selected_runs", _FOLDS_SQL + _SELECTED_SQL + "select task, algorithm, cast(rank as bigint) as rank, "
       "case when threshold between 0 and 1 then threshold else 0.5 end as decision_threshold from sel")
def q_selected_runs(spark, sf):
    """J3 + J4: first usable run per task and its decision threshold."""
    s = J.select_runs(J.rank_runs(_runs(spark, sf)))
    return s.select("task", "algorithm", F.col("rank").cast("bigint").alias("rank"),
                    J.decision_threshold(F.col("threshold")).alias("decision_threshold"))


_FEATS_SQL = ("[" + ", ".join(f"'{f}'" for f in FEATURE_ORDER) + "]")


@query("report_features", _FOLDS_SQL + ", nf as (select task, algorithm, string_split(replace(list_filter(notes, "
       "lambda s: starts_with(s, 'dropped_features='))[-1], 'dropped_features=', ''), ',') as dropped from runs) "
       "select task, algorithm, array_to_string(dropped, ',') as dropped_features, "
       "array_to_string(list_filter(" + _FEATS_SQL + ", lambda f: not list_contains(dropped, f)), ',') "
       "as used_features from nf")
def q_report_features(spark, sf):
    """J1 (arrays rendered as comma-joined text for the cross-engine hash)."""
    r = J.report_features(_runs(spark, sf))
    return r.select("task", "algorithm", F.array_join("dropped_features", ",").alias("dropped_features"),
                    F.array_join("used_features", ",").alias("used_features"))


def _shared_active(spark, sf):
    sel = J.report_features(J.select_runs(J.rank_runs(_runs(spark, sf))))
    row = sel.agg(F.max(F.when(F.col("task") == "response", F.col("used_features"))).alias("r"),
                  F.max(F.when(F.col("task") == "mortality", F.col("used_features"))).alias("m"))
    return row.select(J.shared_features(F.col("r"), F.col("m")).alias("shared"))


@query("shared_features", _FOLDS_SQL + _SELECTED_SQL + ", nf as (select task, list_filter(" + _FEATS_SQL
       + ", lambda f: not list_contains(string_split(replace(list_filter(notes, lambda s: starts_with(s, "
       "'dropped_features='))[-1], 'dropped_features=', ''), ','), f)) as used from sel), "
       "pr as (select (select used from nf where task = 'response') as r, (select used from nf where "
       "task = 'mortality') as m) select array_to_string(list_filter(" + _FEATS_SQL + ", lambda f: "
       "list_contains(pr.r, f) and list_contains(pr.m, f)), ',') as shared from pr")
def q_shared_features(spark, sf):
    """J5."""
    return _shared_active(spark, sf).select(F.array_join("shared", ",").alias("shared"))


@query("deployment_status", _FOLDS_SQL + _SELECTED_SQL + "select (select count(*) from sel where task = 'response') > 0 "
       "as response_model_ready, (select count(*) from sel where task = 'mortality') > 0 as mortality_model_ready, "
       f"{len(FEATURE_ORDER)} as feature_count, "
       "(select case when threshold between 0 and 1 then threshold else 0.5 end from sel where task = 'response') "
       "as response_threshold, (select case when threshold between 0 and 1 then threshold else 0.5 end from sel "
       "where task = 'mortality') as mortality_threshold, (select algorithm from sel where task = 'response') "
       "as response_algorithm, (select algorithm from sel where task = 'mortality') as mortality_algorithm, "
       f"'{J.READY_MODE}' as mode")
def q_deployment_status(spark, sf):
    """J12."""
    return J.deployment_status(J.select_runs(J.rank_runs(_runs(spark, sf))))


# ---------------------------------------------------------------- payloads, scoring, attribution

from ..functions.catalog import feature_order_for_task  # noqa: E402
from ..operators import attribution as A  # noqa: E402

# --- fixed values: demonstration scorers for the SQL-checkable scoring path ---
RESPONSE_SCORER = J.LinearScorer(
    intercept=-1.0, numeric={"age": 0.01, "chemotherapy_cycles": 0.6},
    categorical={"histology": {"Adenocarcinoma": 0.5, "Squamous": -0.2},
                 "cancer_stage": {"IV": -0.8, "IIIA": -0.3}, "sex": {"Female": 0.2}})
MORTALITY_SCORER = J.LinearScorer(
    intercept=-2.0, numeric={"age": 0.02, "tumor_size_mm": 0.008, "mets_lung_dx": 0.9, "treatment_delay_days": 0.002},
    categorical={"cancer_stage": {"IV": 1.2, "IIIB": 0.7, "IIIA": 0.4}, "radiation_recode": {"Refused": 0.3}})
# --- end of fixed values ---

_UPLOAD_COLS = ["age", "sex", "histology", "cancer_stage", "tumor_size_mm", "mets_lung_dx", "chemotherapy_cycles",
                "radiation_recode", "treatment_delay_days"]


def _upload(spark, sf) -> DataFrame:
    """A user upload: canonical registry rows as text, some cells blank or junk, some columns absent."""
    c = H.registry_cohort(X.registry_export(spark, sf))
    rid = F.substring_index(F.col("row_id"), ":", -1).cast("long")
    cols = []
    for i, n in enumerate(_UPLOAD_COLS):
        s = F.col(n).cast("string")
        cols.append(F.when(rid % (11 + i) == 0, F.lit("")).when(rid % (29 + i) == 0, F.lit("junk"))
                    .otherwise(s).alias(n))
    return c.select("row_id", *cols, F.when(rid % 5 == 0, F.lit(" ")).otherwise(F.lit("Pemetrexed")).alias("drug_name"))


def _upload_sql() -> str:
    cols = []
    for i, n in enumerate(_UPLOAD_COLS):
        cols.append(f"case when rid % {11 + i} = 0 then '' when rid % {29 + i} = 0 then 'junk' "
                    f"else cast({n} as varchar) end as {n}")
    return (_REG_CANON + ", up as (select row_id, " + ", ".join(cols) + ", case when rid % 5 = 0 then ' ' "
            "else 'Pemetrexed' end as drug_name from (select *, cast(split_part(row_id, ':', 2) as bigint) as rid "
            "from c)) ")


def _norm_sql() -> str:
    from ..functions.catalog import FEATURES as FS
    return ", ".join(f"{O.normalize(f.dtype, f.name if f.name in _UPLOAD_COLS else 'cast(null as varchar)', f.default)} "
                     f"as {f.name}" for f in FS)


@query("payload_normalization", _upload_sql() + "select row_id, " + _norm_sql() + " from up")
def q_payload_normalization(spark, sf):
    """B6 + B7 + B8: typed payload, defaults for blank/absent/unparsable cells."""
    return T.normalize_payload(_upload(spark, sf), keep=["row_id"])


@query("feature_typing", _upload_sql() + "select row_id, "
       + ", ".join((f"{O.num(n)} as {n}" if n in ("age", "tumor_size_mm", "mets_lung_dx", "chemotherapy_cycles",
                                                  "treatment_delay_days")
                    else f"case when {n} in ('None', '<NA>', 'nan') then null else {n} end as {n}")
                   for n in _UPLOAD_COLS) + " from up")
def q_feature_typing(spark, sf):
    """Numerics coerced leniently, categorical sentinels nulled."""
    return T.coerce_feature_types(_upload(spark, sf).drop("drug_name"))


def _violations_sql() -> str:
    from ..functions.catalog import FEATURES as FS
    parts = []
    for f in FS:
        if f.name not in _UPLOAD_COLS:
            continue
        if f.numeric and f.minimum is not None and f.maximum is not None:
            parts.append(f"select '{f.name}:range' as violation, count_if({f.name} < {float(f.minimum)} or "
                         f"{f.name} > {float(f.maximum)}) as n from c")
        if f.choices:
            if f.numeric:
                vals = ", ".join(str(float(v)) for v in f.choices)
                parts.append(f"select '{f.name}:choice', count_if({f.name} is not null and {f.name} not in ({vals})) from c")
            else:
                vals = ", ".join(f"'{str(v).lower()}'" for v in f.choices)
                parts.append(f"select '{f.name}:choice', count_if({f.name} is not null and lower({f.name}) not in "
                             f"({vals})) from c")
    return "select violation, cast(n as bigint) as n from (" + " union all ".join(parts) + ") where n > 0"


@query("constraint_violations", _REG_CANON + _violations_sql())
def q_constraint_violations(spark, sf):
    """B9 re-aimed as a data-quality report: rows violating each declared range/choice."""
    c = H.registry_cohort(X.registry_export(spark, sf)).select(*_UPLOAD_COLS)
    from ..functions.catalog import FEATURES as FS
    v = c.select(T.constraint_violations(FS, present=_UPLOAD_COLS).alias("v"))
    return (v.select(F.explode("v").alias("violation")).groupBy("violation")
            .agg(F.count(F.lit(1)).alias("n")))


@query("task_feature_pruning", _REG_CANON + "select row_id, "
       + ", ".join(feature_order_for_task("mortality")) + ", mortality_1yr from c where mortality_1yr is not null")
def q_task_feature_pruning(spark, sf):
    """B10 + A6 shape: the mortality training table keeps only the task's features and its label."""
    c = L.labeled(H.registry_cohort(X.registry_export(spark, sf)), "mortality_1yr")
    return c.select("row_id", *feature_order_for_task("mortality"), "mortality_1yr")


_NORM_CTE = ", nz as (select row_id, drug_name, " + _norm_sql() + " from up) "
_RESP_P = "1.0 / (1.0 + exp(-(" + O.linear_logit(RESPONSE_SCORER.intercept, RESPONSE_SCORER.numeric,
                                                  RESPONSE_SCORER.categorical) + ")))"
_MORT_P = "1.0 / (1.0 + exp(-(" + O.linear_logit(MORTALITY_SCORER.intercept, MORTALITY_SCORER.numeric,
                                                  MORTALITY_SCORER.categorical) + ")))"


@query("batch_scoring", _upload_sql() + _NORM_CTE + ", sc as (select row_id, drug_name, " + _RESP_P + " as p, "
       + _MORT_P + " as pm from nz) select row_id, round(p, 9) as probability, case when p >= 0.5 then "
       "'Positive response expected' else 'Negative response expected' end as label, "
       "printf('%.1f%%', greatest(p, 1.0 - p) * 100.0) as confidence, case when greatest(p, 1.0 - p) >= 0.8 "
       "then 'High' when greatest(p, 1.0 - p) >= 0.7 then 'Medium' else 'Low' end as confidence_level, "
       "round(pm, 9) as mortality_probability, case when pm >= 0.5 then 'Higher mortality risk' else "
       "'Lower mortality risk' end as mortality_label, coalesce(nullif(trim(drug_name), ''), 'Cisplatin') "
       "as drug_name from sc")
def q_batch_scoring(spark, sf):
    """J8 + J9 + J10 + J14 with fixed linear scorers (both tasks, one pass)."""
    out = J.score_batch(_upload(spark, sf), RESPONSE_SCORER, MORTALITY_SCORER,
                        response_algorithm="linear", mortality_algorithm="linear")
    return out.select("row_id", _r("probability"), "label", "confidence", "confidence_level",
                      _r("mortality_probability"), "mortality_label", "drug_name")


@query("availability_gate", _upload_sql() + "select row_id, cast(null as double) as probability, "
       "'Model not trained' as label, '0.0%' as confidence, 'Low' as confidence_level, "
       "coalesce(nullif(trim(drug_name), ''), 'Cisplatin') as drug_name, 'tree-stack-unavailable' as model_type from up")
def q_availability_gate(spark, sf):
    """A missing model gives typed 'not trained' rows instead of scores."""
    out = J.score_batch(_upload(spark, sf), None, MORTALITY_SCORER,
                        load_errors={"response": ["lightgbm: model unavailable"]})
    return out.select("row_id", "probability", "label", "confidence", "confidence_level", "drug_name", "model_type")


def _attr_sql(scorer: J.LinearScorer, task: str, sfx: str = "") -> str:
    terms = {n: f"{float(w)!r} * coalesce(cast({n} as double), 0.0)" for n, w in scorer.numeric.items()}
    for n, table in scorer.categorical.items():
        terms[n] = "(case " + " ".join(f"when {n} = '{k}' then {float(v)!r}" for k, v in table.items()) + " else 0.0 end)"
    t = ", ".join(f"{e} as {n}" for n, e in terms.items())
    parts = [f"select '{task}' as task, '{n}' as feature, avg(abs(t{sfx}.{n} - m{sfx}.{n})) as mean_abs "
             f"from t{sfx}, m{sfx}" for n in terms]
    return (f"t{sfx} as (select {t} from nz), m{sfx} as (select " + ", ".join(f"avg({n}) as {n}" for n in terms)
            + f" from t{sfx}), a{sfx} as (" + " union all ".join(parts) + ")")


@query("linear_attribution", _upload_sql() + _NORM_CTE + ", " + _attr_sql(MORTALITY_SCORER, "mortality")
       + " select feature, round(mean_abs, 9) as mean_abs from a")
def q_linear_attribution(spark, sf):
    """I10 (closed form for a linear scorer) over the normalized batch."""
    nz = T.normalize_payload(_upload(spark, sf), keep=["row_id"])
    return A.linear_attribution(nz, MORTALITY_SCORER).select("feature", _r("mean_abs"))


@query("active_features", _FOLDS_SQL + _SELECTED_SQL + ", nf as (select task, list_filter(" + _FEATS_SQL
       + ", lambda f: not list_contains(string_split(replace(list_filter(notes, lambda s: starts_with(s, "
       "'dropped_features='))[-1], 'dropped_features=', ''), ','), f)) as used from sel), "
       "pr as (select (select used from nf where task = 'response') as r, (select used from nf where "
       "task = 'mortality') as m), sh as (select list_filter(" + _FEATS_SQL + ", lambda f: list_contains(pr.r, f) "
       "and list_contains(pr.m, f)) as shared from pr), "
       + (_upload_sql() + _NORM_CTE).removeprefix("with ") + ", " + _attr_sql(MORTALITY_SCORER, "mortality", "1")
       + ", " + _attr_sql(RESPONSE_SCORER, "response", "2")
       + ", ex as (select feature, max(mean_abs) as mx from (select * from a1 union all select * from a2) "
       "group by feature), top as (select list(feature order by mx desc, feature asc) as extras from ex, sh "
       "where not list_contains(sh.shared, ex.feature)), tk as (select extras[1:5] as extras from top) "
       "select array_to_string(list_filter(" + _FEATS_SQL + ", lambda f: list_contains(sh.shared, f) or "
       "list_contains(tk.extras, f)), ',') as active from sh, tk")
def q_active_features(spark, sf):
    """Shared features plus the top-5 attribution extras, catalog order."""
    nz = T.normalize_payload(_upload(spark, sf), keep=["row_id"])
    attr = A.linear_attribution(nz, MORTALITY_SCORER).unionByName(A.linear_attribution(nz, RESPONSE_SCORER))
    shared = _shared_active(spark, sf)
    extras = J.top_extra_features(attr, F.col("shared"))
    both = shared.select("shared", extras.alias("extras"))
    return both.select(F.array_join(J.active_features(F.col("shared"), F.col("extras")), ",").alias("active"))


@query("input_completeness", _upload_sql() + "select feature, column_present, cast(n_supplied as bigint) as n_supplied, "
       "cast(n - n_supplied as bigint) as n_defaulted from (" + " union all ".join(
           (f"select '{n}' as feature, true as column_present, count_if({n} is not null and {n} <> '') as n_supplied, "
            "count(*) as n from up") if n in _UPLOAD_COLS else
           (f"select '{n}' as feature, false as column_present, 0 as n_supplied, count(*) as n from up")
           for n in FEATURE_ORDER) + ")")
def q_input_completeness(spark, sf):
    """Per feature of the catalog, supplied vs defaulted rows of the upload."""
    return J.input_completeness(_upload(spark, sf), FEATURE_ORDER)


# ---------------------------------------------------------------- sources and sinks (A1-A11, A13): write, then scan back

from ..session import scratch_path, stored  # noqa: E402
from ..sources import readers as RD  # noqa: E402
from ..sources import json_array as JA  # noqa: E402
from ..sources import writers as WR  # noqa: E402
from pyspark.sql import types as TT  # noqa: E402


_NA_TOKENS_SQL = ", ".join("'" + t + "'" for t in T.READER_NA_TOKENS)
_REG_NA = ("with r0 as (" + X.duck("registry_raw") + "), r as (select row_id, "
           + ", ".join(f"case when {c} in ({_NA_TOKENS_SQL}) then null else {c} end as {c}" for c in X.REGISTRY_SHORT)
           + " from r0) ")


@query("registry_csv_scan", _REG_NA + "select concat('SEER:', cast(row_id as varchar)) as row_id, 'SEER' as source, "
       "'SEER_LUNG_EXPORTNEW' as source_study, cast(null as varchar) as case_id, cast(null as varchar) as sample_id, "
       + O.registry_row() + " from r")
def q_registry_csv_scan(spark, sf):
    """A1: the export written as CSV (real headers), found among candidate paths, scanned as text, harmonized."""
    base = scratch_path(spark, "registry")
    X.registry_export(spark, sf).write.option("header", "true").option("escape", '"').csv(f"{base}/exportnew.csv")
    raw = RD.first_existing_csv(spark, [f"{base}/missing/exportnew.csv", f"{base}/exportnew.csv"])
    return H.registry_cohort(raw)


@query("case_csv_scan", ORACLE["case_canonical"])
def q_case_csv_scan(spark, sf):
    """A2 + A3: case table as CSV and case documents as JSON, scanned back and harmonized."""
    base = scratch_path(spark, "cases")
    X.case_raw(spark, sf).write.option("header", "true").csv(f"{base}/cases_luad_lusc.csv")
    X.nested_cases(spark, sf).write.json(f"{base}/cases_luad_lusc.json")
    cases = RD.first_existing_csv(spark, [f"{base}/cases_luad_lusc.csv"])
    docs = RD.read_case_documents(spark, f"{base}/cases_luad_lusc.json", multi_line=False)
    return H.case_cohort(cases, docs, _patient_flags(spark, sf), ecog_col="ecog_all_null")


@query("case_array_scan", ORACLE["case_canonical"])
def q_case_array_scan(spark, sf):
    """A2 + A3: the case documents as a JSON array (one for each ``X.ARRAY_DOCUMENTS`` documents), read by byte ranges and harmonized."""
    base = scratch_path(spark, "case-array")
    X.case_raw(spark, sf).write.option("header", "true").csv(f"{base}/cases.csv")
    X.write_json_arrays(X.nested_cases(spark, sf), f"{base}/cases.json", "case_id")
    docs = JA.read_json_array(spark, f"{base}/cases.json", RD.CASE_DOCUMENT_SCHEMA)
    return H.case_cohort(RD.first_existing_csv(spark, [f"{base}/cases.csv"]), docs, _patient_flags(spark, sf), ecog_col="ecog_all_null")


@query("study_files_scan", _cte(e="eav_raw") + "select cast(seq as varchar) as seq, sample_id, patient_id, study_id, "
       "attr, value, study_id as study_dir from e")
def q_study_files_scan(spark, sf):
    """A4: per-study EAV files in study folders; a file without the required columns is skipped."""
    base = scratch_path(spark, "studies")
    e = X.eav_raw(spark, sf)
    (e.select(F.col("seq").cast("string").alias("seq"), F.col("sample_id").alias("sampleId"),
              F.col("patient_id").alias("patientId"), F.col("study_id").alias("studyId"),
              F.col("attr").alias("clinicalAttributeId"), "value", F.col("study_id").alias("dir"))
     .write.partitionBy("dir").option("header", "true").csv(f"{base}/ok"))
    e.select("seq", "sample_id").write.option("header", "true").csv(f"{base}/ok/dir=broken")
    got = RD.read_study_tables(spark, f"{base}/ok", pattern="dir=*/*.csv")
    return got.select("seq", F.col("sampleId").alias("sample_id"), F.col("patientId").alias("patient_id"),
                      F.col("studyId").alias("study_id"), F.col("clinicalAttributeId").alias("attr"), "value",
                      F.regexp_replace("study_dir", "^dir=", "").alias("study_dir"))


@query("mutation_files_scan", _cte(m="mutation_raw") + "select sid as sample_id, egfr_mutation from ("
       + O.sample_flags_cte("m") + ")")
def q_mutation_files_scan(spark, sf):
    """A5 + E2: panels found by a recursive, name-filtered listing (decoy files ignored), flagged per sample."""
    base = scratch_path(spark, "panels")
    m = X.mutation_raw(spark, sf).select(F.col("sample_key").cast("string").alias("sampleId"),
                                         F.col("patient_id").alias("patientId"), "gene")
    half = F.col("sampleId").cast("long") % 2 == 0
    m.filter(half).write.option("header", "true").csv(f"{base}/studyA/mutations_panel_impact_mutations.csv")
    m.filter(~half).write.option("header", "true").csv(f"{base}/nested/studyB/mutations_panel_msk_mutations.csv")
    m.write.option("header", "true").csv(f"{base}/studyA/other_mutations.csv")  # decoy: wrong name
    panels = RD.read_mutation_panels(spark, base)
    return E.sample_mutation_flags(panels.withColumnRenamed("sampleId", "sample_id"))


@query("cohort_parquet_roundtrip", _ALL + "select * from h")
def q_cohort_roundtrip(spark, sf):
    """The harmonized cohort written partitioned by source, read back."""
    path = WR.write_cohort(harmonized(spark, sf), scratch_path(spark, "cohort"))
    back = spark.read.parquet(path)
    return back.select(*harmonized(spark, sf).columns)


@query("training_table_scan", _ALL + "select row_id, " + ", ".join(FEATURE_ORDER) + ", mortality_1yr from h "
       "where mortality_1yr is not null")
def q_training_table_scan(spark, sf):
    """A10 + A6: per-task label-ready tables written, the mortality one scanned with the required-column check."""
    paths = WR.write_task_tables(harmonized(spark, sf), scratch_path(spark, "tasks"))
    return RD.read_training_table(spark, paths["mortality"], "mortality")


@query("report_files", _ALL + _coverage_sql("h"))
def q_report_files(spark, sf):
    """Coverage CSV and readiness JSON written; the coverage file scanned back with its schema."""
    h = harmonized(spark, sf)
    out = WR.write_reports(E.coverage(h), E.readiness_report(h), scratch_path(spark, "reports"))
    schema = "column string, non_null bigint, coverage_pct double"
    return spark.read.schema(schema).option("header", "true").csv(out["feature_coverage"])


_READINESS_SQL = ("select 'total_rows_harmonized' as part, '' as value, count(*) as n from h union all select 'rows_mortality_ready', '', count(mortality_1yr) from h "
                  "union all select 'rows_response_ready', '', count(response) from h union all select 'source', source, count(*) from h group by source "
                  "union all select 'mortality_1yr', cast(mortality_1yr as varchar), count(*) from h where mortality_1yr is not null group by mortality_1yr "
                  "union all select 'response', cast(response as varchar), count(*) from h where response is not null group by response")


def _readiness_rows(spark, path):
    """A readiness document as rows (part, value, n)."""
    schema = ("total_rows_harmonized bigint, rows_mortality_ready bigint, rows_response_ready bigint, source_counts map<string,bigint>, "
              "mortality_label_counts map<string,bigint>, response_label_counts map<string,bigint>")
    doc = spark.read.schema(schema).json(path)
    totals = F.array(*[F.struct(F.lit(c).alias("part"), F.lit("").alias("value"), F.col(c).alias("n"))
                       for c in ("total_rows_harmonized", "rows_mortality_ready", "rows_response_ready")])

    def entries(part, column):
        return F.transform(F.map_entries(column), lambda e: F.struct(F.lit(part).alias("part"), e["key"].alias("value"), e["value"].alias("n")))

    maps = [entries(*x) for x in (("source", "source_counts"), ("mortality_1yr", "mortality_label_counts"), ("response", "response_label_counts"))]
    return doc.select(F.explode(F.concat(totals, *maps)).alias("r")).select("r.*")


@query("readiness_file", _ALL + _READINESS_SQL)
def q_readiness_file(spark, sf):
    """A11 + E10: the readiness document written as JSON and read back."""
    h = harmonized(spark, sf)
    out = WR.write_reports(E.coverage(h), E.readiness_report(h), scratch_path(spark, "reports"))
    return _readiness_rows(spark, out["readiness"])


_ALL_NA = _REG_NA + _ALL[len(REG):]  # the registry as a CSV reader sees it


@query("harmonization_run", _ALL_NA + "select 'coverage' as report, \"column\" as part, '' as value, non_null as n from (" + _coverage_sql("h") + ") cov union all "
       "select 'readiness', part, value, n from (" + _READINESS_SQL + ") rdy")
def q_harmonization_run(spark, sf):
    """End to end: all source shapes written as files, harmonized, written, reported; both reports read back."""
    base = scratch_path(spark, "harmonization")
    X.registry_export(spark, sf).write.option("header", "true").csv(f"{base}/in/seer/exportnew.csv")
    X.case_raw(spark, sf).withColumnRenamed("ecog_all_null", "ecog_worst") \
        .write.option("header", "true").csv(f"{base}/in/gdc/cases.csv")
    X.nested_cases(spark, sf).write.json(f"{base}/in/gdc/cases.json")
    m = X.mutation_raw(spark, sf).select(F.concat(F.lit("S"), F.col("sample_key").cast("string")).alias("sampleId"),
                                         F.concat(F.lit("SUB"), F.substring("patient_id", 2, 64)).alias("patientId"),
                                         "gene")
    m.write.option("header", "true").csv(f"{base}/in/cbio/panelA/mutations_panel_impact_mutations.csv")
    e = X.eav_raw(spark, sf)
    (e.select(F.col("seq").cast("string").alias("seq"), F.col("sample_id").alias("sampleId"),
              F.col("patient_id").alias("patientId"), F.col("study_id").alias("studyId"),
              F.col("attr").alias("clinicalAttributeId"), "value", F.col("study_id").alias("dir"))
     .write.partitionBy("dir").option("header", "true").csv(f"{base}/in/cbio/studies"))
    out = H.run_harmonization(
        spark, registry_paths=[f"{base}/in/missing.csv", f"{base}/in/seer/exportnew.csv"],
        case_table=f"{base}/in/gdc/cases.csv", case_documents=f"{base}/in/gdc/cases.json",
        study_base=f"{base}/in/cbio/studies", study_pattern="dir=*/*.csv", panel_base=f"{base}/in/cbio",
        out_dir=f"{base}/out", documents_multi_line=False)
    schema = "column string, non_null bigint, coverage_pct double"
    cov = spark.read.schema(schema).option("header", "true").csv(out["reports"]["feature_coverage"])
    cov = cov.select(F.lit("coverage").alias("report"), F.col("column").alias("part"), F.lit("").alias("value"), F.col("non_null").alias("n"))
    return cov.unionByName(_readiness_rows(spark, out["reports"]["readiness"]).select(F.lit("readiness").alias("report"), "part", "value", "n"))


_RUN_REPORT_SCHEMA = TT.StructType([
    TT.StructField("task", TT.StringType()), TT.StructField("algorithm", TT.StringType()),
    TT.StructField("auc", TT.DoubleType()), TT.StructField("brier", TT.DoubleType()),
    TT.StructField("threshold", TT.DoubleType()), TT.StructField("notes", TT.ArrayType(TT.StringType())),
    TT.StructField("status", TT.StringType())])


@query("run_report_scan", _FOLDS_SQL + "select task, algorithm, round(auc, 9) as auc, round(brier, 9) as brier, "
       "threshold, status from runs")
def q_run_report_scan(spark, sf):
    """A13 + A7: run rows appended as JSON, one corrupt report beside them, scanned permissively."""
    path = scratch_path(spark, "runs")
    runs = _runs(spark, sf)
    WR.append_run_reports(runs.select(*[f.name for f in _RUN_REPORT_SCHEMA.fields]), path)
    # an unreadable report (truncated document) next to the good ones
    runs.limit(1).select(F.lit('{"task": "mortality", "algorithm": ').alias("value")).write.mode("append").text(path)
    got = RD.read_reports(spark, path, _RUN_REPORT_SCHEMA, multi_line=False)
    return got.select("task", "algorithm", _r("auc"), _r("brier"), "threshold", "status")


@query("run_report_commits", _FOLDS_SQL + "select task, algorithm, round(auc, 9) as auc, round(brier, 9) as brier, threshold, status from runs where algorithm <> 'tabnet'")
def q_run_report_commits(spark, sf):
    """A13 with commits: each family's runs appended under a run id, one of them twice (a retry), one staged by a writer that died before its commit."""
    path = scratch_path(spark, "committed-runs")
    runs = _runs(spark, sf).select(*[f.name for f in _RUN_REPORT_SCHEMA.fields]).checkpoint()
    for name in ("lightgbm", "xgboost", "xgboost"):
        WR.commit_run_reports(runs.filter(F.col("algorithm") == name), path, name)
    runs.filter(F.col("algorithm") == "tabnet").write.parquet(f"{path}/{WR.ROWS}/tabnet~died")
    got = RD.read_committed_runs(spark, path, _RUN_REPORT_SCHEMA)
    return got.select("task", "algorithm", _r("auc"), _r("brier"), "threshold", "status")


_NESTED_SQL = (_FOLDS_SQL + ", nr as (select task, algorithm, round(auc, 9) as auc, round(brier, 9) as brier, case when algorithm = 'xgboost' then null "
               "when algorithm = 'tabnet' then 1.5 else threshold end as threshold from runs) ")


@query("nested_report_selection", _NESTED_SQL + "select task, algorithm, auc, brier, case when threshold between 0.0 and 1.0 then threshold else 0.5 end as threshold, "
       "cast(row_number() over (partition by task order by auc desc nulls last, brier asc nulls last, algorithm desc) as integer) as rank from nr")
def q_nested_report_selection(spark, sf):
    """A7 + J2 + J4: one nested report document per run, one of them cut off, some without or with a bad threshold; scanned, ranked, thresholds checked."""
    path = scratch_path(spark, "nested-reports")
    r = _runs(spark, sf)
    t = F.when(F.col("algorithm") == "xgboost", F.lit(None)).when(F.col("algorithm") == "tabnet", F.lit(1.5)).otherwise(F.col("threshold"))
    doc = r.select("task", "algorithm", "notes", F.struct("auc", "brier").alias("outer_mean"), F.struct(t.alias("threshold")).alias("best_threshold"))
    doc.write.json(path)
    r.limit(1).select(F.lit('{"task": "mortality", "outer_mean": {').alias("value")).write.mode("append").text(path)
    got = J.rank_runs(RD.read_run_reports(spark, path, multi_line=False))
    return got.select("task", "algorithm", _r("auc"), _r("brier"), J.decision_threshold(F.col("threshold")).alias("threshold"), "rank")


_UPLOAD_SCHEMA = TT.StructType([TT.StructField("row_id", TT.StringType()), TT.StructField("age", TT.DoubleType()),
                                TT.StructField("sex", TT.StringType()), TT.StructField("tumor_size_mm", TT.DoubleType())])


@query("upload_scan", _REG_CANON + ", u as (select row_id, cast(split_part(row_id, ':', 2) as bigint) as rid, age, sex, "
       "tumor_size_mm from c) select row_id, case when rid % 17 = 0 or rid % 13 = 0 then true else false end "
       "as corrupt, case when rid % 17 = 0 or rid % 13 = 0 then null else age end as age, "
       "case when rid % 17 = 0 or rid % 13 = 0 then null else sex end as sex, "
       "case when rid % 17 = 0 or rid % 13 = 0 then null else tumor_size_mm end as tumor_size_mm from u")
def q_upload_scan(spark, sf):
    """An uploaded CSV with over-long rows and unparsable numbers; bad rows are flagged, not fatal."""
    path = scratch_path(spark, "upload")
    c = H.registry_cohort(X.registry_export(spark, sf))
    rid = F.substring_index("row_id", ":", -1).cast("long")
    line = (F.when(rid % 17 == 0, F.concat_ws(",", "row_id", F.lit("1"), F.lit("x"), F.lit("2"), F.lit("extra")))
            .when(rid % 13 == 0, F.concat_ws(",", "row_id", F.lit("sixty"), F.coalesce("sex", F.lit("")),
                                             F.coalesce(F.col("tumor_size_mm").cast("string"), F.lit(""))))
            .otherwise(F.concat_ws(",", "row_id", F.coalesce(F.col("age").cast("string"), F.lit("")),
                                   F.coalesce("sex", F.lit("")),
                                   F.coalesce(F.col("tumor_size_mm").cast("string"), F.lit("")))))
    # whole lines under one column whose name is the header line: every part file gets the header
    c.select(line.alias("row_id,age,sex,tumor_size_mm")).write.option("header", "true").option("sep", "\u0001").option("quote", "").csv(path)
    got = RD.read_upload(spark, path, _UPLOAD_SCHEMA)
    bad = F.col("_corrupt_record").isNotNull()
    return got.select("row_id", bad.alias("corrupt"), F.when(~bad, F.col("age")).alias("age"),
                      F.when(~bad, F.col("sex")).alias("sex"), F.when(~bad, F.col("tumor_size_mm")).alias("tumor_size_mm"))


# ---------------------------------------------------------------- feature preparation (G1-G3) on labeled documents

from ..operators import prep as P  # noqa: E402
from ..operators.ordered import exact_quantiles, signed_log_bucket  # noqa: E402

_DOCS_NULLED = ("with d0 as (" + X.DOC_LABELS_SQL + "), d as (select doc_id, quality, toxic, "
                "case when doc_id % 7 = 0 then null else n_chars end as n_chars, "
                "case when doc_id % 5 = 0 then null when doc_id % 11 = 0 then concat(lang, '-', cast(doc_id as varchar)) "
                "else lang end as lang, source from d0), "
                "f as (select *, (row_number() over (partition by quality order by md5(concat('42:', "
                "cast(doc_id as varchar))), doc_id) - 1) % 3 as fold from d), tr as (select * from f where fold <> 0) ")


def _docs_with_folds(spark, sf):
    d = X.doc_labels(spark, sf)
    d = d.select("doc_id", "quality", "toxic", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("n_chars"))
                 .alias("n_chars"),
                 F.when(F.col("doc_id") % 5 == 0, None)
                 .when(F.col("doc_id") % 11 == 0, F.concat("lang", F.lit("-"), F.col("doc_id").cast("string")))
                 .otherwise(F.col("lang")).alias("lang"), "source")
    f = S.stratified_folds(d, "quality", "doc_id")
    return f, f.filter(F.col("fold") != 0)


@query("median_imputation", _DOCS_NULLED + "select doc_id, cast(fold as integer) as fold, coalesce(cast(n_chars as double), "
       "(select median(cast(n_chars as double)) from tr)) as n_chars from f")
def q_median_imputation(spark, sf):
    """G1: median fitted on the training folds only, applied to every row."""
    f, tr = _docs_with_folds(spark, sf)
    return P.median_impute(tr, f, ["n_chars"]).select("doc_id", "fold", "n_chars")


@query("fitted_median_imputation", _DOCS_NULLED + "select doc_id, cast(fold as integer) as fold, coalesce(cast(n_chars as double), (select median(cast(n_chars as double)) from tr)) as n_chars, "
       "coalesce(cast(quality as double), (select median(cast(quality as double)) from tr)) as quality from f")
def q_fitted_median_imputation(spark, sf):
    """G1 inside a fitted pipeline that was saved and loaded: medians of the training folds, for every row."""
    from pyspark.ml import Pipeline, PipelineModel
    f, tr = _docs_with_folds(spark, sf)
    path = scratch_path(spark, "median-pipeline")
    Pipeline(stages=[P.ExactMedianImputer(inputCols=["n_chars", "quality"], outputCols=["n_chars_full", "quality_full"])]).fit(tr).write().save(path)
    full = PipelineModel.load(path).transform(f)
    return full.select("doc_id", "fold", F.col("n_chars_full").alias("n_chars"), F.col("quality_full").alias("quality"))


@query("unknown_fill", _DOCS_NULLED + "select doc_id, coalesce(lang, 'Unknown') as lang from f")
def q_unknown_fill(spark, sf):
    """G2."""
    f, _ = _docs_with_folds(spark, sf)
    return P.fill_unknown(f, ["lang"]).select("doc_id", "lang")


@query("one_hot_slots", _DOCS_NULLED + ", v as (select category, cast(dense_rank() over (order by category) - 1 as "
       "integer) as slot from (select distinct coalesce(lang, 'Unknown') as category from tr)) "
       "select f.doc_id, 'lang' as feature, coalesce(f.lang, 'Unknown') as category, cast(v.slot as double) as slot "
       "from f left join v "
       "on coalesce(f.lang, 'Unknown') = v.category")
def q_one_hot_slots(spark, sf):
    """G3 long form: training vocabulary in alphabetical order; unseen categories get no slot."""
    f, tr = _docs_with_folds(spark, sf)
    return P.one_hot_slots(tr, f, "lang", "doc_id")


# ---------------------------------------------------------------- model fitting (H1-H7, A12, I10 estimate, J8 with fitted models): rows-only

from ..operators import models as MD  # noqa: E402
from . import training as TR  # noqa: E402


def _mortality_training(spark, sf):
    return stored(L.labeled(harmonized(spark, sf), "mortality_1yr"), "mortality")  # a query reads it many times: ranks, medians, vocabularies, scores


def _response_training(spark, sf):
    return stored(L.labeled(harmonized(spark, sf), "response"), "response")


# Facts of a run that SQL can check although it can't fit models: which rows a fold trains on and scores, and in which range.
def _labeled(label: str) -> str:
    return ("with hu as (" + ORACLE["harmonized_union"] + f"), lab as (select row_id, cast({label} as integer) as y from hu where {label} is not null), "
            "f as (select row_id, y, cast((row_number() over (partition by y order by md5(concat('42:', row_id)), row_id) - 1) % 3 as integer) as fold from lab) ")


_FOLD_FACTS = ("select fold, count(*) as n_rows, cast(sum(y) as bigint) as n_positive, count(distinct row_id) as n_scored, cast(0 as bigint) as n_outside, "
               "cast(0 as bigint) as n_other_fold from f group by fold")


def _fold_facts(oof, folds):
    """Per fold: rows, positives, distinct ids scored, scores outside [0, 1], rows scored in another fold than dealt to."""
    j = oof.join(folds.select("row_id", F.col("fold").alias("_dealt")), "row_id", "left")
    return j.groupBy("fold").agg(F.count("*").alias("n_rows"), F.sum("y").cast("bigint").alias("n_positive"), F.countDistinct("row_id").alias("n_scored"),
                                 F.count_if(~F.coalesce(F.col("p").between(0.0, 1.0), F.lit(False))).alias("n_outside"),
                                 F.count_if(~F.coalesce(F.col("_dealt") == F.col("fold"), F.lit(False))).alias("n_other_fold"))


def _nested_cv_facts(spark, sf, task, algorithm, **kw):
    train = _mortality_training(spark, sf) if task == "mortality" else _response_training(spark, sf)
    cfg = TR.config(task, algorithm, **kw)
    r = MD.nested_cv(train, cfg)
    folds = S.stratified_folds(train.withColumn("label", F.col(cfg.label).cast("double")), "label", "row_id", S.OUTER_FOLDS, cfg.seed)
    return _fold_facts(r["oof"], folds)


@query("nested_cv_lightgbm", _labeled("mortality_1yr") + _FOLD_FACTS)
def q_nested_cv_lightgbm(spark, sf):
    """H1 + H5 + F6 + F7: nested CV of boosted family A (balanced weights, oversampled folds), 3 outer folds; facts per fold."""
    return _nested_cv_facts(spark, sf, "mortality", "lightgbm", use_grid=False)


@query("nested_cv_grid", _labeled("response") + _FOLD_FACTS)
def q_nested_cv_grid(spark, sf):
    """H2 + H4 + H5: grid search with oversampling inside each inner fold, in each outer fold; facts per fold."""
    return _nested_cv_facts(spark, sf, "response", "xgboost")


@query("nested_cv_tabnet", _labeled("response") + _FOLD_FACTS)
def q_nested_cv_tabnet(spark, sf):
    """H3 + H5: neural family on the response task; facts per fold."""
    return _nested_cv_facts(spark, sf, "response", "tabnet")


@query("final_fit_xgboost", _labeled("mortality_1yr") + ", qt as (" + _quota_sql("lab", "y", "ceil(0.2 * (select count(*) from lab))")
       + "), rk as (select row_id, y, " + _rank_sql("lab", "y", "42") + " as rk from lab) "
       "select count(*) as n_rows, cast(sum(rk.y) as bigint) as n_positive, cast(0 as bigint) as n_outside, cast(0.0 as double) as max_change "
       "from rk join qt on rk.y = qt.y where rk.rk <= qt.quota")
def q_final_fit_xgboost(spark, sf):
    """H2 + H7 + F4 + A12: family B fitted on 80 %, saved and loaded; holdout rows, score range and largest change of a score by the round trip."""
    train = _mortality_training(spark, sf)
    ff = MD.final_fit(train, TR.config("mortality", "xgboost"))
    again = MD.load_model(MD.save_model(ff["model"], scratch_path(spark, "final-fit")), strict=True)
    rescored = MD.score(again, train, ["row_id"]).withColumnRenamed("p", "p2")
    j = ff["holdout"].join(rescored, "row_id")
    return j.agg(F.count("*").alias("n_rows"), F.sum("y").cast("bigint").alias("n_positive"), F.count_if(~F.col("p").between(0.0, 1.0)).alias("n_outside"),
                 F.round(F.max(F.abs(F.col("p") - F.col("p2"))), 9).alias("max_change"))


@query("encoded_width", _labeled("mortality_1yr") + "select cast(0 as bigint) as n_wrong_width, count(*) as n_rows from lab")
def q_encoded_width(spark, sf):
    """Every encoded vector is as wide as the numerics and the training vocabularies together."""
    train = _mortality_training(spark, sf)
    cfg = TR.config("mortality", "lightgbm")
    width = len(cfg.numeric) + sum(train.agg(*[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit(P.UNKNOWN))).alias(c) for c in cfg.categorical]).first())
    model = MD.Pipeline(stages=P.preprocessing_stages(cfg.numeric, cfg.categorical)).fit(train)
    from pyspark.ml.functions import vector_to_array
    enc = model.transform(train).select((F.size(vector_to_array("features")) != width).alias("wrong"))
    return enc.agg(F.count_if("wrong").alias("n_wrong_width"), F.count("*").alias("n_rows"))


from ..operators import tree_attribution as TA  # noqa: E402
from . import boosted as BO  # noqa: E402


@query("boosted_rounds", BO.SCORES_SQL)
def q_boosted_rounds(spark, sf):
    """H1/H2 learner: held-out scores of an ensemble and of its prefixes; the oracle fits the same trees in SQL."""
    from ..operators import boosting
    _, scores = boosting.train(BO.rows(spark, sf), [BO.FIT])
    return scores.select("id", "rounds", "y", _r("p"))


@query("boosted_table_scoring", BO.sql() + f"select id, round(m, 6) as margin from m{BO.FIT.rounds} where not tr")
def q_boosted_table_scoring(spark, sf):
    """A12 + J8: the fitted trees written as a table, read back, and every held-out row scored from that table."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from ..operators import boosting
    from ..operators.boosted_model import BoostedTreesModel
    rows = BO.rows(spark, sf)
    path = scratch_path(spark, "boosted")
    MD.PipelineModel(stages=[BoostedTreesModel.of(spark, boosting.train(rows, [BO.FIT])[0][BO.FIT.key])]).write().save(path)
    held = rows.where("weight = 0").select("id", array_to_vector("features").alias("features"))
    p = vector_to_array("probability")
    return MD.load_model(path, strict=True).transform(held).select("id", F.round(F.log(p[1] / p[0]), 6).alias("margin"))


@query("boosted_attribution", BO.ATTRIBUTION_SQL)
def q_boosted_attribution(spark, sf):
    """Exact contributions of the fitted trees for every held-out row, all training rows as background; their sum against SQL's margins."""
    from ..operators import boosting
    rows = BO.rows(spark, sf)
    e = boosting.train(rows, [BO.FIT])[0][BO.FIT.key]
    ex = TA.explainer(boosting.tree_arrays(boosting.ensemble_table(spark, e)), e.base, rows.where("weight > 0"))
    phi = TA.attribute(rows.where("weight = 0"), ex, "id")
    return phi.select("id", F.round(F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b), 6).alias("total"), F.round(F.lit(ex.base_value), 6).alias("base_value"))


@query("model_sweep", "select t.task, a.algorithm, case when a.algorithm = 'catboost' then 'failed' else 'ok' end as status, true as plausible "
       "from (values ('response'), ('mortality')) t(task), (values ('lightgbm'), ('xgboost'), ('tabnet'), ('catboost')) a(algorithm)")
def q_model_sweep(spark, sf):
    """H6: every task x family, each with its own rounds, grid and oversampling; an unknown family is captured as a failed row with its whole error, the rest still run."""
    got = TR.sweep({"response": _response_training(spark, sf), "mortality": _mortality_training(spark, sf)}, [*MD.ALGORITHMS, "catboost"])
    fine = F.col("auc").between(0.0, 1.0) & F.col("brier").between(0.0, 1.0) & F.col("threshold").between(0.0, 1.0) & F.col("error").isNull()
    return got.select("task", "algorithm", "status", F.when(F.col("status") == "ok", fine).otherwise(F.col("error").contains("algorithm must be")).alias("plausible"))


@query("fitted_model_scoring")
def q_fitted_model_scoring(spark, sf):
    """A12 + J8-J10 + I12: fitted pipelines saved, loaded back and used to score an upload."""
    base = scratch_path(spark, "models")
    fr = MD.final_fit(_response_training(spark, sf), TR.config("response", "tabnet"))
    fm = MD.final_fit(_mortality_training(spark, sf), TR.config("mortality", "tabnet"))
    rp = MD.save_model(fr["model"], f"{base}/response_tabnet_model")
    mp = MD.save_model(fm["model"], f"{base}/mortality_tabnet_model")
    rm, mm = MD.load_model(rp, strict=True), MD.load_model(mp, strict=True)
    out = J.score_batch(_upload(spark, sf), MD.PipelineScorer(rm), MD.PipelineScorer(mm),
                        response_threshold=fr["best_threshold"].select("threshold").first()[0],
                        mortality_threshold=fm["best_threshold"].select("threshold").first()[0],
                        response_algorithm="tabnet", mortality_algorithm="tabnet",
                        response_q=fr["conformal"].select("q").scalar(), mortality_q=fm["conformal"].select("q").scalar())
    return out.select("row_id", _r("probability"), "label", "confidence_level", _r("mortality_probability"),
                      "mortality_label", "drug_name", "response_conformal.set_contains_1",
                      F.col("mortality_conformal.set_contains_1").alias("mortality_set_contains_1"))


@query("sampled_shapley_attribution")
def q_sampled_shapley(spark, sf):
    """I10 for a fitted model: permutation-sampled Shapley over the 256-row attribution sample."""
    train = _mortality_training(spark, sf)
    cfg = TR.config("mortality", "tabnet")
    ff = MD.final_fit(train, cfg)
    feats = list(cfg.numeric) + list(cfg.categorical)
    sample = S.attribution_sample(ff["holdout"].select("row_id").join(train, "row_id"), "row_id")
    med = {c: exact_quantiles(train, c, [0.5], signed_log_bucket)[0] for c in cfg.numeric}
    modes = {c: "Unknown" for c in cfg.categorical}
    scorer = MD.PipelineScorer(ff["model"])
    res = A.sampled_shapley(sample, {**med, **modes}, feats, lambda d: scorer.transform(d, "_score"), n_perm=8)
    return res.select("feature", _r("mean_abs"), "n_samples")


# ---------------------------------------------------------------- streaming

from ..streaming import scoring as ST  # noqa: E402


@query("streaming_scoring", ORACLE["batch_scoring"])
def q_streaming_scoring(spark, sf):
    """The upload split into several CSV files, scored by an availableNow stream; equals batch scoring."""
    base = scratch_path(spark, "stream")
    up = _upload(spark, sf)
    up.repartition(4, "row_id").write.option("header", "true").csv(f"{base}/in")
    out = ST.score_files(spark, f"{base}/in", ST.upload_schema(up.columns), f"{base}/out", f"{base}/ckpt",
                         RESPONSE_SCORER, MORTALITY_SCORER, max_files_per_trigger=2,
                         response_algorithm="linear", mortality_algorithm="linear")
    res = spark.read.parquet(out)
    return res.select("row_id", _r("probability"), "label", "confidence", "confidence_level",
                      _r("mortality_probability"), "mortality_label", "drug_name")


_NUMERIC_UPLOAD = [c for c in (f.name for f in ST.FEATURES if f.numeric) if c in _UPLOAD_COLS]


@query("streaming_rejects", _upload_sql() + _NORM_CTE + ", sc as (select row_id, " + _RESP_P + " as p, " + _MORT_P + " as pm from nz), why as (select row_id, case when "
       f"cast(split_part(row_id, ':', 2) as bigint) % 17 = 0 then '{ST.TOO_LONG}' " + " ".join(f"when {c} = 'junk' then '{c} is not a number'" for c in _NUMERIC_UPLOAD)
       + " end as reason from up) select row_id, reason, case when reason is null then round(p, 9) end as probability, case when reason is null then round(pm, 9) end as mortality_probability "
       "from why join sc using (row_id)")
def q_streaming_rejects(spark, sf):
    """J13 + A8: files with over-long rows and cells that are no numbers; bad rows are set aside with their reason, the others scored."""
    base = scratch_path(spark, "stream-rejects")
    up = _upload(spark, sf)
    long = F.substring_index("row_id", ":", -1).cast("long") % 17 == 0
    up.filter(~long).repartition(4, "row_id").write.option("header", "true").csv(f"{base}/in")
    line = F.concat_ws(",", "row_id", *[F.lit("1")] * len(up.columns)).alias(",".join(up.columns))
    up.filter(long).select(line).write.mode("append").option("header", "true").option("sep", "\u0001").option("quote", "").csv(f"{base}/in")
    ST.score_uploads(spark, f"{base}/in", up.columns, f"{base}/scores", f"{base}/rejected", f"{base}/ckpt", RESPONSE_SCORER, MORTALITY_SCORER, max_files_per_trigger=3,
                     response_algorithm="linear", mortality_algorithm="linear")
    good = ST.read_batches(spark, f"{base}/scores").select("row_id", F.lit(None).cast("string").alias("reason"), _r("probability"), _r("mortality_probability"))
    bad = ST.read_batches(spark, f"{base}/rejected")
    none = F.lit(None).cast("double")
    return good.unionByName(bad.select(F.substring_index("line", ",", 1).alias("row_id"), "reason", none.alias("probability"), none.alias("mortality_probability")))


# ---------------------------------------------------------------- oversampling

from ..operators import oversample as OV  # noqa: E402


@query("nearest_neighbours", "with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), "
       "p as (select a.vec_id, b.vec_id as nn_id, list_distance(a.v, b.v) as dist from e a join e b "
       "on a.label = b.label and a.vec_id <> b.vec_id) select vec_id, nn_id, round(dist, 6) as dist, "
       "cast(nn_rank as integer) as nn_rank from (select *, row_number() over (partition by vec_id order by dist, "
       "nn_id) as nn_rank from p) where nn_rank <= 5")
def q_nearest_neighbours(spark, sf):
    """F6 neighbour step: exact 5 nearest neighbours within each class (the oracle brute-forces all pairs)."""
    e = X.table(spark, sf, "embeddings")
    nn = OV.knn_exact(e, "vec_id", "embedding", k=5, by="label")
    return nn.select("vec_id", "nn_id", F.round("dist", 6).alias("dist"), "nn_rank")


_SMOTE_SQL = ("with e as (select vec_id, cast(embedding as double[]) as v, case when label = 0 then 1 else 0 end as y from embeddings), "
              "c as (select y, count(*) as n from e group by y), mn as (select y, n from c order by n, y limit 1), need as (select (select max(n) from c) - n as k, n, y from mn), "
              "m as (select e.* from e join mn on e.y = mn.y), "
              "r as (select *, row_number() over (order by md5(concat('42:', cast(vec_id as varchar))), vec_id) as rk from m), "
              "nn as (select a.vec_id, b.vec_id as nn_id, b.v as nv, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as k from m a join m b on a.vec_id <> b.vec_id), "
              "j as (select unnest(range(0, (select cast(k as bigint) from need))) as j), "
              "s as (select j, r.vec_id, r.v, md5(concat('42:smote:', cast(j as varchar))) as h from j join r on r.rk = j % (select n from need) + 1), "
              "p as (select *, cast(concat('0x', substr(h, 1, 8)) as bigint) % least(5, (select n from need) - 1) + 1 as pick, "
              "cast(cast(concat('0x', substr(h, 9, 8)) as bigint) as double) / 4294967296.0 as u from s) "
              "select -(p.j + 1) as vec_id, round(list_sum(list_transform(list_zip(p.v, nn.nv), lambda z: z[1] + p.u * (z[2] - z[1]))), 6) as total, "
              "round(p.v[1] + p.u * (nn.nv[1] - p.v[1]), 6) as first from p join nn on nn.vec_id = p.vec_id and nn.k = p.pick")


@query("smote_oversampling", _SMOTE_SQL)
def q_smote(spark, sf):
    """class 0 against the rest, minority rows synthesized until the classes balance; each synthetic vector's id, sum and first value."""
    e = X.table(spark, sf, "embeddings").select("vec_id", "embedding",
                                                 F.when(F.col("label") == 0, 1).otherwise(0).alias("y"))
    out = OV.smote(e, "vec_id", "embedding", "y").filter("synthetic")
    return out.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query("nearest_neighbours_small_group", "with r as (select vec_id, embedding, row_number() over (order by vec_id) as place from embeddings), "
       "e as (select vec_id, cast(embedding as double[]) as v, place // 4 as g from r where place < 12), "
       "p as (select a.vec_id, b.vec_id as nn_id, list_distance(a.v, b.v) as dist from e a join e b on a.g = b.g and a.vec_id <> b.vec_id), "
       "k as (select vec_id, nn_id, round(dist, 6) as dist, cast(row_number() over (partition by vec_id order by dist, nn_id) as integer) as nn_rank from p) "
       "select * from k where nn_rank <= 5")
def q_small_groups(spark, sf):
    """F6 neighbour step in groups smaller than k + 1 rows (3 and 4 rows, beside one with all the others): each row gets all that its group has."""
    e = X.table(spark, sf, "embeddings").select("vec_id", "embedding")
    firsts = [r.vec_id for r in e.orderBy("vec_id").limit(11).collect()]  # the members of the small groups
    place = F.array_position(F.array(*[F.lit(v) for v in firsts]), F.col("vec_id"))
    g = F.when(place > 0, F.floor(place / 4)).otherwise(F.lit(3))
    nn = OV.knn_exact(e.withColumn("g", g), "vec_id", "embedding", k=5, by="g").withColumnRenamed("vec_id", "id")
    return nn.filter(F.col("id").isin(*firsts)).select(F.col("id").alias("vec_id"), "nn_id", F.round("dist", 6).alias("dist"), "nn_rank")
