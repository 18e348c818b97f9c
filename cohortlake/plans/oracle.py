"""DuckDB SQL fragments for the independent oracle.

Hand-written SQL for each rule (not generated from the Spark rule
tables), so a mistake in one engine's version shows up as a mismatch.
"""

from __future__ import annotations


def clean(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return (f"(case when {t} = '' or lower({t}) in ('nan','na','not available','[not available]','unknown') "
            f"then null else {t} end)")


def num(x: str) -> str:
    s = f"cast({x} as varchar)"
    return (f"(case when regexp_matches({s}, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') "
            f"then try_cast(trim({s}) as double) end)")


def age(x: str) -> str:
    t = clean(x)
    rng = "'([0-9]+)\\s*-\\s*([0-9]+)'"
    return (f"(case when regexp_extract({t}, {rng}, 1) <> '' then "
            f"(cast(regexp_extract({t}, {rng}, 1) as double) + cast(regexp_extract({t}, {rng}, 2) as double)) / 2.0 "
            f"when regexp_extract({t}, '([0-9]+)\\+', 1) <> '' then cast(regexp_extract({t}, '([0-9]+)\\+', 1) as double) + 2.0 "
            f"when regexp_extract({t}, '([0-9]+)', 1) <> '' then cast(regexp_extract({t}, '([0-9]+)', 1) as double) end)")


def sex(x: str, legacy: bool = False) -> str:
    t = clean(x)
    l = f"lower({t})"
    if legacy:
        return f"(case when {t} is null then null when contains({l}, 'male') then 'Male' when contains({l}, 'female') then 'Female' else {t} end)"
    return f"(case when {t} is null then null when contains({l}, 'female') then 'Female' when contains({l}, 'male') then 'Male' else {t} end)"


def stage(x: str, legacy: bool = False) -> str:
    t = clean(x)
    if legacy:
        s = f"replace(replace({t}, 'stage', ''), 'Stage', '')"
    else:
        s = f"regexp_replace({t}, '(?i)stage', '', 'g')"
    s = f"replace(regexp_replace({s}, '^\\s+|\\s+$', '', 'g'), ' ', '')"
    return f"(case when {s} <> '' then {s} end)"


def histology(x: str, legacy: bool = False) -> str:
    t = clean(x)
    l = f"lower({t})"
    small = f"contains({l}, 'small') and contains({l}, 'cell')"
    if not legacy:
        small += f" and not contains({l}, 'non-small') and not contains({l}, 'non small')"
    return (f"(case when {t} is null then null when contains({l}, 'adeno') then 'Adenocarcinoma' "
            f"when contains({l}, 'squamous') then 'Squamous' when {small} then 'Small_cell' "
            f"when contains({l}, 'large') and contains({l}, 'cell') then 'Large_cell' else {t} end)")


def race(x: str, legacy: bool = False) -> str:
    t = clean(x)
    l = f"lower({t})"
    asian = (f"(contains({l}, 'asian') or contains({l}, 'pacific'))" if legacy
             else f"(regexp_matches({l}, '\\basian\\b') or contains({l}, 'pacific'))")
    return (f"(case when {t} is null then null when contains({l}, 'white') then 'White' "
            f"when contains({l}, 'black') then 'Black' when {asian} then 'Asian_or_Pacific_Islander' "
            f"when contains({l}, 'indian') or contains({l}, 'alaska') then 'American_Indian_Alaska_Native' "
            f"when contains({l}, 'unknown') then 'Unknown' else 'Other' end)")


def marital(x: str, legacy: bool = False) -> str:
    t = clean(x)
    l = f"lower({t})"
    married = f"when contains({l}, 'married') then 'Married'"
    single = f"when contains({l}, 'single') and contains({l}, 'never') then 'Single'"
    partner = f"when contains({l}, 'domestic') or contains({l}, 'unmarried') then 'Unmarried_partner'"
    rest = (f"when contains({l}, 'divorc') then 'Divorced' when contains({l}, 'widow') then 'Widowed' "
            f"when contains({l}, 'separat') then 'Separated'")
    order = (f"{married} {single} {rest} {partner}" if legacy else f"{single} {partner} {married} {rest}")
    return f"(case when {t} is null then null {order} else 'Unknown' end)"


def tnm(x: str) -> str:
    u = f"replace(upper({clean(x)}), ' ', '')"
    return f"(case when {u} in ('BLANK(S)','BLANK','UNKNOWN','N/A','NA') then 'Unknown' else {u} end)"


def three(x: str) -> str:
    t = clean(x)
    d = f"regexp_extract({t}, '([0-9]{{1,3}})', 1)"
    return (f"(case when lower({t}) in ('blank(s)','unable to calculate','unknown') then null "
            f"when {d} = '' then null when cast({d} as double) >= 990 then null else cast({d} as double) end)")


def yesno(x: str) -> str:
    l = f"lower({clean(x)})"
    return f"(case when starts_with({l}, 'yes') then 1.0::double when starts_with({l}, 'no') then 0.0::double end)"


def radiation(x: str, legacy: bool = False) -> str:
    t = clean(x)
    l = f"lower({t})"
    comb = f"when contains({l}, 'combination') then 'Combination_radiation'"
    body = (f"when contains({l}, 'beam') then 'Beam_radiation' "
            f"when contains({l}, 'implants') or contains({l}, 'brachytherapy') then 'Radioactive_implants' "
            f"when contains({l}, 'radioisotopes') then 'Radioisotopes'")
    mid = f"{body} {comb}" if legacy else f"{comb} {body}"
    return (f"(case when {t} is null then null when contains({l}, 'none/unknown') then 'None_or_Unknown' {mid} "
            f"when contains({l}, 'refused') then 'Refused' "
            f"when contains({l}, 'recommended') and contains({l}, 'unknown') then 'Recommended_unknown' "
            f"else 'Other' end)")


def gene(x: str) -> str:
    t = clean(x)
    g = f"regexp_extract({t}, 'hugoGeneSymbol=([A-Za-z0-9_\\-]+)', 1)"
    return (f"(case when {g} <> '' then upper({g}) "
            f"when regexp_matches({t}, '^\\p{{L}}{{1,12}}$') then upper({t}) end)")


def registry_mortality(s: str, v: str) -> str:
    sm, vl = num(s), f"lower({v})"
    return (f"(case when {vl} = 'dead' and {sm} <= 12 then 1.0::double when {vl} = 'dead' and {sm} > 12 then 0.0::double "
            f"when {vl} = 'alive' and {sm} >= 12 then 0.0::double end)")


def case_mortality(v: str, dtd: str, dlfu: str) -> str:
    dead = f"coalesce(lower({v}), '') = 'dead'"
    a, b = num(dtd), num(dlfu)
    return (f"(case when {dead} and {a} <= 365 then 1.0::double when {dead} and {a} > 365 then 0.0::double "
            f"when {dead} and {a} is null and {b} <= 365 then 1.0::double "
            f"when {dead} and {a} is null and {b} > 365 then 0.0::double "
            f"when not ({dead}) and {b} >= 365 then 0.0::double end)")


def case_response(tf: str, wt: str, text: str) -> str:
    l = f"lower(cast({text} as varchar))"
    neg = f"coalesce({num(wt)} > 0, false) or coalesce(contains({l}, 'with tumor'), false)"
    pos = f"coalesce({num(tf)} > 0, false) or coalesce(contains({l}, 'tumor free'), false)"
    return f"(case when {neg} then 0.0::double when {pos} then 1.0::double end)"


def registry_row(prefix: str = "", legacy: bool = False) -> str:
    """Canonical registry columns (excluding meta) over the registry recipe."""
    p = prefix
    return ", ".join([
        f"{age(p + 'age_raw')} as age", f"{sex(p + 'sex_raw', legacy)} as sex",
        f"{race(p + 'race_raw', legacy)} as race_recode", f"{marital(p + 'marital_raw', legacy)} as marital_status",
        f"{histology(p + 'hist_raw', legacy)} as histology", f"{stage(p + 'stage_raw', legacy)} as cancer_stage",
        f"{tnm(p + 't_raw')} as t_stage", f"{tnm(p + 'n_raw')} as n_stage", f"{tnm(p + 'm_raw')} as m_stage",
        "cast(null as double) as performance_status",
        f"coalesce({three(p + 'tumor_raw')}, {three(p + 'tumor_summary_raw')}) as tumor_size_mm",
        f"{yesno(p + 'mets_raw')} as mets_lung_dx", f"{yesno(p + 'chemo_raw')} as chemotherapy_cycles",
        f"{radiation(p + 'radiation_raw', legacy)} as radiation_recode",
        f"{three(p + 'delay_raw')} as treatment_delay_days", "cast(null as varchar) as egfr_mutation",
        f"{registry_mortality(p + 'survival_raw', p + 'vital_raw')} as mortality_1yr",
        "cast(null as double) as response",
    ])


def nested_lookup_cte(f: str = "f") -> str:
    """Per-case ECOG/Karnofsky maxima and prior-treatment flag from the flat follow-up rows."""
    pt = f"lower({clean('prior_treatment')})"
    return (f"select cast(case_id as varchar) as k, "
            f"case when case_id % 10 = 0 then null else max({num('ecog')}) end as ecog_max, "
            f"case when case_id % 10 = 0 then null else max({num('karnofsky')}) end as karnofsky_max, "
            f"case when bool_or(coalesce({pt} = 'yes', false)) then 1.0::double "
            f"when bool_or(coalesce({pt} = 'no', false)) then 0.0::double end as prior_treatment "
            f"from {f} group by case_id")


def patient_flags_cte(m: str = "m", patient_expr: str = "patient_id") -> str:
    g = gene("gene")
    return (f"select {patient_expr} as pid, case when bool_or({g} = 'EGFR') then 'Exon19del' else 'Wild_type' end "
            f"as egfr_mutation from {m} where {g} is not null group by {patient_expr}")


def sample_flags_cte(m: str = "m", sample_expr: str = "cast(sample_key as varchar)") -> str:
    g = gene("gene")
    return (f"select {sample_expr} as sid, case when bool_or(coalesce({g} = 'EGFR', false)) then 'Exon19del' "
            f"else 'Wild_type' end as egfr_mutation from {m} group by {sample_expr}")


def case_canonical(c: str = "c", n: str = "n", pf: str = "pf", ecog_col: str = "ecog_all_null") -> str:
    """GDC rows in canonical form (needs CTEs c = case_raw, n = nested lookups, pf = patient flags)."""
    ecog = (f"(case when (select count({ecog_col}) from {c}) = 0 then {n}.ecog_max "
            f"else {num(c + '.' + ecog_col)} end)")
    karn = (f"(case when (select count(karnofsky_best) from {c}) = 0 then {n}.karnofsky_max "
            f"else {num(c + '.karnofsky_best')} end)")
    perf = f"coalesce({ecog}, least(4.0, greatest(0.0, round_even((100.0 - {karn}) / 20.0, 0))))"
    return (f"select concat('GDC:', cast({c}.case_id as varchar)) as row_id, 'GDC' as source, "
            f"coalesce(cast({c}.project_id as varchar), 'GDC') as source_study, cast({c}.case_id as varchar) as case_id, "
            f"cast(null as varchar) as sample_id, {num(c + '.age_at_diagnosis_days')} / 365.25 as age, "
            f"{sex(c + '.gender')} as sex, cast(null as varchar) as race_recode, cast(null as varchar) as marital_status, "
            f"{histology(c + '.primary_diagnosis')} as histology, {stage(c + '.tumor_stage')} as cancer_stage, "
            f"cast(null as varchar) as t_stage, cast(null as varchar) as n_stage, cast(null as varchar) as m_stage, "
            f"{perf} as performance_status, cast(null as double) as tumor_size_mm, cast(null as double) as mets_lung_dx, "
            f"{n}.prior_treatment as chemotherapy_cycles, cast(null as varchar) as radiation_recode, "
            f"cast(null as double) as treatment_delay_days, {pf}.egfr_mutation as egfr_mutation, "
            f"{case_mortality(c + '.vital_status', c + '.days_to_death', c + '.days_to_last_follow_up')} as mortality_1yr, "
            f"{case_response(c + '.tf_tumor_free_count', c + '.wt_with_tumor_count', c + '.best_disease_response')} as response "
            f"from {c} left join {n} on cast({c}.case_id as varchar) = {n}.k "
            f"left join {pf} on {c}.submitter_id = {pf}.pid")


def eav_pivot_cte(e: str = "e") -> str:
    return (f"select sample_id, patient_id, study_id, "
            f"min_by(value, seq) filter (where attr = 'AGE_AT_SEQ_REPORTED_YEARS') as AGE_AT_SEQ_REPORTED_YEARS, "
            f"min_by(value, seq) filter (where attr = 'PREDOMINANT_HISTOLOGIC_SUBTYPE') as PREDOMINANT_HISTOLOGIC_SUBTYPE, "
            f"min_by(value, seq) filter (where attr = 'PATHOLOGIC_STAGE') as PATHOLOGIC_STAGE "
            f"from {e} where value is not null and sample_id is not null and patient_id is not null "
            f"and study_id is not null group by sample_id, patient_id, study_id")


def study_canonical(p: str = "p", sf: str = "sfl") -> str:
    """cBio rows in canonical form (needs CTEs p = pivot, sfl = sample flags)."""
    return (f"select concat_ws(':', 'cBio', {p}.study_id, {p}.patient_id, {p}.sample_id) as row_id, 'cBio' as source, "
            f"{p}.study_id as source_study, {p}.patient_id as case_id, {p}.sample_id as sample_id, "
            f"{num(p + '.AGE_AT_SEQ_REPORTED_YEARS')} as age, cast(null as varchar) as sex, "
            f"cast(null as varchar) as race_recode, cast(null as varchar) as marital_status, "
            f"{histology(p + '.PREDOMINANT_HISTOLOGIC_SUBTYPE')} as histology, {stage(p + '.PATHOLOGIC_STAGE')} as cancer_stage, "
            f"cast(null as varchar) as t_stage, cast(null as varchar) as n_stage, cast(null as varchar) as m_stage, "
            f"cast(null as double) as performance_status, cast(null as double) as tumor_size_mm, "
            f"cast(null as double) as mets_lung_dx, cast(null as double) as chemotherapy_cycles, "
            f"cast(null as varchar) as radiation_recode, cast(null as double) as treatment_delay_days, "
            f"{sf}.egfr_mutation as egfr_mutation, cast(null as double) as mortality_1yr, cast(null as double) as response "
            f"from {p} left join {sf} on {p}.sample_id = {sf}.sid")


def normalize(dtype: str, expr: str, default) -> str:
    """B6/B7 in DuckDB: NULL or '' -> default; ints truncate toward zero; bad text -> default."""
    s = f"cast({expr} as varchar)"
    if dtype in ("int", "binary"):
        d = f"cast({int(default)} as integer)"
        parsed = f"try_cast(trunc(try_cast({s} as double)) as integer)"
    elif dtype == "float":
        d = f"cast({float(default)} as double)"
        parsed = f"try_cast({s} as double)"
    else:
        d = f"'{default}'"
        parsed = s
    return f"(case when {s} is null or {s} = '' then {d} else coalesce({parsed}, {d}) end)"


def linear_logit(intercept: float, numeric: dict, categorical: dict) -> str:
    parts = [repr(float(intercept))]
    for n, w in numeric.items():
        parts.append(f"{float(w)!r} * coalesce(cast({n} as double), 0.0)")
    for n, table in categorical.items():
        cases = " ".join(f"when {n} = '{k}' then {float(v)!r}" for k, v in table.items())
        parts.append(f"(case {cases} else 0.0 end)")
    return " + ".join(parts)
