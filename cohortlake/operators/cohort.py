"""Cohort assembly operators: pivots, flags, nested arrays, lookups, unions, reports."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import FEATURE_ORDER, LABEL_COLUMNS
from ..functions.recode import gene_symbol
from ..functions.text import clean_text, to_number

# --- fixed values -------------------------------------------------------------
STUDY_ATTRIBUTES = ("AGE_AT_SEQ_REPORTED_YEARS", "PREDOMINANT_HISTOLOGIC_SUBTYPE", "PATHOLOGIC_STAGE")
TARGET_GENE = "EGFR"
MUTATED_LABEL = "Exon19del"
WILD_TYPE_LABEL = "Wild_type"
DAYS_PER_YEAR = 365.25
# --- end of fixed values --------------------------------------------------------

COVERAGE_COLUMNS = FEATURE_ORDER + LABEL_COLUMNS


def eav_pivot(eav: DataFrame, keys: Sequence[str] = ("sample_id", "patient_id", "study_id"),
              attr: str = "attr", value: str = "value", seq: str = "seq",
              attributes: Sequence[str] = STUDY_ATTRIBUTES) -> DataFrame:
    """First non-null value per (keys, attribute), one row per entity.

    One hash aggregation (partial aggregation map-side, so a hot entity is
    pre-combined before the shuffle).  Entities whose values are all NULL or
    whose keys are NULL are dropped, as are rows without an attribute; an
    entity with values only for other attributes survives as an all-NULL row.
    'First' is defined by ``seq``.
    """
    rows = eav.filter(F.col(value).isNotNull() & F.col(attr).isNotNull())
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    aggs = [F.min_by(F.when(F.col(attr) == a, F.col(value)), F.when(F.col(attr) == a, F.col(seq))).alias(a)
            for a in attributes]
    return rows.groupBy(*keys).agg(*aggs)


def _flag(has_target: Column, mutated_label: str) -> Column:
    return F.when(has_target, F.lit(mutated_label)).otherwise(F.lit(WILD_TYPE_LABEL))


def sample_mutation_flags(mutations: DataFrame, sample: str = "sample_id", gene: str = "gene",
                          target: str = TARGET_GENE, mutated_label: str = MUTATED_LABEL) -> DataFrame:
    """Per sample seen in any row, mutated if any row names the target gene."""
    sym = gene_symbol(F.col(gene))
    return (mutations.select(F.col(sample).cast("string").alias(sample),
                             F.coalesce(sym == target, F.lit(False)).alias("_hit"))
            .filter(F.col(sample).isNotNull())
            .groupBy(sample).agg(F.max("_hit").alias("_any"))
            .select(sample, _flag(F.col("_any"), mutated_label).alias("egfr_mutation")))


def patient_mutation_flags(mutations: DataFrame, patient: str = "patient_id", gene: str = "gene",
                           target: str = TARGET_GENE, mutated_label: str = MUTATED_LABEL) -> DataFrame:
    """Per patient, over rows with a parsable gene only; the target wins."""
    sym = gene_symbol(F.col(gene))
    return (mutations.select(F.col(patient).cast("string").alias(patient), sym.alias("_sym"))
            .filter(F.col("_sym").isNotNull() & F.col(patient).isNotNull())
            .groupBy(patient).agg(F.max(F.col("_sym") == target).alias("_any"))
            .select(patient, _flag(F.col("_any"), mutated_label).alias("egfr_mutation")))


def mutation_flags(mutations: DataFrame, sample: str = "sample_id", patient: str = "patient_id",
                   gene: str = "gene", target: str = TARGET_GENE,
                   mutated_label: str = MUTATED_LABEL) -> tuple[DataFrame, DataFrame]:
    """E2 and E3 from ONE scan and ONE shuffle: a grouping-sets aggregate keyed by sample or by patient.

    Sample flags see every row; patient flags only rows with a parsable gene
    (a patient with none gets no flag).  Returns (sample_flags, patient_flags).
    """
    sym = gene_symbol(F.col(gene))
    rows = mutations.select(F.col(sample).cast("string").alias("_s"), F.col(patient).cast("string").alias("_p"),
                            sym.alias("_sym"))
    hit = F.coalesce(F.col("_sym") == target, F.lit(False))
    agg = (rows.groupingSets([["_s"], ["_p"]], "_s", "_p")
           .agg(F.max(hit).alias("_any"), F.count("_sym").alias("_parsed"),
                F.grouping_id().alias("_gid")))
    samples = (agg.filter((F.col("_gid") == 1) & F.col("_s").isNotNull())  # grouped by sample (patient rolled up)
               .select(F.col("_s").alias(sample), _flag(F.col("_any"), mutated_label).alias("egfr_mutation")))
    patients = (agg.filter((F.col("_gid") == 2) & (F.col("_parsed") > 0) & F.col("_p").isNotNull())
                .select(F.col("_p").alias(patient), _flag(F.col("_any"), mutated_label).alias("egfr_mutation")))
    return samples, patients


def case_document_values(cases: DataFrame, case_id: str = "case_id", follow_ups: str = "follow_ups",
                         diagnoses: str = "diagnoses") -> DataFrame:
    """E4 + E5: one row per case, from a projection of its documents (no explode).

    Several documents of one case are one case: the largest status of any of
    them counts, and one 'yes' among their treatments.  Documents without a
    case id belong to no case.
    """
    values = cases.select(F.col(case_id).cast("string").alias(case_id), *_follow_up_max_cols(follow_ups),
                          _prior_flag_col(diagnoses))
    return _one_per_case(values, case_id)


def _one_per_case(values: DataFrame, case_id: str) -> DataFrame:
    known = values.filter(F.col(case_id).isNotNull() & (F.col(case_id) != ""))
    return known.groupBy(case_id).agg(*[F.max(c).alias(c) for c in values.columns if c != case_id])


def _follow_up_max_cols(follow_ups: str) -> list[Column]:
    def arr_max(field: str) -> Column:
        vals = F.transform(F.col(follow_ups), lambda fu: to_number(fu[field]))
        return F.array_max(F.filter(vals, lambda v: v.isNotNull()))
    return [arr_max("ecog_performance_status").alias("ecog_max"),
            arr_max("karnofsky_performance_status").alias("karnofsky_max")]


def _prior_flag_col(diagnoses: str) -> Column:
    low = lambda d: F.lower(clean_text(d["prior_treatment"]))
    yes = F.exists(F.col(diagnoses), lambda d: F.coalesce(low(d) == "yes", F.lit(False)))
    no = F.exists(F.col(diagnoses), lambda d: F.coalesce(low(d) == "no", F.lit(False)))
    return F.when(yes, F.lit(1.0)).when(no, F.lit(0.0)).alias("prior_treatment")


def follow_up_maxima(cases: DataFrame, case_id: str = "case_id", follow_ups: str = "follow_ups") -> DataFrame:
    """Max ECOG and max Karnofsky over each case's follow-up arrays (no explode)."""
    return _one_per_case(cases.select(F.col(case_id).cast("string").alias(case_id), *_follow_up_max_cols(follow_ups)), case_id)


def prior_treatment_flag(cases: DataFrame, case_id: str = "case_id", diagnoses: str = "diagnoses") -> DataFrame:
    """E5: any 'yes' -> 1, else any 'no' -> 0, else NULL."""
    return _one_per_case(cases.select(F.col(case_id).cast("string").alias(case_id), _prior_flag_col(diagnoses)), case_id)


def lookup_join(df: DataFrame, lookup: DataFrame, left_key: Column | str, right_key: str,
                values: Sequence[str]) -> DataFrame:
    """Left lookup on a text-cast key; the lookup is unique by key, so no fan-out.

    No broadcast hint: the lookup is an aggregate whose size grows with the
    data, so the planner decides from its size estimate
    (``spark.sql.autoBroadcastJoinThreshold``) and AQE re-plans at runtime.
    """
    lk = F.col(left_key) if isinstance(left_key, str) else left_key
    right = lookup.select(F.col(right_key).cast("string").alias("_lk"), *values)
    return (df.withColumn("_lk", lk.cast("string"))
            .join(right, "_lk", "left")
            .drop("_lk"))


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def days_to_years(c: Column) -> Column:
    """B11."""
    return to_number(c) / DAYS_PER_YEAR


def column_fallback(df: DataFrame, primary: Column, fallback: Column) -> Column:
    """Use ``fallback`` for every row iff ``primary`` is NULL in the whole column.

    The column-wide test is a scalar subquery (one aggregate job, then a
    constant), so there is no join and no single-partition window.
    """
    non_null = df.select(F.count(primary)).scalar()
    return F.when(non_null == 0, fallback).otherwise(primary)


def column_fallbacks(df: DataFrame, pairs: Sequence[tuple[Column, Column]]) -> list[Column]:
    """B13 for several columns with ONE scalar subquery (all non-null counts in one aggregate)."""
    counts = df.select(F.struct(*[F.count(p).alias(f"c{i}") for i, (p, _) in enumerate(pairs)])).scalar()
    return [F.when(counts[f"c{i}"] == 0, fb).otherwise(p) for i, (p, fb) in enumerate(pairs)]


def karnofsky_to_ecog(ecog: Column, karnofsky: Column) -> Column:
    """ECOG, else clip(round_half_even((100 - KPS) / 20), 0, 4)."""
    derived = F.least(F.lit(4.0), F.greatest(F.lit(0.0), F.bround((100.0 - karnofsky) / 20.0, 0)))
    return F.coalesce(ecog, derived)


def coverage(df: DataFrame, columns: Sequence[str] = COVERAGE_COLUMNS) -> DataFrame:
    """One row per column: non-null count and percent (2 dp, 0.0 on an empty table).

    One scan, one global aggregate (partial per task), then an unpivot of
    the single result row.
    """
    wide = df.agg(F.count(F.lit(1)).alias("_total"), *[F.count(F.col(c)).alias(c) for c in columns])
    long = wide.unpivot(["_total"], list(columns), "column", "non_null")
    pct = F.when(F.col("_total") > 0, F.bround(F.lit(100.0) * F.col("non_null") / F.col("_total"), 2)) \
        .otherwise(F.lit(0.0))
    return long.select("column", F.col("non_null").cast("bigint").alias("non_null"), pct.alias("coverage_pct"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value including the NULL group, stacked as (column, value, n).

    One grouping-sets aggregate: a single pass and shuffle for all columns.
    """
    cols = list(columns)
    strs = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    agg = strs.groupingSets([[c] for c in cols], *cols).agg(F.count(F.lit(1)).alias("n"),
                                                             F.grouping_id().alias("_gid"))
    k = len(cols)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(cols):
        gid = (1 << k) - 1 - (1 << (k - 1 - i))  # every column rolled up except c
        name = F.when(F.col("_gid") == gid, F.lit(c)).otherwise(name)
        value = F.when(F.col("_gid") == gid, F.col(c)).otherwise(value)
    return agg.select(name.alias("column"), value.alias("value"), "n")


def readiness(df: DataFrame, sources: Sequence[str] = ("SEER", "GDC", "cBio")) -> DataFrame:
    """One-row readiness summary from a single aggregate."""
    m, r = F.col("mortality_1yr"), F.col("response")
    aggs = [F.count(F.lit(1)).alias("total_rows_harmonized"),
            F.count(m).alias("rows_mortality_ready"),
            F.count(r).alias("rows_response_ready")]
    aggs += [F.count_if(F.col("source") == s).alias(f"rows_{s.lower()}") for s in sources]
    aggs += [F.count_if(m == 1.0).alias("mortality_pos"), F.count_if(m == 0.0).alias("mortality_neg"),
             F.count_if(r == 1.0).alias("response_pos"), F.count_if(r == 0.0).alias("response_neg")]
    return df.agg(*aggs)


def readiness_report(df: DataFrame) -> DataFrame:
    """E10 in the nested JSON shape: totals plus count maps per source and label.

    One grouping-sets pass gives the counts per source and per label value
    (a handful of rows); a final aggregate folds them into maps.
    """
    m, r = F.col("mortality_1yr"), F.col("response")
    base = df.select(F.col("source").cast("string").alias("s"), m.cast("string").alias("m"),
                     r.cast("string").alias("r"))
    g = base.groupingSets([["s"], ["m"], ["r"]], "s", "m", "r").agg(F.count(F.lit(1)).alias("v"),
                                                                   F.grouping_id().alias("_gid"))

    def as_map(gid: int, key: str, skip_null: bool) -> Column:
        keep = (F.col("_gid") == gid) & (F.col(key).isNotNull() if skip_null else F.lit(True))
        entries = F.collect_list(F.when(keep, F.struct(F.coalesce(F.col(key), F.lit("null")).alias("k"), "v")))
        return F.map_from_entries(F.array_sort(entries))

    def total(keep: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, F.col("v"))), F.lit(0))
    return g.agg(total(F.col("_gid") == 3).alias("total_rows_harmonized"),
                 total((F.col("_gid") == 5) & F.col("m").isNotNull()).alias("rows_mortality_ready"),
                 total((F.col("_gid") == 6) & F.col("r").isNotNull()).alias("rows_response_ready"),
                 as_map(3, "s", False).alias("source_counts"),
                 as_map(5, "m", True).alias("mortality_label_counts"),
                 as_map(6, "r", True).alias("response_label_counts"))
