"""Outcome labels and row filters.

NULL means "unlabeled", never 0; every rule is a CASE WHEN chain so the
registry path stays a map-only, codegen'd projection.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import USEFUL_FEATURES
from .text import to_number

ONE_YEAR_MONTHS = 12.0
ONE_YEAR_DAYS = 365.0


def registry_mortality(survival_months: Column, vital_status: Column) -> Column:
    """Dead within 12 months -> 1, dead later -> 0, alive >= 12 months -> 0, else NULL."""
    sm = to_number(survival_months)
    vital = F.lower(vital_status.cast("string"))
    return (F.when((vital == "dead") & (sm <= ONE_YEAR_MONTHS), F.lit(1.0))
            .when((vital == "dead") & (sm > ONE_YEAR_MONTHS), F.lit(0.0))
            .when((vital == "alive") & (sm >= ONE_YEAR_MONTHS), F.lit(0.0)))


def case_mortality(vital_status: Column, days_to_death: Column, days_to_follow_up: Column) -> Column:
    """1-year mortality from death days, falling back to follow-up days."""
    dead = F.coalesce(F.lower(vital_status.cast("string")), F.lit("")) == "dead"
    dtd = to_number(days_to_death)
    dlfu = to_number(days_to_follow_up)
    return (F.when(dead & (dtd <= ONE_YEAR_DAYS), F.lit(1.0))
            .when(dead & (dtd > ONE_YEAR_DAYS), F.lit(0.0))
            .when(dead & dtd.isNull() & (dlfu <= ONE_YEAR_DAYS), F.lit(1.0))
            .when(dead & dtd.isNull() & (dlfu > ONE_YEAR_DAYS), F.lit(0.0))
            .when(~dead & (dlfu >= ONE_YEAR_DAYS), F.lit(0.0)))


def case_response(tumor_free_count: Column, with_tumor_count: Column, best_response: Column) -> Column:
    """D3: negative evidence ('with tumor') wins over positive ('tumor free')."""
    tf = to_number(tumor_free_count)
    wt = to_number(with_tumor_count)
    text = F.lower(best_response.cast("string"))
    negative = F.coalesce(wt > 0, F.lit(False)) | F.coalesce(text.contains("with tumor"), F.lit(False))
    positive = F.coalesce(tf > 0, F.lit(False)) | F.coalesce(text.contains("tumor free"), F.lit(False))
    return F.when(negative, F.lit(0.0)).when(positive, F.lit(1.0))


def has_any_feature(cols: Sequence[str] = USEFUL_FEATURES) -> Column:
    """D4 predicate: at least one useful feature is non-null."""
    cond = None
    for c in cols:
        cond = F.col(c).isNotNull() if cond is None else (cond | F.col(c).isNotNull())
    return cond


def keep_useful_rows(df: DataFrame, cols: Sequence[str] = USEFUL_FEATURES) -> DataFrame:
    """Keep rows with at least one useful feature.

    The predicate reads the *recoded* columns.  A plain ``filter`` would be
    pushed below the recoding projection with every recode rule inlined
    into it (each rule evaluated twice, and a predicate too large for one
    generated method), so the test is applied as a generator over the
    projected columns: ``explode`` of a one-element array for kept rows and
    of NULL for dropped ones.  Same rows, recodes computed once.
    """
    cond = has_any_feature([c for c in cols if c in df.columns])
    marker = "_keep_row"
    return (df.select("*", F.explode(F.when(cond, F.array(F.lit(True)))).alias(marker))
            .drop(marker))


def labeled(df: DataFrame, label: str) -> DataFrame:
    """Keep rows whose label is known."""
    return df.filter(F.col(label).isNotNull())
