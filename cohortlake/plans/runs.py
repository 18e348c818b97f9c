"""Run evaluation plan: folds -> fold metrics -> summary/CI -> holdout threshold -> runs table.

Input is a long (task, algorithm, row_id, y, p) table of out-of-fold
scores; every step is a grouped aggregate keyed by (task, algorithm[, fold]),
so all runs are evaluated in one pass instead of a driver loop per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import DROP_FEATURES_BY_TASK, TASK_LABEL
from ..operators import evaluate as V
from ..operators import sampling as S
from ..session import checkpoint_root

RUN = ["task", "algorithm"]
FOLD_METRICS = V.METRIC_NAMES + ["auc", "brier"]


def with_folds(scores: DataFrame, k: int = S.OUTER_FOLDS, seed=S.DEFAULT_SEED) -> DataFrame:
    return S.stratified_folds(scores, "y", "row_id", k, seed, by=RUN)


def fold_metrics(scores: DataFrame) -> DataFrame:
    """Per (task, algorithm, fold): I1-I3 on the fold's held-out rows."""
    return V.evaluate(with_folds(scores), groups=[*RUN, "fold"])


def dropped_note(task: F.Column) -> F.Column:
    notes = F.lit(None).cast("array<string>")
    for t, drop in DROP_FEATURES_BY_TASK.items():
        notes = F.when(task == t, F.array(F.lit("dropped_features=" + ",".join(sorted(drop))))).otherwise(notes)
    return F.coalesce(notes, F.array().cast("array<string>"))


def runs_table(scores: DataFrame) -> DataFrame:
    """One row per (task, algorithm) shaped like a run report."""
    checkpoint_root(scores.sparkSession)
    fm = fold_metrics(scores).checkpoint()  # a row per run and fold, used twice
    summary = V.fold_summary(fm, RUN, FOLD_METRICS)
    ci = V.auc_ci(fm, RUN)
    test = S.holdout_split(scores, "y", "row_id", by=RUN).filter(F.col("split") == "test")
    best = V.best_threshold(test, groups=RUN)
    cal = V.evaluate(test, groups=RUN)
    n = scores.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n_rows"))
    label_col = F.lit(None).cast("string")
    for t, lab in TASK_LABEL.items():
        label_col = F.when(F.col("task") == t, F.lit(lab)).otherwise(label_col)
    runs = (n.join(summary, RUN).join(ci, RUN).join(best.select(*RUN, "threshold", "f1"), RUN)
            .join(cal.select(*RUN, *[F.col(m).alias(f"cal_{m}") for m in FOLD_METRICS]), RUN)
            .select(*RUN, "n_rows", label_col.alias("label_col"), dropped_note(F.col("task")).alias("notes"),
                    F.col("auc_mean").alias("auc"), F.col("brier_mean").alias("brier"),
                    *[F.col(f"{m}_mean") for m in FOLD_METRICS], *[F.col(f"{m}_std") for m in FOLD_METRICS],
                    F.col("n_folds").alias("ci_n_folds"), F.col("lower").alias("ci_lower"),
                    F.col("upper").alias("ci_upper"), "threshold", F.col("f1").alias("threshold_f1"),
                    *[F.col(f"cal_{m}") for m in FOLD_METRICS],
                    F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")))
    return runs.checkpoint()  # a row per run: ranking, selection and reports read it again and again
