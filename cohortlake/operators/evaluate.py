"""Evaluation operators over (y, p[, group]) tables.

All are aggregates and bounded windows; none collects rows to the driver.
``groups`` lets one call evaluate many runs/folds at once.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import GROUPED_PROB_BUCKETS, PROB_BUCKETS, cumulative_before, exact_quantiles, prob_bucket, signed_log_bucket

# --- fixed values -------------------------------------------------------------
THRESHOLD_GRID = [float(x) for x in np.linspace(0.2, 0.8, 61)]  # sweep grid (numpy doubles)
INCUMBENT_THRESHOLD = 0.5
CALIBRATION_QUANTILES = [float(x) for x in np.linspace(0.0, 1.0, 11)[1:-1]]  # inner edges of 10 quantile bins
HISTOGRAM_EDGES = [float(x) for x in np.linspace(0.0, 1.0, 21)]  # 20 equal bins on [0, 1]
# --- end of fixed values --------------------------------------------------------

METRIC_NAMES = ["accuracy", "balanced_accuracy", "precision", "recall", "f1"]


def _ratio(num: Column, den: Column) -> Column:
    """num/den, 0.0 on zero division."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def metrics_from_counts(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    pos, neg = tp + fn, tn + fp
    n = pos + neg
    recall = _ratio(tp, pos)
    spec = _ratio(tn, neg)
    bal = (F.when((pos > 0) & (neg > 0), (recall + spec) / 2.0)
           .when(pos > 0, recall).otherwise(spec))
    return {
        "accuracy": _ratio(tp + tn, n),
        "balanced_accuracy": bal,
        "precision": _ratio(tp, tp + fp),
        "recall": recall,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def confusion_counts(y: Column, p: Column, threshold: float | Column) -> list[Column]:
    pred = p >= threshold
    return [F.count_if(pred & (y == 1)).alias("tp"), F.count_if(pred & (y == 0)).alias("fp"),
            F.count_if(~pred & (y == 0)).alias("tn"), F.count_if(~pred & (y == 1)).alias("fn")]


def threshold_metrics(df: DataFrame, y: str = "y", p: str = "p", threshold: float = INCUMBENT_THRESHOLD,
                      groups: Sequence[str] = ()) -> DataFrame:
    """I1 (+ I3 Brier): one aggregate per group."""
    agg = df.groupBy(*groups).agg(*confusion_counts(F.col(y), F.col(p), threshold),
                                  F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    m = metrics_from_counts(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return agg.select(*groups, *[m[k].alias(k) for k in METRIC_NAMES], "brier")


def brier(df: DataFrame, y: str = "y", p: str = "p", groups: Sequence[str] = ()) -> DataFrame:
    """I3."""
    return df.groupBy(*groups).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def _score_counts(df: DataFrame, y: str, p: str, groups: Sequence[str]) -> DataFrame:
    return (df.groupBy(*groups, F.col(p).alias("_s"))
            .agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg")))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p", groups: Sequence[str] = (),
            probabilities: bool = True) -> DataFrame:
    """Mann-Whitney AUC with ties counted as 1/2; NULL when a class is absent.

    Rows collapse to distinct scores first; negatives below each score come
    from a two-level running sum, never a global window.  Scores that are not
    probabilities (``probabilities=False``) use a signed log-scale bucket.
    """
    d = _score_counts(df, y, p, groups)
    nb = GROUPED_PROB_BUCKETS if groups else PROB_BUCKETS
    bucket = prob_bucket(F.col("_s"), nb) if probabilities else signed_log_bucket(F.col("_s"))
    c = cumulative_before(d, "_s", ["neg"], bucket, groups)
    num = F.col("pos").cast("double") * (2.0 * F.col("neg_before") + F.col("neg"))
    agg = c.groupBy(*groups).agg(F.sum(num).alias("_num"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                 F.col("_num") / (2.0 * F.col("_p").cast("double") * F.col("_n")))
    return agg.select(*groups, auc.alias("auc"))


def evaluate(df: DataFrame, y: str = "y", p: str = "p", threshold: float = INCUMBENT_THRESHOLD,
             groups: Sequence[str] = (), probabilities: bool = True) -> DataFrame:
    """I1-I3 together (the metric struct of a run report) from ONE distinct-score table.

    Rows collapse to (groups, score) -> (pos, neg) once; confusion counts at
    the threshold, the Brier sum (pos*(s-1)^2 + neg*s^2) and the AUC
    numerator all aggregate that table, so the input is read and shuffled once.
    """
    groups = list(groups)
    d = _score_counts(df, y, p, groups)
    nb = GROUPED_PROB_BUCKETS if groups else PROB_BUCKETS
    bucket = prob_bucket(F.col("_s"), nb) if probabilities else signed_log_bucket(F.col("_s"))
    c = cumulative_before(d, "_s", ["neg"], bucket, groups)
    s, pos, neg = F.col("_s"), F.col("pos"), F.col("neg")
    above = s >= threshold
    agg = c.groupBy(*groups).agg(
        F.sum(F.when(above, pos).otherwise(0)).alias("tp"), F.sum(F.when(above, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, neg).otherwise(0)).alias("tn"), F.sum(F.when(~above, pos).otherwise(0)).alias("fn"),
        F.sum(pos * F.pow(s - 1.0, 2) + neg * F.pow(s, 2)).alias("_sq"),
        F.sum(pos.cast("double") * (2.0 * F.col("neg_before") + neg)).alias("_num"),
        F.sum(pos).alias("_p"), F.sum(neg).alias("_n"))
    m = metrics_from_counts(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                 F.col("_num") / (2.0 * F.col("_p").cast("double") * F.col("_n")))
    return agg.select(*groups, *[m[k].alias(k) for k in METRIC_NAMES],
                      (F.col("_sq") / (F.col("_p") + F.col("_n"))).alias("brier"), auc.alias("auc"))


def best_threshold(df: DataFrame, y: str = "y", p: str = "p", groups: Sequence[str] = (),
                   grid: Sequence[float] = THRESHOLD_GRID, incumbent: float = INCUMBENT_THRESHOLD) -> DataFrame:
    """Maximise F1 over the grid, ties by accuracy, then the incumbent, then the lowest threshold.

    p is bucketed on the grid (bucket k = number of thresholds <= p), so the
    sweep runs on len(grid)+1 rows per group: threshold i predicts positive
    exactly for buckets k >= i+1.
    """
    groups = list(groups)
    g = len(grid)
    edges = F.array(*[F.lit(t) for t in grid])
    k = F.size(F.filter(edges, lambda t: t <= F.col(p)))
    counts = (df.groupBy(*groups, k.alias("_k"))
              .agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg")))
    totals = counts.groupBy(*groups).agg(F.sum("_pos").alias("P"), F.sum("_neg").alias("N"))
    full = (totals.select(*groups, "P", "N", F.explode(F.sequence(F.lit(0), F.lit(g))).alias("_k"))
            .join(counts, [*groups, "_k"], "left"))
    w = Window.partitionBy(*groups).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sweep = (full.select(*groups, "_k", "P", "N",
                         F.sum(F.coalesce("_pos", F.lit(0))).over(w).alias("tp"),
                         F.sum(F.coalesce("_neg", F.lit(0))).over(w).alias("fp"))
             .filter(F.col("_k") >= 1)
             .withColumn("i", F.col("_k") - 1)
             .withColumn("threshold", F.element_at(edges, F.col("_k"))))
    m = metrics_from_counts(F.col("tp"), F.col("fp"), F.col("N") - F.col("fp"), F.col("P") - F.col("tp"))
    scored = sweep.select(*groups, "i", "threshold", *[m[n].alias(n) for n in METRIC_NAMES])
    prio = F.when(F.col("threshold") == incumbent, F.lit(-1)).otherwise(F.col("i"))
    pick = F.max_by(F.struct(*[F.col(n) for n in ["threshold"] + METRIC_NAMES]),
                    F.struct(F.col("f1"), F.col("accuracy"), (-prio).alias("_p")))
    return (scored.groupBy(*groups).agg(pick.alias("_best"))
            .select(*groups, *[F.col(f"_best.{n}").alias(n) for n in ["threshold"] + METRIC_NAMES]))


def roc_curve(df: DataFrame, y: str = "y", p: str = "p", groups: Sequence[str] = (),
              drop_intermediate: bool = True, include_origin: bool = True) -> DataFrame:
    """ROC points (threshold, tps, fps, fpr, tpr) over distinct scores, thresholds descending.

    ``drop_intermediate`` keeps a point only where the curve bends (a non-zero
    second difference of fps or tps) plus both ends, the usual default;
    ``include_origin`` adds the (0, 0) point at threshold +inf.  Neighbouring
    points come from a window inside each score bucket plus the edge points
    of the adjacent buckets (a bounded table), never from a global window.
    """
    groups = list(groups)
    d = _score_counts(df, y, p, groups)
    b = prob_bucket(F.col("_s"), GROUPED_PROB_BUCKETS if groups else PROB_BUCKETS)
    c = cumulative_before(d.withColumn("_rb", b), "_s", ["pos", "neg"], F.col("_rb"), groups, descending=True)
    c = c.withColumn("tps", F.col("pos_before") + F.col("pos")).withColumn("fps", F.col("neg_before") + F.col("neg"))
    tot = d.groupBy(*groups).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if drop_intermediate:
        inb = Window.partitionBy(*groups, "_rb").orderBy(F.col("_s").desc())
        c = (c.withColumn("_ptps", F.lag("tps").over(inb)).withColumn("_pfps", F.lag("fps").over(inb))
             .withColumn("_ntps", F.lead("tps").over(inb)).withColumn("_nfps", F.lead("fps").over(inb)))
        # first / last point of every bucket, and the neighbouring buckets' edge points (bounded table)
        edges = c.groupBy(*groups, "_rb").agg(
            F.max_by(F.struct("tps", "fps"), "_s").alias("_first"), F.min_by(F.struct("tps", "fps"), "_s").alias("_last"))
        eb = Window.partitionBy(*groups).orderBy(F.col("_rb").desc())
        edges = edges.select(*groups, "_rb", F.lag("_last").over(eb).alias("_prev_last"),
                             F.lead("_first").over(eb).alias("_next_first"))
        c = c.join(edges, [*groups, "_rb"])
        ptps = F.coalesce("_ptps", F.col("_prev_last.tps"))
        pfps = F.coalesce("_pfps", F.col("_prev_last.fps"))
        ntps = F.coalesce("_ntps", F.col("_next_first.tps"))
        nfps = F.coalesce("_nfps", F.col("_next_first.fps"))
        end = ptps.isNull() | ntps.isNull()
        bend = ((pfps - 2 * F.col("fps") + nfps) != 0) | ((ptps - 2 * F.col("tps") + ntps) != 0)
        c = c.filter(end | bend)
    pts = c.select(*groups, F.col("_s").alias("threshold"), "tps", "fps")
    if include_origin:
        origin = tot.select(*groups, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tps"),
                            F.lit(0).cast("long").alias("fps"))
        pts = pts.unionByName(origin)
    j = pts.join(tot, groups) if groups else pts.select("*", tot.select("P").scalar().alias("P"),
                                                        tot.select("N").scalar().alias("N"))
    return j.filter((F.col("P") > 0) & (F.col("N") > 0)).select(
        *groups, "threshold", "tps", "fps", (F.col("fps") / F.col("N")).alias("fpr"),
        (F.col("tps") / F.col("P")).alias("tpr"))


def calibration_curve(df: DataFrame, y: str = "y", p: str = "p", exact: bool = True) -> DataFrame:
    """I8: 10 quantile bins; bin = number of inner edges strictly below p; empty bins dropped.

    Edges are exact linear-interpolation percentiles from order statistics
    (``ordered.exact_quantiles``), or ``approx_percentile`` with ``exact=False``.
    """
    if exact:
        edges = exact_quantiles(df, p, CALIBRATION_QUANTILES)
    else:
        q = F.array(*[F.lit(v) for v in CALIBRATION_QUANTILES])
        edges = list(df.select(F.percentile_approx(F.col(p), q, 100000)).first()[0])
    # nine fitted edges (bounded metadata); bin = number of edges strictly below p
    b = sum(F.when(F.lit(e) < F.col(p), 1).otherwise(0) for e in edges if e is not None)
    return (df.groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(p)).alias("mean_predicted"),
                 F.avg(F.col(y).cast("double")).alias("fraction_positive")))


def probability_histogram(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Counts per class over 20 equal bins on [0, 1] (last bin closed; outside values skipped)."""
    bz = Bucketizer(splits=HISTOGRAM_EDGES, inputCol="_p", outputCol="_bin", handleInvalid="skip")
    binned = bz.transform(df.select(F.col(y).alias("y"), F.col(p).cast("double").alias("_p")))
    lo = F.array(*[F.lit(v) for v in HISTOGRAM_EDGES])
    return (binned.groupBy("y", F.col("_bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("y", "bin", F.element_at(lo, F.col("bin") + 1).alias("bin_lo"),
                    F.element_at(lo, F.col("bin") + 2).alias("bin_hi"), "n"))


def fold_summary(fold_metrics: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """I4: mean and sample standard deviation (ddof=1) of each metric over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return fold_metrics.groupBy(*groups).agg(*aggs)


def auc_ci(fold_metrics: DataFrame, groups: Sequence[str], auc: str = "auc", z: float = 1.96) -> DataFrame:
    """Normal-approximation 95 % CI of the fold AUCs, clamped to [0, 1]; n < 2 gives no bounds."""
    finite = F.col(auc).isNotNull() & ~F.isnan(F.col(auc))
    agg = (fold_metrics.filter(finite).groupBy(*groups)
           .agg(F.count(F.lit(1)).alias("n_folds"), F.avg(auc).alias("mean"), F.stddev_samp(auc).alias("_sd")))
    se = F.col("_sd") / F.sqrt(F.col("n_folds"))
    two = F.col("n_folds") >= 2
    return agg.select(*groups, F.lit("normal_approx_over_outer_folds").alias("method"), "n_folds", "mean",
                      F.when(two, F.greatest(F.lit(0.0), F.col("mean") - z * se)).alias("lower"),
                      F.when(two, F.least(F.lit(1.0), F.col("mean") + z * se)).alias("upper"))
