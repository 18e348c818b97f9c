"""Deterministic stratified sampling, folds, holdout and class weights.

Randomness is md5('<seed>:<id>'), never ``rand()``: a recomputed task
(e.g. after an executor loss) draws the same rows.  Per-class ranks use
``ordered.stratified_rank`` so a class never lands in a single task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import hash_key, stratified_rank

DEFAULT_SEED = 42
OUTER_FOLDS = 3
INNER_FOLDS = 2
HOLDOUT_FRACTION = 0.2
ATTRIBUTION_SAMPLE = 256


def class_quotas(df: DataFrame, label: str, total_fn, by: Sequence[str] = ()) -> DataFrame:
    """Per-class quota by largest remainder (ties: lower label first), inside each ``by`` group.

    ``total_fn`` maps the group's row count (a Column) to the number of rows
    to take.  Works on the class-count table (one row per group x class), so
    its windows are bounded.
    """
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_nc"))
    grp = Window.partitionBy(*by)
    c = counts.select(*by, label, "_nc", F.sum("_nc").over(grp).alias("_n"))
    c = c.withColumn("_q", total_fn(F.col("_n")).cast("long"))
    c = c.select(*by, label, "_q",
                 F.floor(F.col("_q") * F.col("_nc") / F.col("_n")).alias("_base"),
                 ((F.col("_q") * F.col("_nc")) % F.col("_n")).alias("_rem"))
    left = F.col("_q") - F.sum("_base").over(grp)
    order = Window.partitionBy(*by).orderBy(F.col("_rem").desc(), F.col(label).asc())
    return c.select(*by, label, (F.col("_base") + F.when(F.row_number().over(order) <= left, 1).otherwise(0))
                    .alias("_quota"))


def stratified_take(df: DataFrame, label: str, id_col: str, total_fn, seed=DEFAULT_SEED,
                    by: Sequence[str] = ()) -> DataFrame:
    """All rows plus ``_taken`` (per-class rank <= quota) and ``_rank``."""
    quotas = class_quotas(df, label, total_fn, by)  # one row per group x class
    ranked = stratified_rank(df, [*by, label], id_col, seed)
    return (ranked.join(quotas, [*by, label])
            .withColumn("_taken", F.col("_rank") <= F.col("_quota"))
            .drop("_quota"))


def stratified_cap(df: DataFrame, label: str, id_col: str, max_rows: int | None, seed=DEFAULT_SEED,
                   by: Sequence[str] = ()) -> DataFrame:
    """exactly ``max_rows`` rows with the class mix kept; no-op if unset, <= 0 or already small."""
    if max_rows is None or max_rows <= 0:
        return df
    taken = stratified_take(df, label, id_col, lambda n: F.least(F.lit(max_rows).cast("long"), n), seed, by)
    return taken.filter("_taken").drop("_taken", "_rank")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = OUTER_FOLDS, seed=DEFAULT_SEED,
                     fold_col: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """fold = (rank within class by md5(seed:id), id) - 1) mod k."""
    return stratified_rank(df, [*by, label], id_col, seed).withColumn(
        fold_col, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def inner_folds(df: DataFrame, label: str, id_col: str, fold_col: str = "fold", k_outer: int = OUTER_FOLDS,
                k_inner: int = INNER_FOLDS, seed=DEFAULT_SEED) -> DataFrame:
    """for each outer fold f, the rows training on f (fold != f) get an inner fold in 0..k_inner-1.

    Output has one row per (row, outer fold it trains in).
    """
    train_in = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k_outer - 1)), lambda f: f != F.col(fold_col)))
    ex = df.withColumn("outer_fold", train_in)
    return stratified_rank(ex, ["outer_fold", label], id_col, f"{seed}:inner").withColumn(
        "inner_fold", ((F.col("_rank") - 1) % k_inner).cast("int")).drop("_rank")


def holdout_split(df: DataFrame, label: str, id_col: str, test_fraction: float = HOLDOUT_FRACTION,
                  seed=DEFAULT_SEED, by: Sequence[str] = ()) -> DataFrame:
    """stratified holdout; test size = ceil(test_fraction * n), split by largest remainder."""
    taken = stratified_take(df, label, id_col, lambda n: F.ceil(F.lit(test_fraction) * n), seed, by)
    return (taken.withColumn("split", F.when(F.col("_taken"), F.lit("test")).otherwise(F.lit("train")))
            .drop("_taken", "_rank"))


def attribution_sample(df: DataFrame, id_col: str, n: int = ATTRIBUTION_SAMPLE, seed=DEFAULT_SEED) -> DataFrame:
    """min(n, rows) rows in md5 order (a top-n; the limit is the operator)."""
    return (df.withColumn("_h", hash_key(seed, id_col)).orderBy("_h", id_col).limit(n).drop("_h"))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """per-class weight n / (n_classes * n_c), one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    whole = Window.partitionBy()  # bounded: one row per class
    return counts.select(label, "n_class",
                         (F.sum("n_class").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n_class")))
                         .alias("weight"))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """F7 per row: join the per-class weight (a table of one row per class)."""
    w = balanced_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label)
