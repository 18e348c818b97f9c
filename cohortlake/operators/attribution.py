"""Global attribution (I10): mean absolute per-feature contribution.

For a linear scorer the exact (interventional) contribution of feature j
to row i is ``w_j * (x_ij - E[x_j])`` - for a categorical feature,
``w[c_i] - E[w[c]]`` - so the summary is two aggregates over the sample,
no per-row solver.  ``sampled_shapley`` estimates the same quantity for
any fitted model that scores a DataFrame: it explodes each sampled row
into coalition variants, scores them all in one bulk ``transform`` and
averages marginal differences per feature.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .serve import LinearScorer


def _contributions(scorer: LinearScorer) -> dict[str, Column]:
    out = {}
    for name, w in scorer.numeric.items():
        out[name] = F.lit(w) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    for name, table in scorer.categorical.items():
        m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
        out[name] = F.coalesce(F.element_at(m, F.col(name)), F.lit(0.0))
    return out


def linear_attribution(df: DataFrame, scorer: LinearScorer) -> DataFrame:
    """Closed-form mean |contribution| per feature plus the base value, one row per feature.

    Two passes: means of the per-feature terms (one global aggregate, as a
    scalar subquery), then the mean absolute deviation from them.
    """
    terms = _contributions(scorer)
    t = df.select(*[c.alias(n) for n, c in terms.items()])
    means = t.agg(*[F.avg(n).alias(n) for n in terms])
    centred = t.select(*[F.abs(F.col(n) - means.select(n).scalar()).alias(n) for n in terms])
    wide = centred.agg(F.count(F.lit(1)).alias("n_samples"), *[F.avg(n).alias(n) for n in terms])
    base = F.lit(scorer.intercept)
    for n in terms:
        base = base + means.select(n).scalar()
    return (wide.unpivot(["n_samples"], list(terms), "feature", "mean_abs")
            .select("feature", "mean_abs", "n_samples", base.alias("base_value")))


def sampled_shapley(sample: DataFrame, background: dict[str, object], features: Sequence[str],
                    score: Callable[[DataFrame], DataFrame], id_col: str = "row_id", n_perm: int = 8,
                    seed: int = 42) -> DataFrame:
    """Permutation-sampling Shapley estimate of mean |contribution| per feature.

    Each sampled row gets ``n_perm`` feature orders (from md5 of seed, row and
    permutation); along an order, step k switches feature k from its
    background value to the row's value.  All (row, permutation, step)
    variants are scored in ONE ``score`` call; the marginal difference of
    consecutive steps is that feature's contribution.  ``background`` holds
    the reference value per feature (e.g. medians / modes of the training set).
    """
    feats = list(features)
    nf = len(feats)
    perms = sample.select(id_col, *feats).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
    # random feature order: sort feature indexes by md5(seed:row:perm:index)
    keyed = F.transform(F.sequence(F.lit(0), F.lit(nf - 1)),
                        lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"),
                                                              F.col("perm").cast("string"), i.cast("string"))).alias("h"),
                                           i.alias("i")))
    perms = perms.withColumn("order", F.transform(F.array_sort(keyed), lambda s: s["i"]))
    steps = perms.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(nf))))
    # feature j is "on" at step k iff its position in the order is < k
    cols = []
    for j, f in enumerate(feats):
        pos = F.array_position(F.col("order"), F.lit(j)) - 1
        cols.append(F.when(pos < F.col("step"), F.col(f)).otherwise(F.lit(background.get(f))).alias(f))
    variants = steps.select(id_col, "perm", "step", "order", *cols)
    scored = score(variants).select(id_col, "perm", "step", "order", F.col("_score").alias("v"))
    pairs = (scored.groupBy(id_col, "perm", "order")
             .agg(F.sort_array(F.collect_list(F.struct("step", "v"))).alias("path")))  # nf+1 entries per group
    contrib = pairs.select(id_col, F.explode(F.transform(F.sequence(F.lit(1), F.lit(nf)), lambda k: F.struct(
        F.element_at(F.col("order"), k).alias("j"),
        (F.element_at(F.col("path"), k + 1)["v"] - F.element_at(F.col("path"), k)["v"]).alias("d")))).alias("c"))
    phi = (contrib.select(id_col, F.col("c.j").alias("j"), F.col("c.d").alias("d"))
           .groupBy(id_col, "j").agg(F.avg("d").alias("phi")))  # per-row Shapley estimate
    names = F.array(*[F.lit(f) for f in feats])
    return (phi.groupBy("j").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.count(F.lit(1)).alias("n_samples"))
            .select(F.element_at(names, F.col("j") + 1).alias("feature"), "mean_abs", "n_samples"))
