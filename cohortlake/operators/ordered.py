"""Running sums and ranks without a single-partition window.

A global ``Window.orderBy`` moves every row into one task.  These helpers
use a two-level scheme instead:

1. bucket each row by a *monotone* expression of the ordering key;
2. total each bucket (a hash aggregate, partial per task) and cumulate the
   bucket totals - that table has a bounded number of rows per group, so
   its window is bounded by construction; the planner broadcasts it when it
   is small (the number of groups isn't bounded);
3. window only inside a bucket (``partitionBy(bucket)``) and add the
   bucket's offset.

Callers first collapse rows to distinct keys (a partial aggregation), so
a hot key never becomes a large window partition.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROB_BUCKETS = 1 << 16      # resolution for keys in [0, 1]: n / 64 buckets for each halving of the distance to an end
GROUPED_PROB_BUCKETS = 1 << 12  # when many groups (runs x folds) share one offset table
DURATION_BUCKETS = 4096     # resolution for other real keys: n / 64 buckets for each doubling
OCTAVES = 1100              # more than the halvings from 1 to the least double
HASH_BUCKET_HEX = 4         # 16**4 = 65,536 hash-prefix buckets for stratified ranks


def prob_bucket(key: Column, n: int = PROB_BUCKETS) -> Column:
    """Monotone bucket for a key in [0, 1]; values outside clip to the ends.

    Buckets get narrower towards both ends (a fixed share of the distance
    to 0 or to 1), so scores of a rare event, however small, spread as well.
    """
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), key.cast("double")))
    per_octave = n // 64
    low = F.when(c == 0, F.lit(-OCTAVES * per_octave)).otherwise(F.floor(F.log2(c) * per_octave))
    high = F.when(c == 1, F.lit(OCTAVES * per_octave)).otherwise(F.floor(-F.log2(1.0 - c) * per_octave))
    return F.when(c <= 0.5, low).otherwise(high).cast("int")


def signed_log_bucket(key: Column, n: int = DURATION_BUCKETS) -> Column:
    """Monotone bucket for any real key: sign and log2 of the magnitude, so all scales spread alike."""
    x = key.cast("double")
    per_octave = n // 64
    size = F.floor(F.log2(F.abs(x)) * per_octave) + OCTAVES * per_octave
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("int")


def duration_bucket(key: Column, n: int = DURATION_BUCKETS) -> Column:
    """Monotone bucket for non-negative values (negatives share bucket 0)."""
    return signed_log_bucket(F.greatest(key, F.lit(0.0)), n)


def cumulative_before(df: DataFrame, key: str, measures: Sequence[str], bucket: Column,
                      groups: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Add ``<m>_before``: sum of ``m`` over rows that precede this row in key order.

    ``df`` must hold one row per (groups, key).  ``bucket`` must be monotone
    non-decreasing in ``key``; with ``descending=True`` the order (and the
    bucket order) is reversed.
    """
    groups = list(groups)
    t = df.withColumn("_b", bucket)
    totals = t.groupBy(*groups, "_b").agg(*[F.sum(m).alias(m) for m in measures])
    border = F.col("_b").desc() if descending else F.col("_b").asc()
    # bounded: at most n_buckets rows per group
    wb = Window.partitionBy(*groups).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_b", *[F.coalesce(F.sum(m).over(wb), F.lit(0)).alias(f"_off_{m}")
                                             for m in measures])
    kord = F.col(key).desc() if descending else F.col(key).asc()
    wk = Window.partitionBy(*groups, "_b").orderBy(kord).rowsBetween(Window.unboundedPreceding, -1)
    out = t.join(offsets, [*groups, "_b"])
    return out.select(*[c for c in t.columns if c != "_b"],
                      *[(F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(wk), F.lit(0))).alias(f"{m}_before")
                        for m in measures])


def hash_key(seed: str | int, id_col: str) -> Column:
    """Deterministic pseudo-random order key: md5('<seed>:<id>') (same text in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_rank(df: DataFrame, strata: Sequence[str], id_col: str, seed: str | int,
                    hex_digits: int | None = None) -> DataFrame:
    """Add ``_rank``: 1-based rank inside each stratum by (md5(seed:id), id).

    Equals ``row_number() over (partition by strata order by md5, id)``
    without putting a whole stratum (a class label has ~half the rows) into
    one task: rows are split by the hash prefix, ranked inside
    (stratum, prefix), and offset by the counts of earlier prefixes.
    The offset table has at most (#strata x 16**hex_digits) rows.
    """
    strata = list(strata)
    if hex_digits is None:  # keep the offset table near 16**4 rows: fewer buckets per stratum when strata multiply
        hex_digits = HASH_BUCKET_HEX if len(strata) <= 1 else HASH_BUCKET_HEX - 1
    h = hash_key(seed, id_col)
    t = df.withColumn("_h", h).withColumn("_hb", F.conv(F.substring("_h", 1, hex_digits), 16, 10).cast("int"))
    counts = t.groupBy(*strata, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(*strata).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*strata, "_hb", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_off"))
    wr = Window.partitionBy(*strata, "_hb").orderBy("_h", id_col)
    return (t.join(offsets, [*strata, "_hb"])
            .withColumn("_rank", F.col("_off") + F.row_number().over(wr))
            .drop("_h", "_hb", "_off"))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], bucket_fn=prob_bucket) -> list[float | None]:
    """Exact linear-interpolation quantiles (numpy's default) of ``col``, returned to the driver.

    numpy takes position h = (n - 1) * q and interpolates between the order
    statistics at ranks floor(h) + 1 and floor(h) + 2.  Those ranks are found
    on the distinct-value table with the two-level running count, so no task
    holds all values (``percentile`` buffers every distinct value in one
    final task).  The result is bounded metadata (one number per quantile),
    used like fitted split points.  NULL/NaN values are ignored.
    """
    import math
    vals = df.select(F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    d = vals.groupBy("_x").agg(F.count(F.lit(1)).alias("c")).persist()
    try:
        n = d.agg(F.sum("c")).first()[0] or 0
        if n == 0:
            return [None for _ in qs]
        pos = [(n - 1) * float(q) for q in qs]
        ranks = sorted({r for h in pos for r in (math.floor(h) + 1, min(math.floor(h) + 2, n))})
        c = cumulative_before(d, "_x", ["c"], bucket_fn(F.col("_x")))
        hit = F.exists(F.array(*[F.lit(r) for r in ranks]),
                       lambda r: (F.col("c_before") < r) & (r <= F.col("c_before") + F.col("c")))
        rows = c.filter(hit).select("_x", "c_before", "c").collect()  # <= 2 rows per quantile
    finally:
        d.unpersist()

    def at(r: int) -> float:
        return next(x for x, before, cnt in rows if before < r <= before + cnt)
    out = []
    for h in pos:
        lo, hi = at(math.floor(h) + 1), at(min(math.floor(h) + 2, n))
        out.append(lo + (h - math.floor(h)) * (hi - lo))
    return out


def exact_quantiles_by(df: DataFrame, group: str, col: str, qs: Sequence[float], bucket_fn=signed_log_bucket) -> dict:
    """``exact_quantiles`` of ``col`` for every value of ``group`` (few: columns of a table) in one pass; groups without values are absent."""
    import math
    vals = df.select(group, F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    d = vals.groupBy(group, "_x").agg(F.count(F.lit(1)).alias("c")).persist()
    try:
        n = {r[group]: r.n for r in d.groupBy(group).agg(F.sum("c").alias("n")).collect()}
        if not n:
            return {}
        ranks = {g: sorted({r for q in qs for h in [(k - 1) * float(q)] for r in (math.floor(h) + 1, min(math.floor(h) + 2, k))}) for g, k in n.items()}
        wanted = F.element_at(F.create_map(*[F.lit(x) for g, rs in ranks.items() for x in (g, rs)]), F.col(group))
        c = cumulative_before(d, "_x", ["c"], bucket_fn(F.col("_x")), [group])
        hit = F.exists(wanted, lambda r: (F.col("c_before") < r) & (r <= F.col("c_before") + F.col("c")))
        found: dict = {}
        for r in c.filter(hit).select(group, "_x", "c_before", "c").collect():  # <= 2 rows per quantile and group
            found.setdefault(r[group], []).append((r["_x"], r.c_before, r.c))
    finally:
        d.unpersist()
    out = {}
    for g, k in n.items():
        at = lambda r, g=g: next(x for x, before, cnt in found[g] if before < r <= before + cnt)
        out[g] = []
        for q in qs:
            h = (k - 1) * float(q)
            lo, hi = at(math.floor(h) + 1), at(min(math.floor(h) + 2, k))
            out[g].append(lo + (h - math.floor(h)) * (hi - lo))
    return out
