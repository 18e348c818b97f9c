"""Proportional-hazards fit with its summary, baseline and concordance.

Each Newton step is two aggregations: rows are weighted by exp(x beta) and
summed per distinct duration (map-side partial sums, so a hot duration is
no large group), then the sums over the risk set - all rows with that
duration or more - come from the bucketed running sums of ``ordered``.
Tied events take Efron's correction.  Its terms over the places
l = 0 .. d - 1 of a tie need six scalar sums only, which are taken in
blocks of ``TIE_BLOCK`` places, so a duration with very many events is
spread as well.  The driver gets one row a step: the log likelihood, its
gradient and its second derivatives.

Defined cases: rows with a null (or NaN) duration, event or covariate are
dropped; an event is any value above 0; a constant covariate has the
coefficient 0 and a null error; a table without events has a log
likelihood of 0, coefficients of 0 and null errors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import cumulative_before, duration_bucket, signed_log_bucket

TIE_BLOCK = 4096
MAX_STEPS = 50
TOLERANCE = 1e-10


@dataclass
class HazardFit:
    """Coefficients by covariate (on the covariates' own scale) and the fit's figures."""
    covariates: list[str]
    coefficients: list[float]
    errors: list[float | None]
    means: list[float]
    log_likelihood: float
    null_log_likelihood: float
    n: int
    events: int
    steps: int
    converged: bool
    deviations: list[float] = field(default_factory=list)

    def risk(self) -> Column:
        """The linear predictor of a row, centred at the fitted table's means."""
        out = F.lit(0.0)
        for c, b, m in zip(self.covariates, self.coefficients, self.means):
            out = out + F.lit(b) * (F.col(c).cast("double") - F.lit(m))
        return out

    def summary(self, spark) -> DataFrame:
        """A row per covariate: coefficient, hazard ratio, error, z, p and the 95 % interval."""
        rows = []
        for c, b, s in zip(self.covariates, self.coefficients, self.errors):
            z = b / s if s else None
            p = math.erfc(abs(z) / math.sqrt(2.0)) if z is not None else None
            low, high = (b - 1.959963984540054 * s, b + 1.959963984540054 * s) if s else (None, None)
            rows.append((c, float(b), math.exp(b), s, z, p, low, high))
        return spark.createDataFrame(rows, "covariate string, coefficient double, hazard_ratio double, standard_error double, z double, p_value double, lower_95 double, upper_95 double")


def usable(df: DataFrame, covariates: Sequence[str], duration: str = "duration", event: str = "event") -> DataFrame:
    """Rows (t, e, x: array of covariates) without nulls and NaNs."""
    cols = [F.col(c).cast("double") for c in (duration, event, *covariates)]
    keep = F.lit(True)
    for c in cols:
        keep = keep & c.isNotNull() & ~F.isnan(c)
    x = F.array(*cols[2:]) if covariates else F.expr("cast(array() as array<double>)")
    return df.filter(keep).select(cols[0].alias("t"), (cols[1] > 0).cast("double").alias("e"), x.alias("x"))


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _risk_sets(rows: DataFrame, beta: Sequence[float]) -> DataFrame:
    """Per duration with events: d, the events' sums (e...) and those of the risk set (r...) of w, w x and w x x'."""
    p = len(beta)
    x = [F.col("x")[i] for i in range(p)]
    xb = sum((F.lit(float(b)) * c for b, c in zip(beta, x)), F.lit(0.0))
    w = F.col("w")
    terms = [w, *[w * c for c in x], *[w * x[i] * x[j] for i, j in _pairs(p)]]
    names = [f"{i}" for i in range(len(terms))]
    of = rows.withColumn("xb", xb).withColumn("w", F.exp("xb"))
    by_time = of.groupBy("t").agg(
        F.sum("e").alias("d"), F.sum(F.col("e") * F.col("xb")).alias("exb"), *[F.sum(F.col("e") * c).alias(f"sx{i}") for i, c in enumerate(x)],
        *[F.sum(c).alias(f"s{n}") for n, c in zip(names, terms)], *[F.sum(F.col("e") * c).alias(f"e{n}") for n, c in zip(names, terms)])
    later = cumulative_before(by_time, "t", [f"s{n}" for n in names], duration_bucket(F.col("t")), descending=True)
    return later.filter("d > 0").select("t", "d", "exb", *[f"sx{i}" for i in range(p)], *[f"e{n}" for n in names],
                                        *[(F.col(f"s{n}_before") + F.col(f"s{n}")).alias(f"r{n}") for n in names])


def _likelihood(rows: DataFrame, beta: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Efron's log likelihood, its gradient and its negative second derivatives at ``beta``."""
    p, pairs = len(beta), _pairs(len(beta))
    sets = _risk_sets(rows, beta)
    last = F.col("d").cast("long") - 1
    blocks = sets.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(TIE_BLOCK).cast("long")))) \
        .withColumn("hi", F.least(F.col("lo") + TIE_BLOCK - 1, last))
    phi = lambda l: F.col("r0") - l / F.col("d") * F.col("e0")
    sums = {"l": lambda l: F.log(phi(l)), "a": lambda l: 1.0 / phi(l), "b": lambda l: l / F.col("d") / phi(l), "aa": lambda l: 1.0 / (phi(l) * phi(l)),
            "bb": lambda l: l / F.col("d") / (phi(l) * phi(l)), "cc": lambda l: l / F.col("d") * (l / F.col("d")) / (phi(l) * phi(l))}
    start = F.struct(*[F.lit(0.0).alias(k) for k in sums])
    done = blocks.withColumn("k", F.aggregate(F.sequence("lo", "hi"), start, lambda acc, l: F.struct(*[(acc[k] + f(l)).alias(k) for k, f in sums.items()])))
    k = {name: F.col(f"k.{name}") for name in sums}
    r, e = (lambda i: F.col(f"r{i}")), (lambda i: F.col(f"e{i}"))
    first = F.col("lo") == 0  # what stands once a duration
    once = lambda c: F.when(first, c).otherwise(0.0)
    out = [F.sum(once(F.col("exb")) - k["l"])]
    out += [F.sum(once(F.col(f"sx{i}")) - (r(1 + i) * k["a"] - e(1 + i) * k["b"])) for i in range(p)]
    for at, (i, j) in enumerate(pairs, 1 + p):
        ri, rj, ei, ej = r(1 + i), r(1 + j), e(1 + i), e(1 + j)
        out.append(F.sum(r(at) * k["a"] - e(at) * k["b"] - (ri * rj * k["aa"] - (ri * ej + ei * rj) * k["bb"] + ei * ej * k["cc"])))
    got = [float(v or 0.0) for v in done.agg(*[c.alias(f"o{i}") for i, c in enumerate(out)]).first()]
    info = np.zeros((p, p))
    for (i, j), v in zip(pairs, got[1 + p:]):
        info[i, j] = info[j, i] = v
    return got[0], np.array(got[1:1 + p]), info


def fit_hazards(df: DataFrame, covariates: Sequence[str], duration: str = "duration", event: str = "event",
                tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> HazardFit:
    """Newton steps with halving on standardised covariates; stops when no coefficient moves by ``tolerance``."""
    rows = usable(df, covariates, duration, event).persist()
    try:
        p = len(covariates)
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("events"),
                         *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(p)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(p)]).first()
        n, events = facts["n"], int(facts["events"] or 0)
        means, devs = [facts[f"m{i}"] or 0.0 for i in range(p)], [facts[f"s{i}"] or 0.0 for i in range(p)]
        # a constant column's deviation isn't always exactly 0
        live = [i for i in range(p) if devs[i] > 1e-12 * max(1.0, abs(means[i]))] if events else []
        scaled = rows.select("t", "e", F.array(*[(F.col("x")[i] - means[i]) / devs[i] for i in live]).alias("x")) if live else rows.select("t", "e", "x")
        beta = np.zeros(len(live))
        value, slope, info = _likelihood(scaled, beta)
        null, steps, converged = value, 0, not live
        while not converged and steps < max_steps:
            steps += 1
            move = np.linalg.solve(info, slope)
            size, nxt = 1.0, _likelihood(scaled, beta + move)
            while not nxt[0] >= value - 1e-9 * max(1.0, abs(value)) and size > 1e-4:
                size /= 2
                nxt = _likelihood(scaled, beta + size * move)
            beta, (value, slope, info) = beta + size * move, nxt
            converged = bool(np.max(np.abs(size * move)) < tolerance)
        errors = np.sqrt(np.diag(np.linalg.inv(info))) if live else np.zeros(0)
    finally:
        rows.unpersist()
    coefficients: list[float] = [0.0] * p
    standard: list[float | None] = [None] * p
    for at, i in enumerate(live):
        coefficients[i], standard[i] = float(beta[at] / devs[i]), float(errors[at] / devs[i])
    return HazardFit(list(covariates), coefficients, standard, means, value, null, n, events, steps, converged, devs)


def baseline_hazard(df: DataFrame, fit: HazardFit, duration: str = "duration", event: str = "event") -> DataFrame:
    """Breslow's baseline at the covariates' means: per distinct duration its hazard, cumulative hazard and survival."""
    rows = df.select(F.col(duration).cast("double").alias("t"), (F.col(event).cast("double") > 0).cast("double").alias("e"), F.exp(fit.risk()).alias("w")) \
        .filter("t is not null and e is not null and w is not null and not isnan(t) and not isnan(w)")
    by_time = rows.groupBy("t").agg(F.sum("e").alias("d"), F.sum("w").alias("w"))
    risk = cumulative_before(by_time, "t", ["w"], duration_bucket(F.col("t")), descending=True)
    h = risk.select("t", "d", (F.col("d") / (F.col("w_before") + F.col("w"))).alias("hazard"))
    upto = cumulative_before(h, "t", ["hazard"], duration_bucket(F.col("t")))
    cum = F.col("hazard_before") + F.col("hazard")
    return upto.select(F.col("t").alias("duration"), F.col("d").alias("events"), "hazard", cum.alias("cumulative_hazard"), F.exp(-cum).alias("survival"))


def concordance(df: DataFrame, score: Column, duration: str = "duration", event: str = "event") -> DataFrame:
    """One row (pairs, concordant, tied, concordance): Harrell's index of a risk ``score``, exactly.

    A pair is an event and a row that outlived it (censored at the same
    duration counts as such).  Ranks of duration differ first at one bit:
    for every bit, rows that share the higher bits are counted by score, so
    n rows make n log(n) counted rows and never pairs.
    """
    rows = df.select(F.col(duration).cast("double").alias("t"), (F.col(event).cast("double") > 0).alias("e"), score.cast("double").alias("s")) \
        .filter("t is not null and e is not null and s is not null and not isnan(t) and not isnan(s)")
    times = cumulative_before(rows.groupBy("t").agg(F.lit(1).cast("long").alias("one")), "t", ["one"], duration_bucket(F.col("t")))
    ranked = rows.groupBy("t", "e", "s").agg(F.count(F.lit(1)).alias("n")).join(times.select("t", F.col("one_before").alias("at")), "t") \
        .select((F.col("at") * 2 + F.when(F.col("e"), 0).otherwise(1)).alias("rank"), "e", "s", "n")
    top = rows.select(F.count_distinct("t")).scalar() * 2
    bits = F.ceil(F.log2(F.greatest(top, F.lit(2)))).cast("int")
    dealt = ranked.withColumn("bit", F.explode(F.sequence(F.lit(0), bits))).withColumn("side", F.expr("shiftright(rank, bit) & 1")).withColumn("prefix", F.expr("shiftright(rank, bit + 1)"))
    by_score = dealt.groupBy("bit", "prefix", "s").agg(F.sum(F.when((F.col("side") == 0) & F.col("e"), F.col("n")).otherwise(0)).alias("ev"),
                                                      F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("late"))
    below = cumulative_before(by_score, "s", ["late"], signed_log_bucket(F.col("s")), ["bit", "prefix"])
    whole = lambda c: c.cast("decimal(19,0)")
    hits = below.agg(F.sum(whole(F.col("ev")) * whole(F.col("late_before"))).alias("concordant"), F.sum(whole(F.col("ev")) * whole(F.col("late"))).alias("tied"))
    pairs = by_score.groupBy("bit", "prefix").agg(F.sum("ev").alias("ev"), F.sum("late").alias("late")).select(F.sum(whole(F.col("ev")) * whole(F.col("late")))).scalar()
    c, t = (F.coalesce(F.col(x), F.lit(0)).cast("double") for x in ("concordant", "tied"))
    n = F.coalesce(pairs, F.lit(0)).cast("double")
    return hits.select(n.alias("pairs"), c.alias("concordant"), t.alias("tied"), F.when(n > 0, (c + 0.5 * t) / n).alias("concordance"))
