"""Exact attribution of tree ensembles (I10): interventional Shapley values by leaf paths.

A leaf is reached where all conditions on its path hold.  Against one
background row, the features on the path fall into those that only the
explained row satisfies and those that only the background row satisfies;
the leaf's value is then shared among them by Shapley's weights for these
two numbers alone, and a feature that neither satisfies makes the leaf
count nothing.  So a leaf needs, of the whole background, only how many rows
satisfy each subset of its path's features, and each explained row only its
own subset: the cost follows leaves, not rows x background.

The ensemble and the background's subset counts are fitted parameters
(bounded by rounds and depth); rows are explained on Arrow batches where
they stand.  Contributions sum to the row's margin less the background's
mean margin, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Tree


@dataclass
class Leaf:
    """Features on the path with the open interval (low, high] that each must lie in, and the leaf's value."""
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: float

    def subset(self, x: np.ndarray) -> np.ndarray:
        """Which of the path's features each row satisfies, as bits."""
        v = x[:, self.features]
        return (((v > self.low) & (v <= self.high)) << np.arange(len(self.features))).sum(1)


def leaves(trees: Sequence[tuple[Tree, np.ndarray]]) -> list[Leaf]:
    out = []
    for tree, cut in trees:
        open_: list[tuple[int, dict[int, tuple[float, float]]]] = [(0, {})]
        while open_:
            node, path = open_.pop()
            f = int(tree.feature[node])
            if f < 0:
                if tree.value[node] and path:
                    names = sorted(path)
                    out.append(Leaf(np.array(names), np.array([path[j][0] for j in names]), np.array([path[j][1] for j in names]), float(tree.value[node])))
                continue
            low, high = path.get(f, (-math.inf, math.inf))
            open_.append((int(tree.left[node]), path | {f: (low, min(high, cut[node]))}))
            open_.append((int(tree.right[node]), path | {f: (max(low, cut[node]), high)}))
    return out


_BITS = {k: (np.arange(1 << k)[:, None] >> np.arange(k)) & 1 for k in range(17)}


def shares(k: int, counts: np.ndarray) -> np.ndarray:
    """(subset of the explained row, feature) -> its mean share of a leaf over a background whose subsets have these counts."""
    bits = _BITS[k].astype(bool)
    both = np.flatnonzero(counts)
    mine, theirs = bits[:, None, :], bits[None, both, :]
    live = (mine | theirs).all(-1)
    up, down = mine & ~theirs, theirs & ~mine
    a, b = up.sum(-1), down.sum(-1)
    fact = np.array([math.factorial(i) for i in range(k + 2)], float)
    whole = fact[a + b]
    gain = np.where(a > 0, fact[np.maximum(a - 1, 0)] * fact[b] / whole, 0.0)
    loss = np.where(b > 0, fact[a] * fact[np.maximum(b - 1, 0)] / whole, 0.0)
    weight = np.where(live, counts[both] / counts.sum(), 0.0)
    return ((up * gain[..., None] - down * loss[..., None]) * weight[..., None]).sum(1)


@dataclass
class Explainer:
    """Leaves, their shares against the background, and the background's mean margin."""
    width: int
    base_value: float
    leaves: list[Leaf]
    tables: list[np.ndarray]

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        for leaf, table in zip(self.leaves, self.tables):
            out[:, leaf.features] += leaf.value * table[leaf.subset(x)]
        return out


def explainer(trees: Sequence[tuple[Tree, np.ndarray]], base: float, background: DataFrame, features: str = "features", width: int | None = None) -> Explainer:
    """Subset counts of every leaf over the whole background, one pass (of it, only counts reach the driver)."""
    found = leaves(trees)
    sizes = [1 << len(x.features) for x in found]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(starts[-1], np.int64), 0
        wide = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
            n, wide = n + len(x), x.shape[1]
            for leaf, at, size in zip(found, starts, sizes):
                total[at:at + size] += np.bincount(leaf.subset(x), minlength=size)
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"at": pa.array([-1, -2, *at.tolist()], pa.int64()), "n": pa.array([n, wide * n, *total[at].tolist()], pa.int64())})

    parts = background.select(F.col(features).cast("array<double>")).mapInArrow(count, "at long, n long")
    counts = {r["at"]: r.n for r in parts.groupBy("at").agg(F.sum("n").alias("n")).collect()}  # leaves x subsets at most
    n = counts.get(-1, 0)
    if not n:
        raise ValueError("attribution needs background rows")
    dense = np.zeros(starts[-1])
    for at, c in counts.items():
        if at >= 0:
            dense[at] = c
    tables, mean = [], base
    for leaf, at, size in zip(found, starts, sizes):
        tables.append(shares(len(leaf.features), dense[at:at + size]))
        mean += leaf.value * dense[at + size - 1] / n  # rows that satisfy the whole path
    mean += sum(float(tree.value[0]) for tree, _ in trees if tree.feature[0] < 0)  # trees of a single leaf
    return Explainer(width or counts[-2] // n, mean, found, tables)


def attribute(rows: DataFrame, ex: Explainer, id_col: str = "row_id", features: str = "features") -> DataFrame:
    """(id, contributions: array by encoded feature), one row each."""
    schema = pa.schema([("id", pa.string()), ("contributions", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                phi = ex.contributions(np.stack(batch.column(1).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(phi.tolist(), pa.list_(pa.float64()))], schema=schema)

    return rows.select(F.col(id_col).cast("string").alias("id"), F.col(features).cast("array<double>")).mapInArrow(run, "id string, contributions array<double>")


def mean_absolute(contributions: DataFrame, group_of: Sequence[str]) -> DataFrame:
    """(feature, mean_abs, n_samples): encoded columns of one source feature (``group_of`` by column) are summed row by row first."""
    names = list(dict.fromkeys(group_of))
    at = {g: [i for i, h in enumerate(group_of) if h == g] for g in names}
    total = lambda g: sum((F.col("contributions")[i] for i in at[g][1:]), F.col("contributions")[at[g][0]])
    wide = contributions.agg(F.count("*").alias("n_samples"), *[F.avg(F.abs(total(g))).alias(f"f{i}") for i, g in enumerate(names)])
    return wide.select("n_samples", F.explode(F.array(*[F.struct(F.lit(g).alias("feature"), F.col(f"f{i}").alias("mean_abs")) for i, g in enumerate(names)])).alias("x")).select("x.*", "n_samples")
