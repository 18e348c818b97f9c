"""Operator 13, embedding whitening by Chebyshev-filtered subspace iteration.

Entries become integers floor(256 c).  The distinct integer vectors (the fit
list) are packed once into blocks of bytes in the shared checkpoint folder;
every product V Q with the covariance V is one pass over them, in which each
task centres its vectors, multiplies (X - m)'((X - m) Q) and Spark adds the
parts up.  A three-term Chebyshev recurrence over such products damps the
spectrum below the smallest Ritz value of the block; QR and Rayleigh-Ritz
follow, until every wanted pair is certified: its residual is at most
``TOLERANCE`` of the largest eigenvalue, or at most that share of its
distance to the next Ritz values for the vector to be as exact.

Only sums (dimensions x block width numbers) reach the driver, whatever the
number of rows.  Copies of a vector meet in a map-side distinct.

Defined cases: rows whose vector is null, or holds null or non-finite
entries, are left out, as are those of another length than most distinct
vectors have (of equally frequent lengths the longest counts) and empty
ones; a null or repeated id gives its rows like any other; an entry beyond
the range of a long takes its nearest bound; components whose eigenvalue is
below ``RANK`` of the largest don't exist (none for a single distinct
vector), so that such tables give no rows; a ``deviation`` that no long can
hold is null; equal eigenvalues give any orthonormal basis of their space;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut

SCALE = 256
COMPONENTS = 4

#: Columns that iterate beside the wanted ones, so that the damped part starts well below them.
GUARDS = 44

#: Residual of a certified pair, as a share of the largest eigenvalue.
TOLERANCE = 2e-14

#: Products of the first filter, and of any filter at most; products in all before the best pairs found are taken as they are.
DEGREE, MOST_DEGREE = 10, 30
MOST_PRODUCTS = 600

#: Smaller eigenvalues (as a share of the largest) count as zero.
RANK = 1e-13

#: Vectors of a block; bytes of blocks that a task multiplies.
BLOCK = 4096
TASK_BYTES = 1 << 24

#: Parts of a sum that are added up at once.
FAN_IN = 64

_WIDTHS = (np.int8, np.int16, np.int32, np.int64)
_LONG = 1 << 63


def quantized(flat: np.ndarray) -> np.ndarray:
    """floor(256 c) as long, with the range's bounds beyond it."""
    with np.errstate(over="ignore"):
        x = np.floor(flat.astype(np.float64) * SCALE)
    out = np.where(np.abs(x) < 2.0 ** 63, x, 0).astype(np.int64)
    out[x >= 2.0 ** 63] = _LONG - 1
    out[x <= -2.0 ** 63] = -_LONG
    return out


def packed(x: np.ndarray) -> bytes:
    """The vector in the narrowest of 1, 2, 4, 8 bytes an entry, after that width: equal vectors, equal bytes."""
    for t in _WIDTHS:
        if not len(x) or (np.iinfo(t).min <= x.min() and x.max() <= np.iinfo(t).max):
            return bytes([np.dtype(t).itemsize]) + x.astype(t).tobytes()
    raise AssertionError


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def _vectors(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and integer vector of each row whose vector is whole."""
    col = col.cast(pa.list_(pa.float64()))
    off = np.asarray(col.offsets)
    entries = col.values
    gone = np.asarray(entries.is_null())
    flat = np.asarray(entries.fill_null(0.0))
    bad = np.concatenate([[0], np.cumsum(gone | ~np.isfinite(flat))])
    whole = np.asarray(col.is_valid()) & (bad[off[1:]] == bad[off[:-1]]) & (off[1:] > off[:-1])
    flat = quantized(np.where(np.isfinite(flat), flat, 0.0))
    for i in np.flatnonzero(whole):
        yield int(i), flat[off[i]:off[i + 1]]


def _column(df: DataFrame, name: str):
    return F.col(name).cast("array<double>")


def distinct_blocks(df: DataFrame, vec_col: str) -> DataFrame:
    """The fit list in blocks: (dim, n, width, vectors), in the checkpoint folder."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packed(x) for _, x in _vectors(batch.column(0))], pa.binary())], names=["x"])

    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("width", pa.int32()), ("vectors", pa.binary())])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            x = np.stack(kept.pop(dim))
            raw = packed(x.ravel())
            return pa.RecordBatch.from_pylist([{"dim": dim, "n": len(x), "width": raw[0], "vectors": raw[1:]}], schema)

        for batch in batches:
            for raw in batch.column(0):
                x = unpacked(raw.as_py())
                rows = kept.setdefault(len(x), [])
                rows.append(x)
                if len(rows) == BLOCK:
                    yield flush(len(x))
        for dim in list(kept):
            yield flush(dim)

    vectors = df.select(_column(df, vec_col)).mapInArrow(pack, "x binary").distinct()
    return cut(vectors.mapInArrow(block, "dim int, n long, width int, vectors binary"))


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for r in batch.to_pylist():
            yield np.frombuffer(r["vectors"], f"<i{r['width']}").reshape(r["n"], r["dim"])


def _summed(blocks: DataFrame, fn, kind: str = "double") -> list:
    """``fn(vectors)`` (numbers of one length) added up over all blocks: by task, then by ``FAN_IN`` parts at a time."""
    t = pa.list_(pa.int64() if kind == "long" else pa.float64())

    def out(total) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], t)], names=["y"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _each_block(batches):
            y = fn(x)
            total = y if total is None else total + y
        yield from out(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for y in batch.column(0):
                y = np.asarray(y.values)
                total = y if total is None else total + y
        yield from out(total)

    parts, n = blocks.mapInArrow(part, f"y array<{kind}>"), blocks.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(add, f"y array<{kind}>")
    found = [r.y for r in parts.collect()]  # at most FAN_IN rows
    return [sum(v) if kind == "long" else math.fsum(v) for v in zip(*found)]


@dataclass
class Fit:
    """What whitening needs: sizes, sums, components (columns), eigenvalues, trace, identity error, products used."""
    n: int
    sums: list
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    products: int
    residual: float


def _sums(blocks: DataFrame, dim: int) -> list[int]:
    """Exact sums by dimension: high and low halves apart, so that no part passes a long below two billion vectors a part."""
    both = _summed(blocks, lambda x: np.concatenate([(x.astype(np.int64) >> 32).sum(0), (x.astype(np.int64) & 0xFFFFFFFF).sum(0)]), "long")
    return [(int(both[i]) << 32) + int(both[dim + i]) for i in range(dim)]


def fit(df: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS, seed: int = 7) -> Fit | None:
    """Mean, leading eigenpairs and checks over the fit list; None where no vector remains."""
    blocks = distinct_blocks(df, vec_col)
    most = blocks.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("dim") * F.col("width")).alias("size")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return None
    dim, n = most.dim, most.n
    blocks = blocks.where(F.col("dim") == dim).coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-most.size // TASK_BYTES)))
    sums = _sums(blocks, dim)
    mean = np.array([s / n for s in sums])
    width = min(dim, components + GUARDS)
    used, degree = 0, DEGREE

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal used
        used += 1

        def centred(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return (y.T @ (y @ q)).ravel()
        return np.array(_summed(blocks, centred)).reshape(q.shape) / n

    trace = float(sum(_summed(blocks, lambda x: ((x - mean) ** 2).sum(0)))) / n
    start = np.random.default_rng(seed).standard_normal((dim, width))
    q, _ = np.linalg.qr(start)
    while True:
        vq = product(q)
        small = q.T @ vq
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        wanted = min(components, int((ritz > RANK * max(ritz[0], 0)).sum()) if ritz[0] > 0 else 0)
        left = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * ritz[:wanted], axis=0)
        worst = float(left.max(initial=0.0) / ritz[0]) if wanted else 0.0
        if worst <= TOLERANCE or width == dim or used >= MOST_PRODUCTS:
            break
        # damp [0, bound] by T_m((2 V - bound) / bound), kept in range by the value at the largest Ritz value
        half = max(float(ritz[-1]), RANK * ritz[0]) / 2
        if used > DEGREE:  # as many as the last wanted pair still needs, by the filter's growth at its place
            growth = math.acosh(max(ritz[max(wanted, 1) - 1] / half - 1, 1 + 1e-9))
            degree = min(MOST_DEGREE, max(4, math.ceil(math.log(10 * worst / TOLERANCE) / growth)))
        sigma = first = half / (ritz[0] - half)
        before, now = q, (vq - half * q) * (first / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (product(now) - half * now) * (2 * after / half) - before * (sigma * after)
            sigma = after
        q, _ = np.linalg.qr(now)
    vectors, values = q[:, :wanted], ritz[:wanted]

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ vectors / np.sqrt(values)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    error = 0.0
    if wanted:
        m = np.array(_summed(blocks, moments)) / n
        error = float(np.abs(m[wanted:].reshape(wanted, wanted) - np.outer(m[:wanted], m[:wanted]) - np.eye(wanted)).max())
    return Fit(n, sums, vectors, values, trace, error, used, worst)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null where a long can't hold it."""
    top = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(abs(s) for s in sums)
    if math.isqrt((_LONG - 1) // x.shape[1]) > top:
        return (((n * x - np.array(sums, np.int64)) ** 2).sum(1)).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < _LONG else None for v in exact]


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per remaining row and component; see the module text."""
    found = fit(df, vec_col, components)
    spark = df.sparkSession
    if found is None or not len(found.values):
        return spark.createDataFrame([], OUT)
    n, sums, dim, k = found.n, found.sums, len(found.sums), len(found.values)
    mean = np.array([s / n for s in sums])
    turn = found.vectors / np.sqrt(found.values)
    share = (found.values / found.trace).tolist()
    error = found.identity_error
    arrow = arrow_schema(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, x) for i, x in _vectors(batch.column(1)) if len(x) == dim]
            if not rows:
                continue
            ids = batch.column(0).take(pa.array([i for i, _ in rows])).to_pylist()
            x = np.stack([x for _, x in rows])
            w = ((x - mean) @ turn).ravel()
            m = len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i in ids for _ in range(k)], pa.int64()), pa.array(list(range(1, k + 1)) * m, pa.int32()), pa.array([n] * (m * k), pa.int64()),
                pa.array([d for d in _deviations(x, n, sums) for _ in range(k)], pa.int64()), pa.array(w), pa.array(share * m), pa.array([error] * (m * k))], schema=arrow)

    return df.select(F.col(id_col).cast("long"), _column(df, vec_col)).mapInArrow(run, OUT)
