"""Helpers shared by the corpus operators: lineage cuts, Arrow batches, vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root

#: Bytes of text that a task hashes at once; a longer text is taken alone and whole.
PIECE_BYTES = 1 << 19

#: ASCII white space (the separators of the word pattern [^\x20\x09-\x0D]+).
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes outside the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on lower-cased text.
_WORD = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
NOT_WORD = np.ones(256, bool)
NOT_WORD[_WORD] = False

#: bytes.translate table: A-Z to lower case, every byte outside the word pattern to a space.
TO_WORDS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if not NOT_WORD[b] else 32 for b in range(256))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder and drop its lineage."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(batch)`` over Arrow batches; it yields dicts of columns or record batches."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()  # workers outlive their task

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``fn`` over Arrow batches of all columns; it returns batches of the same columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
          "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.strip().split(" ", 1) for x in ddl.split(", "))])


def texts(col: pa.Array) -> Iterator[str]:
    """Each row's whole text; a null counts as empty."""
    for x in col:
        yield x.as_py() or ""


def pieces(col: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most ``limit`` bytes (or one longer row): first row, end row, bytes, row bounds."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and row of every word; rows end words."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    sp = space[data]
    inner = bounds[(bounds > 0) & (bounds < n)]
    before = np.ones(n, bool)
    before[1:] = sp[:-1]
    before[inner] = True
    after = np.ones(n, bool)
    after[:-1] = sp[1:]
    after[inner - 1] = True
    starts = np.flatnonzero(~sp & before)
    ends = np.flatnonzero(~sp & after) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64; kept for the next call."""
    if len(_POWERS.get(base, ())) < n:
        p = np.full(max(n, PIECE_BYTES + 1), base, np.uint64)
        p[0] = 1
        _POWERS[base] = np.multiply.accumulate(p)
    return _POWERS[base][:n]


#: Letter codes of two independent polynomial hashes, from a rule.
CODES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)]


def spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A polynomial hash of codes[start:end] for each span, wherever it stands; by prefix sums, not yet mixed."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(pow(base, -1, 1 << 64), len(codes) + 1)[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(spans(codes[data], starts, ends) + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
