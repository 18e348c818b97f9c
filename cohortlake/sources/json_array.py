"""Splittable scan of files that hold one JSON array of objects (A3).

Spark's text source reads the file in byte ranges, in whatever store it is,
with "}" as the line end: every line ends where an object may end.  Whether
a range begins inside a string, and how deep in brackets, follows from the
ranges before it: a first pass notes for each range the parity of its quotes
and the change of depth under both beginnings, and running sums over the
ranges of a file (a row each) give every range its own beginning.  The
second pass cuts out the objects; those that cross ranges come as fragments
and are put together by the range in which they began.

Defined cases: a byte order mark is skipped; elements that are no objects
give no row; an object at the top (no array), or several, is read as well;
an element cut off by the end of its file parses as the JSON reader's
permissive mode does; an empty or missing file gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root
from .readers import path_exists

_ESCAPED = re.compile(r"\\.", re.S)


def _parts(text: str) -> list[str]:
    """The text between its quotes, escaped characters aside."""
    return (_ESCAPED.sub("", text) if "\\" in text else text).split('"')


def _delta(parts: list[str]) -> int:
    text = "".join(parts)
    return text.count("{") + text.count("[") - text.count("]")


def _change(line: str, inside: bool) -> tuple[int, bool]:
    """Change of depth by a line and the "}" after it, and whether a string is open then."""
    parts = _parts(line)
    ends_inside = inside ^ (len(parts) % 2 == 0)
    return _delta(parts[1 if inside else 0::2]) - (not ends_inside), ends_inside


def _both_changes(lines: pa.Array) -> tuple[int, int, bool]:
    """Change of depth by many lines, each with its "}", begun outside and inside a string, and whether their quotes are odd."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines)
    parts = _parts(pc.binary_join(whole, "}")[0].as_py() + "}")
    outer, inner = ("".join(p) for p in (parts[0::2], parts[1::2]))
    of = lambda t: t.count("{") + t.count("[") - t.count("]") - t.count("}")
    return of(outer), of(inner), len(parts) % 2 == 0


def _opening(line: str) -> int:
    """Where the first object of a line that begins between elements opens; -1 if nowhere."""
    first = line.find("{")
    if first < 0 or '"' not in line[:first]:
        return first
    inside, i = False, 0
    while i < len(line):
        c = line[i]
        if inside and c == "\\":
            i += 1
        elif c == '"':
            inside = not inside
        elif c == "{" and not inside:
            return i
        i += 1
    return -1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, line) to a row per range: parity of quotes, change of depth from outside and from inside a string, depth of elements."""
    found: dict[tuple[str, int], list] = {}
    for b in batches:
        path_of, start_of = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()
        ends = [*(np.flatnonzero((np.diff(path_of) != 0) | (np.diff(start_of) != 0)) + 1).tolist(), b.num_rows]
        for at, end in zip([0, *ends], ends):  # runs of lines of one range
            if at == end:
                continue
            path, start, lines = b.column(0)[at].as_py(), int(start_of[at]), b.column(2).slice(at, end - at)
            s = found.get((path, start))
            if s is None:
                s = found[path, start] = [False, 0, 0, (1 if lines[0].as_py().lstrip("﻿").lstrip().startswith("[") else 0) if start == 0 else None]
            outer, inner, odd = _both_changes(lines)
            if s[0]:  # quotes before were odd: what began outside goes on inside
                outer, inner = inner, outer
            s[0], s[1], s[2] = s[0] ^ odd, s[1] + outer, s[2] + inner
    yield pa.RecordBatch.from_pylist([{"path": p, "start": a, "odd": int(s[0]), "outside": s[1], "inside": s[2], "base": s[3]} for (p, a), s in found.items()],
                                     pa.schema([("path", pa.string()), ("start", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64()), ("base", pa.int32())]))


_PIECES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("opens", pa.int32()), ("json", pa.string())])
WHOLE, HEAD, TAIL = 0, 1, 2


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, line, in_string, depth, base) to whole elements and the fragments at either end of a range."""
    at = None  # the range being read
    path = start = None
    inside, depth, base, parts, kind = False, 0, 0, [], WHOLE
    out: list[tuple] = []

    def emit(k: int) -> None:
        out.append((path, start, k, int(k == TAIL), "".join(parts)))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(_PIECES), _PIECES)], schema=_PIECES)

    def close() -> None:  # what a range leaves open
        if at is not None and parts:
            emit(TAIL if kind == WHOLE else HEAD)

    for b in batches:
        for p, a, line, s, d, base_ in zip(*(c.to_pylist() for c in b.columns)):
            if at != (p, a):
                close()
                at, path, start, inside, depth, base = (p, a), p, a, bool(s), d, base_
                parts, kind = [], HEAD if depth > base else WHOLE
                if a == 0:
                    line = line.lstrip("﻿")
            if depth <= base and not parts:
                first = _opening(line)
                if first < 0:
                    change, inside = _change(line, inside)
                    depth += change
                    continue
                depth += _delta(_parts(line[:first])[0::2])
                line = line[first:]
            parts.append(line + "}")
            change, inside = _change(line, inside)
            depth += change
            if depth <= base and not inside:
                emit(kind)
                parts, kind = [], WHOLE
        if len(out) > 1000:
            yield batch()
            out.clear()
    close()
    yield batch()


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of ``schema``, one for each object of the arrays in the files at ``path``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    checkpoint_root(spark)
    lines = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    ranges = lines.mapInArrow(_summaries, "path string, start long, odd int, outside long, inside long, base int")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per byte range
    whole = Window.partitionBy("path")
    begun = ranges.withColumn("in_string", F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)).cast("int"))
    begun = begun.withColumn("change", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    begun = begun.select("path", "start", "in_string", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), F.coalesce(F.max("base").over(whole), F.lit(1)).alias("base")).checkpoint()
    # one row for each byte range (128 MB): sent to all tasks, so that lines stay where and as they stand
    found = lines.join(F.broadcast(begun), ["path", "start"]).select("path", "start", "value", "in_string", "depth", "base") \
        .mapInArrow(_elements, "path string, start long, kind int, opens int, json string")
    upto = Window.partitionBy("path").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)  # two rows per range at most
    crossing = found.where(F.col("kind") != WHOLE).withColumn("element", F.sum("opens").over(upto))
    joined = crossing.groupBy("path", "element").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "json"))).alias("parts")).select(F.concat_ws("", "parts.json").alias("json"))
    parsed = found.where(F.col("kind") == WHOLE).select("json").unionByName(joined).select(F.from_json("json", schema).alias("d"))
    return parsed.select("d.*")
