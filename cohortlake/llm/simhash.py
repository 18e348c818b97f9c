"""Operator 3, SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into blocks.  Two fingerprints that differ in
at most ``distance`` bits agree on all but ``distance`` blocks, so they
share the key made of those that are left; they are joined on such keys
and their Hamming distance is verified.  Equal fingerprints are one row
before the join.

A key shared by more than ``BUCKET`` fingerprints is not compared there:
its fingerprints go on to finer blocks, whose keys hold more bits, and so
on to a cut whose keys leave at most 12 bits open, where a bucket holds
4,096 fingerprints at most.  Nothing is dropped and no task compares an
unbounded bucket.  Inside a bucket only a spanning forest of the verified
links is emitted, never all pairs; components lose nothing by that.

Defined cases: a null or empty text has fingerprint zero and is linked like
any other; repeated rows and equal texts share a component; a row without
id has a fingerprint and the component of its texts (null if no row of it
has an id); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_rows, shuffle_partitions, signed
from .components import components

SEED = 42
SHINGLE = 3
DISTANCE = 3

#: Fingerprints compared in one bucket at most, before finer blocks take over.
BUCKET = 1024

#: Numbers of blocks, coarse to fine.  The last leaves 64/16*3 = 12 bits open at distance 3.
CUTS = (5, 8, 16)

#: Shingles hashed at a time in one text.
STEP = 1 << 16

#: Hot keys sent to every executor at most; more are joined by a shuffle.
BROADCAST_KEYS = 200_000

#: Ids and fingerprints of dropped rows sent to every executor at most (16 bytes each).
BROADCAST_IDS = 2_000_000


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """SimHash of the lower-cased words' shingles, each hashed by XXH64."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    sums = np.zeros(64, np.int64)
    for i in range(0, n, STEP):
        a, b = starts[i:min(n, i + STEP)].tolist(), ends[i + size - 1:min(n, i + STEP) + size - 1].tolist()
        h = np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b)), ">u8", len(a))
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    def fn(batch) -> Iterator[dict]:
        f = np.fromiter((fingerprint((x.as_py() or "").encode(), size) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield {"doc_id": batch.column(0), "fp": pa.array(signed(f))}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), fn, "doc_id long, fp long")


def block_masks(n_blocks: int, distance: int) -> list[int]:
    """Bit masks of all choices of ``n_blocks - distance`` blocks (or of ``n_blocks - 1`` if fewer)."""
    at = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(at, at[1:])]
    return [sum(c) for c in combinations(blocks, max(1, n_blocks - distance))]


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """A row (mask number, key, fp) for every mask."""
    signed_masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed_masks)])
    return fps.select("fp", F.explode(keys).alias("k")).select(F.col("k.mask").alias("mask"), F.col("k.key").alias("key"), "fp")


def forest(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by bucket: links (from, to) that join what verified pairs join within each bucket."""
    n = len(fp)
    label = np.arange(n)
    bits = fp.view(np.uint64)
    links_a, links_b = [], []
    for shift in range(1, n):
        same = np.flatnonzero((mask[:-shift] == mask[shift:]) & (key[:-shift] == key[shift:]))
        if not len(same):
            break
        near = same[np.bitwise_count(bits[same] ^ bits[same + shift]) <= distance]
        links_a.append(near)
        links_b.append(near + shift)
    if not links_a:
        return label[:0], label[:0]
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    while len(a):  # lower each row's label to the least it is linked with, until nothing changes
        before = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if (before == label).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return fp[at], fp[label[at]]


def bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) found in the buckets of ``rows`` (mask, key, fp); each bucket is of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = [np.concatenate([k, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for k, c in zip(kept, batch.columns)]
            new = np.flatnonzero((np.diff(kept[0]) != 0) | (np.diff(kept[1]) != 0))
            upto = new[-1] + 1 if len(new) else 0  # the last bucket may go on in the next batch
            a, b = forest(*[k[:upto] for k in kept], distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            kept = [k[upto:] for k in kept]
        a, b = forest(*kept, distance)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.select("mask", "key", "fp").mapInArrow(run, "a long, b long")


def near_links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Links between distinct fingerprints (column fp) that join exactly those within ``distance`` bits, or chains of such."""
    found = []
    for level, n_blocks in enumerate(cuts):
        rows = keyed(fps, block_masks(n_blocks, distance))
        if level == len(cuts) - 1:
            found.append(bucket_links(rows, distance))
            break
        hot = cut(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("mask", "key"))
        n_hot = hot.count()
        if not n_hot:
            found.append(bucket_links(rows, distance))
            break
        hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        found.append(bucket_links(rows.join(hot, ["mask", "key"], "left_anti"), distance))
        fps = cut(rows.join(hot, ["mask", "key"], "left_semi").select("fp").distinct())
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def rooted_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE,
                   bucket: int = BUCKET, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """``simhash_groups`` with ``root``, a fingerprint that names the component."""
    fps = cut(fingerprints(docs, id_col, text_col, size))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_equal")))
    roots = components(near_links(distinct.select("fp"), distance, bucket, cuts))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n_equal", F.coalesce("root", "fp").alias("root"))
    chained = rooted.where(F.col("root") != F.col("fp"))
    # only components of several fingerprints need a second minimum
    group = cut(chained.select("root", "least").unionByName(rooted.join(chained.select("root").distinct(), "root", "left_semi").where(F.col("root") == F.col("fp")).select("root", "least"))
                .groupBy("root").agg(F.min("least").alias("group_least")))
    named = rooted.join(group, "root", "left").select("fp", "root", "n_equal", F.coalesce("group_least", "least").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "n_equal", "root")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, fp (signed 64-bit), component_id (smallest doc_id linked, directly or by a chain), n_equal (rows with this fingerprint)."""
    return rooted_rows(docs, id_col, text_col, **options).drop("root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, **options) -> DataFrame:
    """``docs`` with one row of each group: of smallest id, then fingerprint, then hash of the text; rows without id come last.

    Decisions are for id and fingerprint, as an id may stand on different texts.
    """
    keys = rooted_rows(docs, id_col, text_col, size=size, **options).groupBy("root", "doc_id", "fp").agg(F.count("*").alias("n"))
    keys = cut(keys)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    judged = cut(keys.join(keys.groupBy("root").agg(F.min(place).alias("least")), "root").select("doc_id", "fp", "n", (place == F.col("least")).alias("stays")))
    drop = judged.where(~F.col("stays")).select(F.col("doc_id").alias("__drop"), F.col("fp").alias("__drop_fp"))
    n_drop = drop.count()

    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = np.fromiter((fingerprint((x.as_py() or "").encode(), size) for x in batch.column(at).cast(pa.string())), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(f))], names=[*names, "__fp"])

    names, at = docs.columns, docs.columns.index(text_col)
    with_fp = docs.mapInArrow(lambda batches: map(marked, batches), T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))
    # keys that go, sent to every executor while they are few; else the rows are dealt by id and fingerprint
    kept = with_fp.join(F.broadcast(drop) if n_drop <= BROADCAST_IDS else drop, with_fp[id_col].cast("long").eqNullSafe(F.col("__drop")) & (F.col("__fp") == F.col("__drop_fp")), "left_anti")
    if not judged.where("stays and n > 1").isEmpty():  # the texts are dealt only where a key that stays repeats
        first = Window.partitionBy(id_col, "__fp").orderBy(F.xxhash64(text_col))
        kept = kept.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place")
    return kept.drop("__fp")
