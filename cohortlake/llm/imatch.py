"""Operator 8, document fingerprints by I-Match.

Document frequencies are counted over all rows.  Terms whose share of the
documents lies in a band (an inverse-document-frequency band) form the
lexicon; each of several randomised subsets of it keeps a term by a hash of
the term.  A fingerprint has one slot per subset: the hash of the text's
distinct lexicon terms of that subset, sorted.  Subsets of several
densities make the share of equal slots a graded likeness.

The lexicon is sent to every worker.  Its size is bounded whatever the
corpus: the document frequencies sum to (documents x mean distinct terms),
so at most (mean distinct terms / lower share) terms reach the lower share.

Defined cases: a null text counts as empty; a text with terms
but none of the lexicon has every slot from a hash of all its distinct terms;
a text without terms has all slots zero, and two such fingerprints are alike (1); the order of
documents is by id, rows without id first, rows of one id by a hash of the
text; repeated rows each have their place; a single row follows itself;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_WORDS, arrow_schema, shuffle_partitions

#: Band of document shares: idf = ln(1 / share) from 1.6 to 6.2.
LOW_SHARE, HIGH_SHARE = 0.002, 0.2

#: Slot k keeps one lexicon term in KEEP_ONE_IN[k].
KEEP_ONE_IN = (1, *(16,) * 5, *(64,) * 6, *(128,) * 6, *(256,) * 6)

#: Distinct terms a task counts before it hands them on.
COUNTER = 400_000


def terms(raw: bytes) -> set[bytes]:
    return set(raw.translate(TO_WORDS).split())


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (term, df) over all texts; counted in the task first, then by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()).cast(pa.string()), pa.array(count.values(), pa.int64())], names=["term", "n"])
            count.clear()
            return batch

        for batch in batches:
            for x in batch.column(0):
                count.update(terms((x.as_py() or "").encode()))
                if len(count) > COUNTER:
                    yield out()
        yield out()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW_SHARE, high: float = HIGH_SHARE) -> list[str]:
    """Sorted terms whose share of the documents is within the band; their number is bounded, see the module text."""
    n = docs.count()
    found = document_frequency(docs, text_col).where((F.col("df") >= low * n) & (F.col("df") <= high * n))
    return sorted(r.term for r in found.select("term").toLocalIterator())


class Fingerprinter:
    """Slots of a text from a lexicon; built once in each worker."""

    def __init__(self, words: list[str], keep_one_in: tuple[int, ...] = KEEP_ONE_IN):
        import xxhash
        self.place = {w.encode(): i for i, w in enumerate(words)}
        raw = [w.encode() for w in words]
        self.codes = np.array([xxhash.xxh64_intdigest(w, 1) for w in raw], np.uint64)
        draw = np.array([xxhash.xxh64_intdigest(w, 2) for w in raw], np.uint64)
        self.kept = []
        for k, one_in in enumerate(keep_one_in):
            x = (draw ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            self.kept.append((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40) < np.uint64((1 << 24) // one_in))
        self.digest = xxhash.xxh32_intdigest

    def slots(self, raw: bytes) -> str:
        found = terms(raw)
        at = np.array(sorted(self.place[w] for w in found & self.place.keys()), np.int64)
        if found and not len(at):
            whole = b" ".join(sorted(found))
            return "".join(f"{self.digest(whole, k) or 1:08x}" for k in range(len(self.kept)))
        codes, out = self.codes[at], []
        for kept in self.kept:
            own = codes[kept[at]]
            out.append(f"{self.digest(own.tobytes()) or 1:08x}" if len(own) else "00000000")
        return "".join(out)


def likeness(a: str, b: str) -> float:
    """Share of equal slots among those that are filled in either fingerprint; 1 if none is."""
    pairs = [(a[i:i + 8], b[i:i + 8]) for i in range(0, len(a), 8)]
    filled = [x == y for x, y in pairs if x != "00000000" or y != "00000000"]
    return sum(filled) / len(filled) if filled else 1.0


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (block, ghost, ord, h, doc_id, text): blocks of consecutive ids, each ending with a ghost of the next block's first row.

    The driver gets one row per block (bounds and first rows), nothing else.
    """
    spark = docs.sparkSession
    n_blocks = 2 * shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n_blocks for i in range(1, n_blocks)], 10_000).alias("b")).first().b or []
    splits = [-math.inf, *sorted({float(b) for b in bounds} or {0.0}), math.inf]
    blocked = Bucketizer(splits=splits, inputCol="place", outputCol="at").transform(rows.withColumn("place", F.col("ord").cast("double"))) \
        .withColumn("block", F.col("at").cast("int")).drop("place", "at")
    firsts = sorted((r.block, r.first.ord, r.first.h) for r in blocked.groupBy("block").agg(F.min(F.struct("ord", "h")).alias("first")).collect())
    known = {b: (o, h, firsts[i - 1][0]) for i, (b, o, h) in enumerate(firsts)} or {0: (0, 0, 0)}
    ord_, h, before = (F.element_at(F.create_map(*[F.lit(x) for b, v in known.items() for x in (b, v[k])]), F.col("block")) for k in range(3))
    is_first = (F.col("ord") == ord_.cast("long")) & (F.col("h") == h.cast("long"))
    own = F.struct(F.col("block").alias("block"), F.lit(0).alias("ghost"))
    ghost = F.struct(before.cast("int").alias("block"), F.lit(1).alias("ghost"))
    return blocked.withColumn("as", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own)))) \
        .select("as.block", "as.ghost", "ord", "h", "doc_id", "text")


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW_SHARE, high: float = HIGH_SHARE,
                      keep_one_in: tuple[int, ...] = KEEP_ONE_IN) -> DataFrame:
    """Per row its fingerprint, that of its edited text (the second half replaced by the start of the next document), and both likenesses."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lexicon(docs, text_col, low, high))
    arrow = arrow_schema(_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(sent.value, keep_one_in)
        last = None  # (block, ghost, id, text, fingerprint) still without its next row
        for batch in batches:
            out = []
            for block, ghost, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), (x.as_py() for x in batch.column(3))):
                own = make.slots(text.encode())
                if last and last[0] == block and not last[1]:
                    _, _, last_id, before, slots = last
                    n = len(before)
                    edited = (before[:n - n // 2] + text[:n // 2]).encode()
                    changed = make.slots(edited)
                    out.append((last_id, n, hashlib.sha256(edited).hexdigest(), slots, changed, likeness(slots, changed), likeness(slots, own)))
                last = block, ghost, doc_id, text, own
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    dealt = in_order(docs, id_col, text_col).repartitionById(2 * shuffle_partitions(spark), F.col("block")).sortWithinPartitions("block", "ghost", "ord", "h")
    return dealt.select("block", "ghost", "doc_id", "text").mapInArrow(run, _SCHEMA)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW_SHARE, high: float = HIGH_SHARE,
                 keep_one_in: tuple[int, ...] = KEEP_ONE_IN) -> DataFrame:
    """Rows (doc_id, fingerprint) against the lexicon of ``docs``; no shuffle of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(sent.value, keep_one_in)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([make.slots((x.as_py() or "").encode()) for x in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")
