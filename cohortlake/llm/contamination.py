"""Operator 7, benchmark decontamination by size-partitioned MinHash containment search.

Items are short and documents long, so the similarity that counts is
containment: the share of an item's word shingles that a document holds.
Items are partitioned by size (powers of two of their shingle count).  In
a partition whose largest item may have u shingles, each item's MinHash
sketch is its least hashes, (1 - containment) * u + ``MIN_HITS`` of them.
A document that contains enough of an item can miss at most a known number
of its shingles, so it must hit the sketch a known number of times: every
true pair becomes a candidate.  Candidates are verified by the exact share
of shingles as strings.

DataFrame functions only; no Python runs on the data.

Words: A-Z lowered, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.  Shingles of five
words, each counted once; an item of fewer words is one shingle of all its
words, sought as such.

Defined cases: a null or empty text, of item or document, contains nothing
and is in no pair; rows that repeat an id are searched each, and the pair
keeps the largest share; rows without id are in no pair; other columns are
ignored; an empty table gives no rows; long texts are searched whole.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SHINGLE = 5
CONTAINMENT = 0.8
MIN_HITS = 2

#: Rows of a table that is sent to every executor at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_words(df: DataFrame, id_col: str, text_col: str, as_id: str) -> DataFrame:
    """Rows (id, words) with an id and at least one word."""
    words = F.filter(F.split(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), SEPARATORS), lambda w: w != "")
    return df.select(F.col(id_col).cast("long").alias(as_id), words.alias("words")).where(F.col(as_id).isNotNull() & (F.size("words") > 0))


def _starts(size: int) -> Column:
    """The words at which a shingle of ``size`` words starts."""
    return F.slice("words", F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(0)))


def hashes(size: int) -> Column:
    """Distinct 64-bit hashes of the shingles of ``size`` words."""
    word = F.col("words")
    return F.array_distinct(F.transform(_starts(size), lambda w, i: F.xxhash64(F.lit(size), w, *[F.get(word, i + k) for k in range(1, size)])))


def shingles(size: int) -> Column:
    """Distinct shingles of ``size`` words as strings."""
    word = F.col("words")
    return F.array_distinct(F.transform(_starts(size), lambda w, i: F.concat_ws(" ", w, *[F.get(word, i + k) for k in range(1, size)])))


def _by_size(sizes: list[int], of) -> Column:
    out = F.lit(None)
    for s in sizes:
        out = F.when(F.col("size") == s, of(s)).otherwise(out)
    return out


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_sketches(items: DataFrame, sizes: list[int], containment: float) -> DataFrame:
    """(item_id, h, need): the least hashes of each item, and how many of them a document must hit."""
    counted = items.withColumn("h", F.array_sort(_by_size(sizes, hashes))).withColumn("q", F.size("h"))
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.col("q").cast("double"))) + 1) - 1
    may_miss = F.col("q") - F.ceil(F.col("q") * containment - 1e-9)
    k = F.least(F.col("q"), (F.floor(upper * (1 - containment) + 1e-9) + MIN_HITS)).cast("int")
    return counted.withColumn("k", k).select("item_id", F.greatest(F.col("k") - may_miss, F.lit(1)).alias("need"), F.explode(F.slice("h", F.lit(1), F.col("k"))).alias("h"))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                    containment: float = CONTAINMENT, shingle: int = SHINGLE) -> DataFrame:
    """Pairs (item_id, doc_id, n_shingles, n_shared, containment) with at least the given containment."""
    item_words = cut(with_words(items, item_col, item_text_col, "item_id").withColumn("size", F.least(F.size("words"), F.lit(shingle))))
    sizes = sorted(r.size_ for r in item_words.select(F.col("size").alias("size_")).distinct().collect()) or [shingle]  # at most `shingle` values
    doc_words = with_words(docs, id_col, text_col, "doc_id")
    sketches = cut(item_sketches(item_words, sizes, containment))
    n_sketch = sketches.count()
    held = doc_words.select("doc_id", F.explode(F.flatten(F.array(*[hashes(s) for s in sizes]))).alias("h"))
    hits = held.join(_sent(sketches, n_sketch), "h").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    candidates = cut(hits.where("n >= need").groupBy("doc_id").agg(F.collect_list("item_id").alias("item_ids")))
    held_by = doc_words.join(_sent(candidates, candidates.count()), "doc_id")
    pairs = held_by.withColumn("all", F.array(*[shingles(s) for s in sizes])).select("doc_id", "all", F.explode("item_ids").alias("item_id"))
    known = item_words.select("item_id", "size", _by_size(sizes, shingles).alias("own")).where("own is not null")
    place = F.array_position(F.array(*[F.lit(s) for s in sizes]), F.col("size"))
    judged = pairs.join(_sent(known, n_sketch), "item_id").select(
        "item_id", "doc_id", F.size("own").cast("long").alias("n_shingles"),
        F.size(F.array_intersect("own", F.element_at("all", place.cast("int")))).cast("long").alias("n_shared"))
    share = judged.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * containment - 1e-9))
    best = F.max(F.struct("containment", "n_shared", "n_shingles"))
    return share.groupBy("item_id", "doc_id").agg(best.alias("b")).select("item_id", "doc_id", "b.n_shingles", "b.n_shared", "b.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text contains an item; judged by text, as an id may stand on different ones or be missing."""
    free = (n for n in itertools.count() if f"__leak{n}" not in docs.columns)
    key, leak = f"__leak{next(free)}", f"__leak{next(free)}"
    texts = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias(key), F.col(text_col).alias("text"))
    leaks = cut(contained_items(texts, items, key, "text", **options).select(F.col("doc_id").alias(leak)).distinct())
    return docs.join(_sent(leaks, leaks.count()), F.xxhash64(docs[text_col].cast("string")) == F.col(leak), "left_anti")


def oracle(containment: float = CONTAINMENT, shingle: int = SHINGLE) -> str:
    """The same pairs in SQL, by counting every shared shingle."""
    words = f"list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '{SEPARATORS}'), lambda w: w <> '')"
    return f"""
WITH i AS (SELECT CAST(item_id AS BIGINT) item_id, {words} w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT CAST(doc_id AS BIGINT) doc_id, {words} w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
ik AS (SELECT item_id, w, least(len(w), {shingle}) s FROM i WHERE len(w) > 0),
ish AS (SELECT DISTINCT item_id, s, array_to_string(w[k:k + s - 1], ' ') g FROM (SELECT item_id, s, w, unnest(range(1, len(w) - s + 2)) k FROM ik)),
dsh AS (SELECT DISTINCT doc_id, s, array_to_string(w[k:k + s - 1], ' ') g FROM
  (SELECT doc_id, s, w, unnest(range(1, len(w) - s + 2)) k FROM d, (SELECT DISTINCT s FROM ik) z WHERE len(w) >= s)),
q AS (SELECT item_id, count(*) n_shingles FROM ish GROUP BY item_id),
c AS (SELECT ish.item_id, dsh.doc_id, count(*) n_shared FROM ish JOIN dsh ON ish.g = dsh.g AND ish.s = dsh.s GROUP BY ish.item_id, dsh.doc_id)
SELECT c.item_id, c.doc_id, q.n_shingles, c.n_shared, c.n_shared / q.n_shingles AS containment
FROM c JOIN q ON c.item_id = q.item_id WHERE c.n_shared >= ceil(q.n_shingles * {containment} - 1e-9)
"""
