"""Operator 1, quality classifier by importance resampling.

Two bag-of-n-grams models over hashed unigrams and bigrams of tokens (runs
of letters and digits, runs of other signs): one of target text (labelled
rows of good quality and not toxic), one of raw text (all rows).  The mean
of log(target / raw) over a row's n-grams, times a reference length, is its
log weight: what it would weigh as a chunk of that length.  Texts of one
word and of 20,000 words are thus weighed alike.

A third model tells toxic rows, which may be well written.  Few words give
them away, so it counts the rows that have an n-gram (not how often), and
keeps the n-grams that stand in significantly more toxic rows than chance
would have (``SIGNIFICANT`` deviations).  Their log(toxic / raw), each once
a row, over the root of the row's n-grams is its toxic score.  Rows at or
above a cut of this score are never selected.

Gumbel top-k: the k rows of largest ``log weight + Gumbel noise`` are a
sample without replacement with chances proportional to the weight.  The
noise is a hash of id and text, so a rerun draws the same.  k is the number
of rows whose log weight reaches a cut; the cut is the one at which the
labelled rows are told apart best (``KEEP_WEIGHT`` times the share of good
rows kept, plus the share of bad rows rejected); bad is quality 0 or toxic.  The
toxic cut is set likewise first, from good and toxic rows, and the rows it
leaves set the weight's.  The rows that set the cuts are held out from the
models, so they are to them what any row is.

Labels are read up to ``MAX_LABELLED`` rows (those of least id hash): the
bound of the fit, and of the broadcast.  Raw counts cover all rows.  What
the driver gets are the models (``BUCKETS`` rows) and histograms of fixed
width; the k-th largest key is found exactly, digit by digit, from counts.

Defined cases: a null or empty text has no n-grams and log weight 0;
repeated rows count as often as they stand and are drawn alike; ties at
the k-th place are all kept; labels without a row, or with a null, are
ignored, and rows whose id is null have none; where labels don't show both
kinds, that cut isn't made; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CODES, NOT_WORD, ASCII_SPACE, cut, map_batches, map_rows, mix, pieces, word_hashes

BUCKETS = 1 << 16
MAX_LABELLED = 200_000
REFERENCE_LENGTH = 100

#: Target and expected target count of a bucket are both raised by this: rare n-grams say little.
SMOOTHING = 10.0

#: An n-gram tells toxic rows if their number is so many standard deviations above chance; their counts are raised by TOXIC_SMOOTHING.
SIGNIFICANT, TOXIC_SMOOTHING = 3.5, 1.0

#: Steps of the toxic score to one, and the largest.
TOXIC_STEPS, TOXIC_LIMIT = 1000, 100_000

#: Of the labelled rows one in so many (by id hash) sets the cut; the others are the target's.
HOLD_OUT = 4
KEEP_WEIGHT = 4.0
SEED = 17

#: Keys are compared in steps of 2**-STEPS, counted by digits of base 2**DIGIT.
STEPS, DIGIT, OFFSET = 20, 10, 1 << 49

#: Token classes of bytes: 0 white space, 1 letters and digits, 2 other signs.
CLASS = np.where(ASCII_SPACE, 0, np.where(NOT_WORD, 2, 1)).astype(np.uint8)


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and row of every token."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    kind = CLASS[data]
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[bounds[(bounds > 0) & (bounds < n)]] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def ngrams(data: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every unigram and bigram; a token after itself is one bigram whatever the token."""
    starts, ends, row = tokens(data, bounds)
    h = word_hashes(data, starts, ends, CODES[0])
    if not len(h):
        return np.zeros(0, np.int64), row
    pair = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    pair[h[:-1] == h[1:]] = np.uint64(0x5851F42D4C957F2D)
    same = row[:-1] == row[1:]
    return (np.concatenate([h, pair[same]]) & np.uint64(buckets - 1)).astype(np.int64), np.concatenate([row, row[1:][same]])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def label_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Rows (doc_id, good, toxic): at most ``limit``, one per id; good is quality 1 and not toxic, bad is quality 0 or toxic."""
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when((F.col("quality") == 0) | (F.col("toxic") == 1), 0)
    toxic = F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("good"), toxic.alias("toxic")).where("doc_id is not null and good is not null")
    return known.groupBy("doc_id").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _log_ratio(part: np.ndarray, whole: np.ndarray, smoothing: float) -> np.ndarray:
    expected = whole * (part.sum() / whole.sum())
    return np.log(part + smoothing) - np.log(expected + smoothing)


def toxic_ratio(toxic: np.ndarray, having: np.ndarray) -> np.ndarray:
    """log(toxic / raw) of the buckets that significantly more toxic rows have than chance would; 0 elsewhere."""
    if not toxic.sum():
        return np.zeros(len(toxic))
    expected = having * (toxic.sum() / having.sum())
    return np.where(toxic - expected > SIGNIFICANT * np.sqrt(expected + 1), _log_ratio(toxic, having, TOXIC_SMOOTHING), 0.0)


def fit_models(rows: DataFrame, labelled: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """log(target / raw) of every bucket, from the counts over all rows, and ``toxic_ratio``, from the rows that have it."""
    names = ["bucket", "raw", "target", "having", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, having, toxic = (np.zeros(buckets, np.int64) for _ in range(4))
        for batch in batches:
            good, bad = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) == 1 for i in (1, 2))
            for lo, hi, data, bounds in pieces(batch.column(0)):
                bucket, row = ngrams(data, bounds, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[lo:hi][row]], minlength=buckets)
                row, bucket = np.divmod(np.unique(row * buckets + bucket), buckets)
                having += np.bincount(bucket, minlength=buckets)
                toxic += np.bincount(bucket[bad[lo:hi][row]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in (raw, target, having, toxic))], names=names)

    toxic = F.col("toxic") if "toxic" in labelled.columns else F.lit(0)
    counts = rows.join(F.broadcast(labelled), "doc_id", "left").select("text", F.col("good").cast("int"), toxic.cast("int").alias("toxic")) \
        .mapInArrow(run, "bucket int, raw long, target long, having long, toxic long")
    found = counts.groupBy("bucket").agg(*[F.sum(x) for x in names[1:]]).collect()  # at most `buckets` rows
    raw, target, having, toxic = (np.zeros(buckets) for _ in range(4))
    for b, *x in found:
        raw[b], target[b], having[b], toxic[b] = x
    return _log_ratio(target, raw, SMOOTHING) if target.sum() else np.zeros(buckets), toxic_ratio(toxic, having)


def fit(rows: DataFrame, labelled: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) of every bucket."""
    return fit_models(rows, labelled, buckets)[0]


def _noise(doc_id, raw: bytes, seed: int) -> float:
    """Standard Gumbel noise from a hash of id and text."""
    import xxhash
    u = (xxhash.xxh64_intdigest(raw, xxhash.xxh64_intdigest(str(doc_id), seed)) + 0.5) / 2.0 ** 64
    return float(-np.log(-np.log(u)))


def score_batch(ids: list, col: pa.Array, ratio: np.ndarray, toxic: np.ndarray, seed: int) -> dict[str, list]:
    """n-grams, log weight, key (log weight plus noise) and step of the toxic score of each row."""
    n, weight, steps = [], [], []
    for lo, hi, data, bounds in pieces(col):
        bucket, row = ngrams(data, bounds, len(ratio))
        count = np.bincount(row, minlength=hi - lo)
        total = np.bincount(row, weights=ratio[bucket], minlength=hi - lo)
        n += count.tolist()
        weight += (REFERENCE_LENGTH * total / np.maximum(count, 1)).tolist()
        tells = toxic[bucket] > 0
        row, bucket = np.divmod(np.unique(row[tells] * len(ratio) + bucket[tells]), len(ratio))
        score = np.bincount(row, weights=toxic[bucket], minlength=hi - lo) / np.sqrt(np.maximum(count, 1))
        steps += np.minimum(np.floor(score * TOXIC_STEPS), TOXIC_LIMIT).astype(np.int64).tolist()
    noise = [_noise(i, (x.as_py() or "").encode(), seed) for i, x in zip(ids, col)]
    return {"n_ngrams": n, "log_weight": weight, "key": [w + g for w, g in zip(weight, noise)], "toxic_step": steps}


def best_cut(found: list[tuple[int, int, int]], keep_weight: float = KEEP_WEIGHT) -> int | None:
    """Of rows (log weight step, good, bad): the step from which on rows are kept; None if either kind is missing."""
    found = sorted(found)
    goods, bads = sum(x[1] for x in found), sum(x[2] for x in found)
    if not goods or not bads:
        return None
    best, at, good_below, bad_below = keep_weight, None, 0, 0
    for step, good, bad in found:
        value = keep_weight * (goods - good_below) / goods + bad_below / bads
        if value > best:
            best, at = value, step
        good_below, bad_below = good_below + good, bad_below + bad
    return at


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of integer column ``key`` (0 to 2**50), digit by digit; the driver gets one digit's counts at a time."""
    prefix = 0
    for shift in range(50 - DIGIT, -1, -DIGIT):
        digit = F.shiftright("key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("long"))
        counts = keys.where(F.shiftright("key", shift + DIGIT) == prefix).groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()
        for d, n in sorted(((r.digit, r.n) for r in counts), reverse=True):
            if k <= n:
                prefix = prefix << DIGIT | d
                break
            k -= n
    return prefix


def key_steps(key: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.asarray(key, float) * 2.0 ** STEPS), 1 - OFFSET, OFFSET - 1).astype(np.int64) + OFFSET


class Selection:
    """The fitted models, the least key that is kept and the least toxic step that isn't; ``classify`` and ``keep_selected`` give the same decisions."""

    def __init__(self, ratio: np.ndarray, toxic: np.ndarray, least: int, too_toxic: int, scored: DataFrame, seed: int):
        self.ratio, self.toxic, self.least, self.too_toxic, self.scored, self.seed = ratio, toxic, least, too_toxic, scored, seed


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, buckets: int = BUCKETS,
             keep_weight: float = KEEP_WEIGHT, seed: int = SEED) -> Selection:
    rows = _rows(docs, id_col, text_col)
    labelled = cut(label_sample(labels, max_labelled))
    held_out = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(HOLD_OUT)) == 0
    ratio, toxic = fit_models(rows, labelled.where(~held_out), buckets)
    sent = docs.sparkSession.sparkContext.broadcast((ratio, toxic))

    def fn(batch) -> Iterator[dict]:
        out = score_batch(batch.column(0).to_pylist(), batch.column(1), *sent.value, seed)
        yield {"doc_id": batch.column(0), **out, "step": key_steps(out["key"])}

    scored = cut(map_rows(rows, fn, "doc_id long, n_ngrams long, log_weight double, key double, toxic_step long, step long"))
    judged = scored.join(F.broadcast(labelled.where(held_out)), "doc_id")
    shown = judged.where("good = 1 or toxic = 1").groupBy((-F.col("toxic_step")).alias("bin")).agg(F.sum("good"), F.sum("toxic")).collect()  # at most 100,001 bins
    at = best_cut([tuple(r) for r in shown], keep_weight)
    too_toxic = 1 - at if at is not None else TOXIC_LIMIT + 1
    passed = F.col("toxic_step") < too_toxic
    bins = F.round("log_weight", 1)
    shown = judged.where(passed).groupBy(F.least(F.greatest((bins * 10).cast("long"), F.lit(-100_000)), F.lit(100_000)).alias("bin")) \
        .agg(F.sum("good"), F.sum(1 - F.col("good"))).collect()  # at most 200,001 bins, whatever the corpus
    at = best_cut([tuple(r) for r in shown], keep_weight)
    k = scored.where(passed & (F.col("log_weight") >= at / 10)).count() if at is not None else 0
    least = kth_largest(scored.where(passed).select(F.col("step").alias("key")), k) if k else 0
    return Selection(ratio, toxic, least, too_toxic, scored, seed)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_ngrams, log_weight, key and whether it is selected."""
    s = resample(docs, labels, **options)
    return s.scored.select("doc_id", "n_ngrams", "log_weight", "key", ((F.col("step") >= s.least) & (F.col("toxic_step") < s.too_toxic)).alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that aren't selected.  A row's key and toxic step follow from id and text alone, so no join is needed."""
    s = resample(docs, labels, id_col, text_col, **options)
    sent, least, too_toxic, seed = docs.sparkSession.sparkContext.broadcast((s.ratio, s.toxic)), s.least, s.too_toxic, s.seed

    def kept(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(names.index(id_col)).cast(pa.int64()).to_pylist()
        out = score_batch(ids, batch.column(names.index(text_col)).cast(pa.string()), *sent.value, seed)
        return batch.filter(pa.array((key_steps(out["key"]) >= least) & (np.array(out["toxic_step"], np.int64) < too_toxic)))

    names = docs.columns
    return map_batches(docs, kept)
