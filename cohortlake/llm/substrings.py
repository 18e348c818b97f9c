"""Operator 6, substring dedup by recompression.

Recompression names a text bottom up: a round joins runs of one symbol and
pairs of neighbouring runs (left, right), where a hash of the symbol says
whether it is a left or a right one.  What is joined gets a new name, a
64-bit hash of what it stands for, so all tasks give the same name to the
same content without a dictionary.  Whether two neighbours join depends on
these two alone: equal substrings get equal symbols except near their ends.

How a repeat of ``window`` words is found:

1. The symbols left after two rounds mark boundaries in a text.  A boundary,
   with the words that decided it, is an anchor, named by these words.  Each
   window takes one anchor that lies wholly inside it (the least by a hash of
   the name); a window that has none (a long run, say) is its own anchor.
   Equal windows thus take equal anchors, wherever they stand.
2. Spark groups anchors by name.  Only windows whose anchor occurs in two
   documents or more can repeat.
3. These windows are grouped by anchor and by a second, independent hash of
   all their words, and a window that also starts in a document with a
   smaller id is marked.
4. Marks are gathered by document, and the words that they cover go.

Hot names: a task first groups what it has read.  Where it sees a name in
several documents itself, it settles all rows but those of the smallest
document on the spot; a name thus brings one document's rows per batch
to its group, however many documents hold it.  Groups are read as a sorted
stream; nothing but the first document of a group is kept in memory.

Defined cases: a null or empty text has no words and no windows; a text of
fewer words than a window loses nothing; rows that repeat an id are one
document's for the comparison (none of them is smaller than the other) and
give a row each; where their texts differ, each text has positions of its
own within the document, so that no mark of one meets another; rows without id are kept whole and take no part; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, CODES, cut, mix, pieces, shuffle_partitions, signed, spans, word_hashes, words

WINDOW = 13

#: Naming rounds.  More rounds need more words around a boundary than a window has.
ROUNDS = 2

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def boundaries(name: np.ndarray, row: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries between symbols after the rounds: the word each stands before, and the words [from, to) that decided it.

    A boundary whose decision depends on where its row begins or ends has a
    range that leaves the row.
    """
    n = len(name)
    at, sym = np.arange(n + 1), name  # symbol i is words at[i] to at[i + 1]
    edge = np.ones(n + 1, bool)
    edge[1:n] = row[1:] != row[:-1]
    lo, hi = at.copy(), at.copy()
    for number in range(rounds):
        left = (mix(sym ^ np.uint64(number + 1)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(at), bool)
        joins[1:-1] = ~edge[at[1:-1]] & ((sym[1:] == sym[:-1]) | (left[:-1] & ~left[1:]))
        decided_lo, decided_hi = lo.copy(), hi.copy()
        decided_lo[1:-1] = np.minimum(lo[1:-1], np.minimum(lo[:-2], at[:-2]))
        decided_hi[1:-1] = np.maximum(hi[1:-1], np.maximum(hi[2:], at[2:]))
        stay = np.flatnonzero(~joins)
        sym = mix(spans(mix(sym), stay[:-1], stay[1:]) + (stay[1:] - stay[:-1]).astype(np.uint64))
        at = at[stay]
        ends = edge[at]
        lo, hi = np.where(ends, at - 1, decided_lo[stay]), np.where(ends, at + 1, decided_hi[stay])
    inner = ~edge[at]
    return at[inner], lo[inner], hi[inner]


def least_ahead(x: np.ndarray, reach: int) -> np.ndarray:
    """The least of x[i], ..., x[i + reach - 1] for every i."""
    def ahead(v: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([v[by:], np.full(min(by, len(v)), _NONE)])

    size = 1
    while size * 2 <= reach:
        x = np.minimum(x, ahead(x, size))
        size *= 2
    return np.minimum(x, ahead(x, reach - size)) if reach > size else x


def windows(name: np.ndarray, row: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor name of every window."""
    n = len(name)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, lo, hi = boundaries(name, row, rounds)
    fits = (lo >= 0) & (hi <= n) & (hi - lo <= window)
    at, lo, hi = at[fits], lo[fits], hi[fits]
    fits = (row[lo] == row[at]) & (row[hi - 1] == row[at])
    at, lo, hi = at[fits], lo[fits], hi[fits]
    codes = mix(name)
    anchor = mix(spans(codes, lo, hi) + ((hi - lo) * 64 + (at - lo)).astype(np.uint64))
    taken = np.full(n, _NONE)
    for length in np.unique(hi - lo):  # these may begin 0 to window - length words into a window
        own = hi - lo == length
        first = np.full(n, _NONE)
        first[lo[own][::-1]] = anchor[own][::-1]
        np.minimum.at(first, lo[own], anchor[own])
        taken = np.minimum(taken, least_ahead(first, window - int(length) + 1))
    start = np.flatnonzero(row[:n - window + 1] == row[window - 1:])
    chosen = taken[start]
    alone = np.flatnonzero(chosen == _NONE)
    chosen[alone] = mix(spans(codes, start[alone], start[alone] + window) ^ np.uint64(1))
    return start, chosen


def _ids(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """First rows of the groups of equal keys, of sorted rows."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


# Kinds of rows on their way to a group.
OPEN, EVIDENCE, SETTLED = 0, 1, 2


def anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (name, doc_id, kind): each document's anchors, grouped within the batch."""
    for batch in batches:
        ids = _ids(batch.column(0))
        for r0, r1, data, bounds in pieces(batch.column(1)):
            starts, ends, row = words(data, bounds, ASCII_SPACE)
            first, name = windows(word_hashes(data, starts, ends, CODES[0]), row, window)
            doc = ids[r0:r1][row[first]]
            order = np.lexsort((doc, name))
            order = order[_groups(name[order], doc[order])] if len(order) else order
            name, doc = name[order], doc[order]
            heads = _groups(name)
            sizes = np.diff(np.append(heads, len(name)))
            kind = np.repeat(np.where(sizes > 1, SETTLED, OPEN), sizes)
            kind[heads[sizes > 1]] = EVIDENCE
            by = np.argsort(doc, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(signed(name[by])), pa.array(doc[by]), pa.array(kind[by].astype(np.int32))], names=["name", "doc_id", "kind"])


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, doc_id, kind) to (doc_id, name) of the names that two documents or more have."""
    held, known = [np.zeros(0, np.int64)] * 3, None  # rows of the last name so far; or that name, if it is known to be shared

    def out(name, doc):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(name)], names=["doc_id", "name"])

    for batch in batches:
        name, doc, kind = (np.concatenate([h, _ids(c)]) for h, c in zip(held, batch.columns))
        if not len(name):
            continue
        heads = _groups(name)
        sizes = np.diff(np.append(heads, len(name)))
        open_doc_lo = np.minimum.reduceat(np.where(kind == SETTLED, np.iinfo(np.int64).max, doc), heads)
        open_doc_hi = np.maximum.reduceat(np.where(kind == SETTLED, np.iinfo(np.int64).min, doc), heads)
        shared = (open_doc_lo < open_doc_hi) | (np.maximum.reduceat(kind == EVIDENCE, heads)) | (name[heads] == known if known is not None else False)
        take = np.repeat(shared, sizes) | (kind == SETTLED)
        last = heads[-1]
        if shared[-1]:
            held, known = [np.zeros(0, np.int64)] * 3, name[-1]
        else:
            keep = np.flatnonzero(~take[last:]) + last
            held, known = [name[keep], doc[keep], kind[keep]], None
        yield out(name[take], doc[take])


def window_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, names, offset) to (name, hash, doc_id, first, more, kind): windows with a shared anchor, compared within the batch.

    Positions count from the row's offset.

    A window that the batch itself shows in a smaller document is settled; runs of such windows are one row, its first window and the number of further ones.
    """
    for batch in batches:
        batch = batch.filter(batch.column(2).is_valid())
        if not batch.num_rows:
            continue
        ids = _ids(batch.column(0))
        listed, offsets = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False)
        sizes = listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = listed.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        for r0, r1, data, bounds in pieces(batch.column(1)):
            starts, ends, row = words(data, bounds, ASCII_SPACE)
            first, name = windows(word_hashes(data, starts, ends, CODES[0]), row, window)
            of = lambda n, r: mix(n ^ (r.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)))
            wanted = of(flat[upto[r0]:upto[r1]], np.repeat(np.arange(r1 - r0), sizes[r0:r1]))
            take = np.flatnonzero(np.isin(of(name, row[first]), wanted)) if len(first) else first
            first, name = first[take], name[take]
            whole = mix(spans(mix(word_hashes(data, starts, ends, CODES[1])), first, first + window)) if len(first) else name
            base = np.searchsorted(row, np.arange(r1 - r0))  # each row's first word
            pos = first - base[row[first]] + offsets[r0:r1][row[first]]
            doc = ids[r0:r1][row[first]]
            order = np.lexsort((pos, doc, whole, name))
            name, whole, doc, pos = name[order], whole[order], doc[order], pos[order]
            heads = _groups(name, whole) if len(name) else name.astype(np.int64)
            least = np.repeat(doc[heads], np.diff(np.append(heads, len(name)))) if len(name) else doc
            settled = doc > least
            a, b, d = runs(doc[settled], pos[settled])
            still = np.flatnonzero(~settled)
            still = still[np.lexsort((pos[still], doc[still]))]
            zeros, zeros_of = np.zeros(len(d), np.int64), lambda x: np.zeros(len(x), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (
                (signed(name[still]), zeros), (signed(whole[still]), zeros), (doc[still], d), (pos[still].astype(np.int32), a.astype(np.int32)), (zeros_of(still), (b - a).astype(np.int32)),
                (np.full(len(still), OPEN, np.int32), np.full(len(d), SETTLED, np.int32)))], names=["name", "hash", "doc_id", "first", "more", "kind"])


def runs(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last of each run of consecutive positions, with its document."""
    if not len(doc):
        return pos, pos, doc
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
    at = np.flatnonzero(new)
    return pos[at], pos[np.append(at[1:], len(doc)) - 1], doc[at]


def repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, hash, doc_id, first, more, kind) to (doc_id, first, more) of windows that a smaller document has too."""
    known = None  # (name, hash, smallest document) of the last window
    for batch in batches:
        name, whole, doc, first, more, kind = (_ids(c) for c in batch.columns)
        if not len(name):
            continue
        done = kind == SETTLED
        out = [(doc[done], first[done], more[done])]
        name, whole, doc, first = name[~done], whole[~done], doc[~done], first[~done]
        if len(name):
            heads = _groups(name, whole)
            least = doc[heads].copy()
            if known is not None and (name[0], whole[0]) == known[:2]:
                least[0] = known[2]
            known = name[-1], whole[-1], least[-1]
            later = doc > np.repeat(least, np.diff(np.append(heads, len(name))))
            a, b, d = runs(doc[later], first[later])
            out.append((d, a, b - a))
        doc, a, b = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["doc_id", "first", "more"])


def keep_words(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, marks, offset) to one row per text: words, removed words, and the kept words or their SHA-256."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for x, marks, offset in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist()):
            kept = (x.as_py() or "").encode().split()
            n = len(kept)
            if marks.is_valid and len(marks):
                cover = np.zeros(n + 1, np.int64)
                first, more = (marks.values.field(k).to_numpy(zero_copy_only=False) for k in ("first", "more"))
                mine = (first >= offset) & (first < offset + n)
                first, more = first[mine] - offset, more[mine]
                np.add.at(cover, first, 1)
                np.add.at(cover, first + more + window, -1)
                kept = [kept[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0).tolist()]
            joined = b" ".join(kept)
            for c, v in zip(out, (n, n - len(kept), joined.decode() if texts else hashlib.sha256(joined).hexdigest())):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and ``kept``: the kept words joined by one space, or (texts=False) their SHA-256."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # where a row that is settled already goes doesn't matter: anywhere but to the hot group
    deal = F.when(F.col("kind") == SETTLED, F.xxhash64("doc_id")).otherwise(F.col("name"))
    anchors = rows.where(F.col("doc_id").isNotNull()).mapInArrow(lambda b: anchor_rows(b, window), "name long, doc_id long, kind int")
    shared = (anchors.repartition(n, deal).sortWithinPartitions("name", "doc_id").mapInArrow(shared_anchors, "doc_id long, name long")
              .groupBy("doc_id").agg(F.collect_list("name").alias("names")))
    several = text_offsets(rows, window)
    offset = F.coalesce(F.element_at(F.map_from_entries("offsets"), F.xxhash64("text")), F.lit(0)).cast("int").alias("offset")
    # both joins take the same left side as it is (rows without a match are passed over inside), so the texts are dealt once
    found = rows.join(shared.join(several, "doc_id", "left"), "doc_id", "left").select("doc_id", "text", "names", offset) \
        .mapInArrow(lambda b: window_rows(b, window), "name long, hash long, doc_id long, first int, more int, kind int")
    marks = (found.repartition(n, deal).sortWithinPartitions("name", "hash", "doc_id").mapInArrow(repeated_windows, "doc_id long, first int, more int")
             .groupBy("doc_id").agg(F.collect_list(F.struct("first", "more")).alias("marks")))
    return rows.join(marks.join(several, "doc_id", "left"), "doc_id", "left").select("doc_id", "text", "marks", offset) \
        .mapInArrow(lambda b: keep_words(b, window, texts), "doc_id long, n_words long, n_removed long, kept string")


def text_offsets(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, offsets: [(text's hash, first position)]) of the ids that stand on different texts; written, as both joins read it."""
    text = rows.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), (F.length(F.coalesce("text", F.lit(""))) + window).cast("long").alias("n"))
    ids = text.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("doc_id")
    each = text.join(ids, "doc_id", "left_semi").groupBy("doc_id", "h").agg(F.max("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut(each.select("doc_id", F.struct("h", before.alias("at")).alias("o")).groupBy("doc_id").agg(F.collect_list("o").alias("offsets")))
