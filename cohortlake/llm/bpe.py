"""Operator 12, BPE encoding and decoding by tree concatenation.

Texts of up to ``PIECE`` characters are encoded in their task, those of plain
characters by tiktoken with the same merges, others by the tokenizers
library.  Longer texts are cut into pieces
that spread over all tasks: before a space between two visible characters,
where no token crosses, and, where a text has no such place for ``PIECE``
characters, between the tokenizer's own splits.  A split longer than that
(unsplit text: the tokenizer merges over all of it) is cut into pieces
wherever its bytes end, and these are joined as a tree, neighbours in
rounds: a window of tokens around the join is encoded anew and grows on the
side that disagrees, until its first token is the left part's at that place
and its last is the right part's.  A sequence of tokens is the encoding of
its bytes if every two neighbours are, so the agreed parts make the whole
exact.

Decoding gathers the vocabulary's bytes by id and reads them as UTF-8, what
is no UTF-8 becoming replacement characters.

Defined cases: null and empty texts have no ids; the special token's string
in a text is that token, as the tokenizers library does; repeated rows and
ids are encoded each, rows without an id too; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import cut
from .packing import byte_letters

#: Characters (of unsplit text: bytes) encoded at once.
PIECE = 1 << 15

#: Distinct stretches whose ids a task remembers; more than that start anew (a cache only).
CACHE = 50_000

#: Tokens on either side of a join at first.
WINDOW = 8

#: Texts of these characters alone are split alike by both libraries (other white space, letters and numbers may differ).
PLAIN = re.compile("[\t-\r -~\u00a0-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f\u0388-\u038a\u038e-\u03a1\u03a3-\u03f5\u0400-\u0481\u2010-\u2027\u20ac]*")

#: Other texts: stretches of visible characters with the space before them, and what white space is left.
STRETCH = re.compile(r" ?\S+|\s+(?!\S)|\s+")

#: Python and the tokenizer may differ on whether these are white space; texts with them go to the library whole.
DOUBTFUL = re.compile("[\x1c-\x1f\x85\u180e\u200b-\u200f\u2028-\u202f\u2060\ufeff]")

#: A space between characters that are visible for both: a split begins there.
_VISIBLE = "[!-~\u00a1-\u167f\u1681-\u180d\u180f-\u1fff\u2070-\u2fff\u3001-\ufefe\U00010000-\U0010ffff]"
SAFE = re.compile(f"(?<={_VISIBLE}) (?={_VISIBLE})")

#: Kinds of piece beside the numbers of unsplit stretches: text, and splits in the byte-level alphabet, a space between them.
TEXT, SPLITS = 0, -1


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def library(path: str):
    """The library's tokenizer; a worker loads it once."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


@cache
def quick(path: str):
    """The same merges for tiktoken, which takes whole texts faster; None where merges aren't in the order of their ids."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    if ids != sorted(ids):
        return None
    back = {c: b for b, c in byte_letters().items()}
    special = special_strings(path)
    ranks = {bytes(back[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    # fixed value: the vocabulary's rule for splits
    rule = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=rule, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts of moderate length, and of byte strings within one split."""

    def __init__(self, path: str):
        self.path = path
        self.quick = quick(path)
        self.special = special_strings(path)
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        return library(self.path)  # loaded for texts that need it only

    @cached_property
    def model(self):
        return self.tokenizer.model

    def text(self, s: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not s:
            return b""
        if any(x in s for x in self.special) or DOUBTFUL.search(s):
            return self._ids(s)
        if self.quick and PLAIN.fullmatch(s):
            return array("I", self.quick.encode_ordinary(s)).tobytes()
        parts, known = STRETCH.findall(s), self.known
        if len(known) > CACHE:
            known.clear()
        for p in {*parts}:
            if p not in known:
                known[p] = self._ids(p)
        return b"".join(map(known.__getitem__, parts))

    def _ids(self, s: str) -> bytes:
        return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()

    def unsplit(self, raw: bytes) -> list[int]:
        """Ids of bytes that stand within one split."""
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))] if raw else []

    def join(self, left: list[int], right: list[int], vocabulary: "Vocabulary") -> list[int]:
        """Ids of two neighbouring byte strings of one split, from the ids of each."""
        if not left or not right:
            return left + right
        i, j = min(WINDOW, len(left)), min(WINDOW, len(right))
        while True:
            window = self.unsplit(vocabulary.bytes_of(left[len(left) - i:] + right[:j]))
            left_agrees = i == len(left) or window[0] == left[-i]
            right_agrees = j == len(right) or window[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[:len(left) - i] + window + right[j:]
            if not left_agrees:
                i = min(2 * i, len(left))
            if not right_agrees:
                j = min(2 * j, len(right))


class Vocabulary:
    """Bytes by id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            both = json.load(f)  # the library isn't needed to decode
        special = {x["content"]: x["id"] for x in both["added_tokens"]}
        words = both["model"]["vocab"]
        back = {c: b for b, c in byte_letters().items()}
        self.bytes = [b""] * (1 + max([*words.values(), *special.values()]))
        for w, i in words.items():
            self.bytes[i] = bytes(back[c] for c in w)
        for w, i in special.items():
            self.bytes[i] = w.encode()
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.all = np.frombuffer(b"".join(self.bytes), np.uint8)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.all[at].tobytes().decode("utf-8", "replace")


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def cut_text(s: str, path: str, piece: int = PIECE) -> Iterator[tuple[int, int, bytes]]:
    """A long text's pieces in order: kind, place within the unsplit stretch, content.

    Kind k > 0 is the k-th unsplit stretch of the text.
    """
    safe = [m.start() for m in SAFE.finditer(s)] + [len(s)]
    at = seen = stretches = 0
    while at < len(s):
        while seen + 1 < len(safe) and safe[seen + 1] - at <= piece:
            seen += 1
        end = safe[seen]  # the last safe place within the piece, or the first beyond it
        seen += 1
        if end - at <= piece:
            yield TEXT, 0, s[at:end].encode()
        else:
            for kind, content in _splits(s[at:end], path, piece):
                if kind == SPLITS:
                    yield SPLITS, 0, content
                    continue
                stretches += 1
                for k, first in enumerate(range(0, len(content), piece)):
                    yield stretches, k, content[first:first + piece]
        at = end


def _splits(s: str, path: str, piece: int) -> Iterator[tuple[int, bytes]]:
    """The tokenizer's own splits of ``s``: short ones gathered, a long one's bytes as kind 1."""
    back = {c: b for b, c in byte_letters().items()}
    kept: list[str] = []
    size = 0
    for part in re.split("(" + "|".join(map(re.escape, special_strings(path))) + ")", s):
        special = part in special_strings(path)
        found = [part] if special else [w for w, _ in library(path).pre_tokenizer.pre_tokenize_str(part)] if part else []
        for w in found:
            unsplit = len(w) > piece and not special
            if kept and (size >= piece or unsplit):
                yield SPLITS, " ".join(kept).encode()
                kept, size = [], 0
            if unsplit:
                yield 1, bytes(back[c] for c in w)
            else:
                kept.append(w)
                size += len(w)
    if kept:
        yield SPLITS, " ".join(kept).encode()


def _batches(rows: Iterator[dict], schema: pa.Schema, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` ids or bytes."""
    out: list[dict] = []
    size = 0
    for r in rows:
        out.append(r)
        size += 16 + len(r.get("ids", r.get("content", "")))
        if size > limit:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


_IDS = pa.list_(pa.int32())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str | None = None, piece: int = PIECE) -> DataFrame:
    """Rows (doc_id, ids): each row's whole text as token ids; see the module text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= piece).mapInArrow(_encoder(tokenizer_file), "doc_id long, ids array<int>")
    return short.unionByName(_encode_long(rows.where(F.length("text") > piece), tokenizer_file, piece))


def _encoder(tokenizer_file: str | None):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", _IDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = Encoder(tokenizer_file or tokenizer_path()).text
        for batch in batches:
            keys, found, size, first = batch.column(0), [], 0, 0
            for i, x in enumerate(batch.column(1)):
                found.append(text(x.as_py()))
                size += len(found[-1])
                if size > 1 << 22 or i == len(keys) - 1:
                    flat = np.frombuffer(b"".join(found), "<i4")
                    ends = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([keys.slice(first, len(found)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(_IDS)], schema=schema)
                    found, size, first = [], 0, i + 1
        pa.default_memory_pool().release_unused()
    return run


def _encode_long(rows: DataFrame, tokenizer_file: str | None, piece: int) -> DataFrame:
    """Texts in pieces over all tasks, unsplit stretches joined as a tree."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_file or tokenizer_path()
        for batch in batches:
            for row, doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                cuts = enumerate(cut_text(x.as_py(), path, piece))
                yield from _batches(({"row": row, "doc_id": doc_id, "part": p, "kind": kind, "place": k, "content": c} for p, (kind, k, c) in cuts), cut_schema)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_file or tokenizer_path())

        def of(kind: int, content: bytes) -> list[int]:
            if kind == TEXT:
                return np.frombuffer(encoder.text(content.decode()), "<u4").tolist()
            if kind > 0:
                return encoder.unsplit(content)
            return [i for w in content.decode().split(" ") for i in ([encoder.tokenizer.token_to_id(w)] if w in encoder.special else [t.id for t in encoder.model.tokenize(w)])]
        for batch in batches:
            yield from _batches(({**r, "ids": of(r["kind"], r.pop("content"))} for r in batch.to_pylist()), id_schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_file or tokenizer_path()
        encoder, words = Encoder(path), vocabulary(path)
        for batch in batches:
            yield from _batches(({**r, "ids": encoder.join(r["ids"], r.pop("right") or [], words)} for r in batch.to_pylist()), id_schema)

    key = "row long, doc_id long, part int, kind int, place int"
    base = [("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("place", pa.int32())]
    cut_schema, id_schema = pa.schema([*base, ("content", pa.binary())]), pa.schema([*base, ("ids", _IDS)])
    # the row number is only read once it is written, so a recomputed scan can't change it
    parts = cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(pieces, f"{key}, content binary"))
    found = cut(parts.repartition(F.xxhash64("row", "part")).mapInArrow(ids, f"{key}, ids array<int>"))
    stretches = found.where("kind > 0")
    places = (stretches.agg(F.max("place")).first()[0] or 0) + 1
    while places > 1:
        left = stretches.where("place % 2 = 0").withColumn("place", F.expr("cast(place / 2 as int)"))
        right = stretches.where("place % 2 = 1").select("row", "kind", F.expr("cast((place - 1) / 2 as int)").alias("place"), F.col("ids").alias("right"))
        stretches = cut(left.join(right, ["row", "kind", "place"], "left").select("row", "doc_id", "part", "kind", "place", "ids", "right").mapInArrow(join, f"{key}, ids array<int>"))
        places = (places + 1) // 2
    whole = found.where("kind <= 0").unionByName(stretches)
    return whole.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("parts")).select(
        "doc_id", F.flatten("parts.ids").alias("ids"))


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", tokenizer_file: str | None = None) -> DataFrame:
    """``df`` with the text of the ids (special tokens included) in column ``out``, in place of one of that name; null ids give a null."""
    ids_of, df = F.col(ids_col).cast("array<int>"), df.drop(out) if out != ids_col else df
    name = next(n for n in (f"_ids{i}" for i in range(len(df.columns) + 1)) if n not in df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer_file or tokenizer_path())
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            off, flat = np.asarray(ids.offsets), np.asarray(ids.values.fill_null(0))
            texts = [None if gone else words.decode(flat[a:b]) for gone, a, b in zip(np.asarray(ids.is_null()), off, off[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], out])
        pa.default_memory_pool().release_unused()

    return df.withColumn(name, ids_of).mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))
