"""Operator 9, best-fit packing by planning over the length histogram.

Texts become token ids once; only (document, piece, length, checksum) rows
are kept.  The plan is made from counts by length (at most ``capacity``
rows, whatever the corpus): longest length first, into the open sequences
with the least room that still fits it.  It says, for each length, which
ranks go to which sequences at which offset.  The pieces then take their
slots by joining on length and rank within length.

The rank is computed in salted blocks whose number follows the count of
the length, so copies or a very common length don't meet in one task.

Defined cases: a null text counts as empty; an empty text is the closing
id alone; repeated rows are packed each; a row without id is packed like
any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut

CAPACITY = 2048
END_ID = 0

#: Distinct word parts and other words whose ids a task remembers (caches only).
PART_CACHE, WORD_CACHE = 300_000, 50_000

#: Texts of printable ASCII and Latin-1 letters: their lower case is composed already, so they
#: can be cut into parts here.  The words of all others go to the tokenizer as they are.
PLAIN = re.compile("[\t-\r -~\u00c0-\u00ff]*")

# The vocabulary's rule for parts, on lower-cased plain text; strings of its special tokens.
# A letter can't begin a contraction, so letters may come first.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
PART = re.compile(f"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t-\r {LETTERS}0-9]+")
SPECIAL = "<|"

#: Pieces of one length ranked by one task.
RANK_BLOCK = 50_000

#: Plan rows sent to every executor at most; a longer plan is joined by a shuffle.
BROADCAST_PLAN_ROWS = 1_000_000


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts.

    The tokenizer never joins text across ASCII white space, so a text's ids
    are those of its words in order; a plain text's are those of its parts,
    each distinct one encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ids(self, raw: bytes) -> bytes:
        """Little-endian 32-bit ids."""
        s = raw.decode()
        if PLAIN.fullmatch(s) and SPECIAL not in s:
            return self._joined(PART.findall(s.lower()), self.parts, PART_CACHE, self._part)
        return self._joined(raw.split(), self.words, WORD_CACHE, self._word)

    @staticmethod
    def _joined(found: list, known: dict, most: int, ids_of) -> bytes:
        try:
            return b"".join(map(known.__getitem__, found))
        except KeyError:
            if len(known) > most:
                known.clear()
            for x in {*found}:
                if x not in known:
                    known[x] = ids_of(x)
            return b"".join(map(known.__getitem__, found))

    def _part(self, s: str) -> bytes:
        letters = s if s.isascii() else s.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, raw: bytes) -> bytes:
        return array("I", self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids).tobytes()


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_file: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer_file or tokenizer_path()).ids  # the task's own: nothing stays in the worker
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in arrow}
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode((x.as_py() or "").encode()) + end
                for k, a in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * a:4 * (a + capacity)]
                    for name, v in zip(out, (doc_id, k, a, len(part) // 4, zlib.crc32(part))):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, arrow)
        pa.default_memory_pool().release_unused()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    arrow = arrow_schema(schema)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts by length.

    Rows (length, first rank, pieces, each, first sequence, offset): the
    ranks from ``first rank`` on fill sequences from ``first sequence`` on,
    ``each`` of them side by side in one sequence from ``offset`` on.
    """
    rows = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, number)
    rooms: list[int] = []  # its keys, in order
    sequences = 0

    def leave(space: int, first: int, number: int) -> None:
        if space and number:
            if space not in room:
                bisect.insort(rooms, space)
                room[space] = []
            room[space].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                space = rooms[at]
                first, number = room[space].pop()
                if not room[space]:
                    del room[space], rooms[at]
            else:
                space, first, number = capacity, sequences, -(-left // (capacity // length))
                sequences += number
            each = space // length
            full = min(number, left // each)
            if full:
                rows.append((length, rank, full * each, each, first, capacity - space))
                leave(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < number and left:  # the last few share one more sequence
                rows.append((length, rank, left, left, first + full, capacity - space))
                leave(space - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(space, first + full, number - full)
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_file: str | None = None) -> DataFrame:
    """Pieces with their sequence and offset; see the module text."""
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, id_col, text_col, capacity, tokenizer_file))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(counts, capacity)
    slot_df = spark.createDataFrame(slots or [(0, 0, 0, 1, 0, 0)], "slot_length long, first_rank long, pieces long, each long, first_sequence long, first_offset long")
    blocks = {k: -(-n // RANK_BLOCK) for k, n in counts.items() if n > RANK_BLOCK}
    n_blocks = F.element_at(F.create_map(*[F.lit(int(x)) for kv in blocks.items() for x in kv]), F.col("length").cast("int")) if blocks else F.lit(None)
    salted = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.coalesce(n_blocks, F.lit(1)).cast("long")))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "block").agg(F.count("*").alias("n")).select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    n_sizes = len(counts) + sum(blocks.values())
    small = (lambda df, n: F.broadcast(df) if n <= BROADCAST_PLAN_ROWS else df)
    ranked = (salted.withColumn("in_block", F.row_number().over(within) - 1)
              .join(small(sizes, n_sizes), ["length", "block"])
              .withColumn("rank", F.col("before") + F.col("in_block")))
    s = small(slot_df, len(slots))
    placed = ranked.join(s, (ranked.length == s.slot_length) & (ranked.rank >= s.first_rank) & (ranked.rank < s.first_rank + s.pieces))
    r = F.col("rank") - F.col("first_rank")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("first_sequence") + F.floor(r / F.col("each"))).cast("long").alias("sequence_id"),
                         (F.col("first_offset") + F.pmod(r, F.col("each")) * F.col("length")).cast("long").alias("offset"))
