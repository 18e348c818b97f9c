"""Operator 5, secret scans by the token-efficiency test.

Three fixed patterns give the base spans.  Beyond them, long unbroken
strings are encoded with a public byte-level vocabulary: text a tokenizer
was made for needs few tokens, a random string needs one for every two
characters or fewer.  Known digests and identifiers are random-looking
but no secrets; they are left out before the test.

Defined cases: a null text counts as empty; an empty text has no spans;
repeated rows give repeated results; other columns are ignored.  A very
long unbroken string is encoded in blocks, so its whole length counts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_rows, texts

KINDS = ("assign", "access", "hex", "token")

# Patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_ACCESS = 8, 16

#: Strings under test; with a digit, or with a capital after a small letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")

# Digest lengths in hex digits (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[0-9+/_=-]+")

BLOCK = 256
MAX_CHARS_PER_TOKEN = 2.2


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tiktoken encoding of a vocabulary file; one per worker process."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def known(s: str) -> bool:
    """A digest of usual length, a UUID or a number."""
    return bool(len(s) in DIGEST_LENGTHS and ALL_HEX.fullmatch(s) or UUID.fullmatch(s) or NUMBER.fullmatch(s))


def chars_per_token(s: str, enc) -> float:
    return len(s) / sum(len(enc.encode_ordinary(s[i:i + BLOCK])) for i in range(0, len(s), BLOCK))


def scan(text: str, enc, ratio: float = MAX_CHARS_PER_TOKEN) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans of one text: (start, index of kind, end)."""
    base, added = [], []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    strings = list(CANDIDATE.finditer(text))
    if strings:
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        base.sort()
        for m in strings:
            s = m[0]
            if MIXED.search(s) and not known(s) and not any(a <= m.start() and m.end() <= e for a, _, e in base) and chars_per_token(s, enc) <= ratio:
                added.append((m.start(), 3, m.end()))
    base.sort()
    return base, added


def line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = MAX_CHARS_PER_TOKEN, vocabulary: str | None = None) -> DataFrame:
    """Per row: counts by kind, base spans and all spans, as ``kind:start:end`` in code points.

    One pass over the rows, no shuffle.  ``vocabulary`` is the file of a
    tiktoken vocabulary (by default the installed public one).
    """
    def fn(batch) -> Iterator[dict]:
        enc = encoding(vocabulary or vocabulary_path())
        out: dict[str, list] = {"n_assign": [], "n_access": [], "n_hex": [], "n_token": [], "base_spans": [], "spans": []}
        for text in texts(batch.column(1)):
            base, added = scan(text, enc, ratio)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(x[1] == k for x in base))
            out["n_token"].append(len(added))
            out["base_spans"].append(line(base))
            out["spans"].append(line(sorted(base + added)))
        yield {"doc_id": batch.column(0), **out}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), fn,
                    "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_spans string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]], put: str) -> str:
    """The text with every span replaced; spans that overlap or touch become one."""
    merged: list[list[int]] = []
    for a, _, e in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([a, e])
    out, at = [], 0
    for a, e in merged:
        out += [text[at:a], put]
        at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", put: str = "[SECRET]", ratio: float = MAX_CHARS_PER_TOKEN, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with every found secret replaced by ``put``; a null text stays null, all columns stay."""
    at = docs.columns.index(text_col)

    def masked(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(vocabulary or vocabulary_path())
        out = []
        for x in batch.column(at):
            text = x.as_py()
            base, added = scan(text or "", enc, ratio)
            out.append(mask(text, base + added, put) if base or added else text)
        return batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return map_batches(docs, masked)
