"""Operator 4, license scans: fuzzy search for short notices.

A notice of n characters with at most k edits, cut into k + 1 parts, has
at least one part unchanged (pigeonhole).  An Aho-Corasick automaton over
all parts finds these exact seeds in one pass over a text; each seed gives
a window, and the regex library's bounded-error matching verifies it there
and reports span and edits.

Texts are compared as words: A-Z lowered, words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+
joined by one space, so line breaks, comment signs and punctuation don't count.

Defined cases: a null text counts as empty; a text without words has zero
counts, null positions, empty labels and score 0; repeated rows give
repeated results; other columns are ignored; long texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_WORDS, map_rows

# Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Opening words of well-known notices and their labels.
NOTICES = (
    *(p for p in PHRASES if p[0] != "cc by"),
    ("creative commons attribution", "cc-by"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)

#: One edit for every so many characters of a notice.
CHARS_PER_EDIT = 10


def edits(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def parts(notice: str) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 parts of nearly equal length, with their offsets."""
    n = edits(notice) + 1
    at = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:])]


_BUILT: dict[tuple, tuple] = {}


def machine(notices: tuple):
    """The automaton of all seeds and the verifying pattern of each notice; one per worker process."""
    if notices not in _BUILT:
        import ahocorasick
        import regex
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (text, _) in enumerate(notices):
            for at, part in parts(text):
                seeds.setdefault(part, []).append((i, at))
        auto = ahocorasick.Automaton()
        for part, where in seeds.items():
            auto.add_word(part, [(i, at + len(part)) for i, at in where])
        auto.make_automaton()
        _BUILT[notices] = auto, [regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(t, literal_spaces=True)}){{e<={edits(t)}}}(?!\S)") for t, _ in notices]
    return _BUILT[notices]


def fuzzy(norm: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """Verified places in a text of words: (start, end, notice, edits), distinct and in order."""
    auto, patterns = machine(notices)
    found, covered = set(), [-1] * len(notices)
    for last, where in auto.iter(norm):
        for i, upto in where:
            k, n = edits(notices[i][0]), len(notices[i][0])
            start = last + 1 - upto  # where the notice would start without edits before the seed
            if start < covered[i]:
                continue
            lo, hi = max(0, start - k - 1), start + n + k + 1
            if m := patterns[i].search(norm, lo, min(len(norm), hi)):
                if (m.end() < len(norm) and norm[m.end()] != " ") or (m.start() and norm[m.start() - 1] != " "):
                    continue
                found.add((m.start(), m.end(), i, sum(m.fuzzy_counts)))
                covered[i] = m.end() - k
    return sorted(found)


def base_places(norm: bytes) -> list[tuple[int, str]]:
    """Word index and label of every place where a base phrase stands."""
    out = []
    padded = b" " + norm + b" "
    for phrase, label in PHRASES:
        key = b" " + phrase.encode() + b" "
        at, seen, index = padded.find(key), 0, 0
        while at >= 0:
            index += padded.count(b" ", seen, at)
            seen = at
            out.append((index, label))
            at = padded.find(key, at + 1)
    return sorted(out)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple = NOTICES) -> DataFrame:
    """Per row: words, base places, labels, and the verified spans ``label:first word:words:edits``.

    One pass over the rows, no shuffle.  ``score`` is 1 for a base phrase,
    else the largest share of a notice's characters left unedited, else 0.
    """
    def fn(batch) -> Iterator[dict]:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for x in batch.column(1):
            words = (x.as_py() or "").encode().translate(TO_WORDS).split()
            norm = b" ".join(words)
            base = base_places(norm)
            text = norm.decode()
            hits = fuzzy(text, notices)
            labels = {label for _, label in base}
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(base[0][0] if base else None)
            out["last_word"].append(base[-1][0] if base else None)
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | {notices[i][1] for _, _, i, _ in hits})))
            out["score"].append(1.0 if base else max((max(0.0, 1 - e / len(notices[i][0])) for _, _, i, e in hits), default=0.0))
            out["spans"].append(",".join(f"{notices[i][1]}:{text.count(' ', 0, a)}:{text.count(' ', a, b) + 1}:{e}" for a, b, i, e in hits))
        yield {"doc_id": batch.column(0), **out}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), fn,
                    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
