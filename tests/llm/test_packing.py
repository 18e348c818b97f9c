"""Operator 9: best-fit packing."""
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlake.llm import packing as P

from .conftest import frame, prose


def place(rows, counts):
    """All slots of a plan as (length, sequence, offset)."""
    out, next_rank = [], Counter()
    for length, first_rank, pieces, each, first, offset in rows:
        assert first_rank == next_rank[length]
        next_rank[length] += pieces
        out += [(length, first + r // each, offset + r % each * length) for r in range(pieces)]
    assert next_rank == Counter(counts)
    return out


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(25))
def test_plan_fills_like_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 2048])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 300))] if seed % 2 else r.choices(range(1, min(capacity, 40)), k=300)
    slots = place(P.plan(Counter(lengths), capacity), Counter(lengths))
    by = {}
    for n, s, at in slots:
        by.setdefault(s, []).append((at, n))
    for s, parts in by.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= capacity
    assert len(by) == best_fit_decreasing(lengths, capacity)


ENCODER = P.Encoder(P.tokenizer_path())


def reference_ids(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END_ID]


ODD = ["it's İstanbul <|endoftext|> a<|startoftext|>b éx ﬁ ＡＢ ²½ \u0085x y \x1c z ×÷ ÀÉß 'S 'll don't __init__ ...  q ΑΣ ΣΑΣ 漢字かな 각 🙂", "'", "''s 're're", "a\tb\nc\x0bd\x0ce\rf",
       "<|endoftext|>x <| |> <|x", "ŒUVRE ﬀ Ǆ é ́e", "", None, "x" * 3000, "!?!" * 50]


def test_ids_equal_the_tokenizer(monkeypatch):
    encode = P.Encoder(P.tokenizer_path()).ids
    for cache in (P.WORD_CACHE, 2):
        monkeypatch.setattr(P, "WORD_CACHE", cache)
        monkeypatch.setattr(P, "PART_CACHE", cache)
        for t in [*ODD, prose(1, 500), "É" + prose(2, 50).upper()]:
            assert np.frombuffer(encode((t or "").encode()), "<u4").tolist() + [0] == reference_ids(t), t


@pytest.mark.parametrize("block", [P.RANK_BLOCK, 3])
def test_pieces_and_sequences(spark, monkeypatch, block):
    monkeypatch.setattr(P, "RANK_BLOCK", block)
    texts = [*ODD, *(prose(i, 30 * i) for i in range(40)), *["same"] * 30, prose(99, 6000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (None, "no id"), (None, "no id")]
    got = P.pack(frame(spark, rows).repartition(5)).collect()
    want = Counter()
    for d, t in rows:
        ids = reference_ids(t)
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[d, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 2048
    assert len(by) == best_fit_decreasing([x.length for x in got], 2048)


def test_packing_awkward(awkward, nothing):
    got = P.pack(awkward)
    assert got.where("piece = 0").count() == awkward.count() and P.pack(nothing).count() == 0
