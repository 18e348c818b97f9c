"""Encoding and decoding against the tokenizers library, in one piece, in small pieces and as a tree."""
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlake.llm import bpe, queries

PATH = bpe.tokenizer_path()
LETTERS = ["a", "the", "er", " ", "  ", "\n", "\t", "'s", "'re", "'", "1", "23", "?!", "é", "漢", "🙂", "<|endoftext|>", " ", "　", "\x1c", "\x85", "​", "x" * 30]


def wanted(text):
    return bpe.library(PATH).encode(text or "", add_special_tokens=False).ids


def decoded(ids):
    return bpe.library(PATH).decode(ids, skip_special_tokens=False)


def by_pieces(text, piece):
    """cut_text and the tree of joins, without Spark."""
    e, v = bpe.Encoder(PATH), bpe.vocabulary(PATH)
    out, stretches = [], {}
    for part, (kind, place, content) in enumerate(bpe.cut_text(text, PATH, piece)):
        if kind == bpe.TEXT:
            out.append((part, np.frombuffer(e.text(content.decode()), "<u4").tolist()))
        elif kind == bpe.SPLITS:
            out.append((part, [i for w in content.decode().split(" ") for i in ([50256] if w in e.special else [t.id for t in e.model.tokenize(w)])]))
        else:
            stretches.setdefault(kind, []).append((part, e.unsplit(content)))
    for run in stretches.values():
        while len(run) > 1:
            run = [(run[i][0], e.join(run[i][1], run[i + 1][1], v) if i + 1 < len(run) else run[i][1]) for i in range(0, len(run), 2)]
        out.append(run[0])
    return [i for _, ids in sorted(out) for i in ids]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(LETTERS) | st.characters(exclude_categories=["Cs"]), max_size=60).map("".join), st.sampled_from([2, 7, 20]))
def test_any_text_in_any_pieces(text, piece):
    ids = wanted(text)
    assert np.frombuffer(bpe.Encoder(PATH).text(text), "<u4").tolist() == ids
    assert by_pieces(text, piece) == ids
    assert bpe.vocabulary(PATH).decode(np.array(ids, int)) == decoded(ids)


def test_joins_are_exact_anywhere():
    r = random.Random(5)
    e, v = bpe.Encoder(PATH), bpe.vocabulary(PATH)
    for k in range(200):
        text = "".join(r.choices("abcdefghilmnoprstu"[:r.randint(1, 18)], k=r.randint(2, 1500)))
        at = r.randint(0, len(text))
        assert e.join(e.unsplit(text[:at].encode()), e.unsplit(text[at:].encode()), v) == wanted(text)


def test_long_and_awkward_rows(spark, awkward, nothing):
    rows = [(1, "ab" * 60_000), (1, "a" * 40_000 + " " + "b c" * 20_000), (2, "🙂é" * 20_000), (None, " " * 50_000 + "x"), (3, None), (3, "same"), (3, "same"), (4, "漢字。" * 20_000), (5, "<|endoftext|>" * 4000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids int, part string").unionByName(awkward.selectExpr("doc_id", "text", "1 as ids", "fp as part")).repartition(4)
    got = sorted((r.doc_id or 0, r.ids, r.decoded) for r in bpe.decode(bpe.encode(df)).collect())
    assert got == sorted((r.doc_id or 0, wanted(r.text), decoded(wanted(r.text))) for r in df.collect())
    assert bpe.decode(bpe.encode(nothing)).collect() == []
    clash = spark.createDataFrame([([1, 2], "old"), (None, "old")], "ids array<int>, decoded string")
    assert [(r.ids, r.decoded) for r in bpe.decode(clash).collect()] == [([1, 2], decoded([1, 2])), (None, None)]


def test_no_utf8_becomes_replacement_characters():
    ids = [i for w in ("é", "漢") for i in wanted(w)][1:]
    assert bpe.vocabulary(PATH).decode(np.array(ids, int)) == decoded(ids)


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = wanted(r.text)
        want[r.doc_id] = (len(ids), digest(",".join(map(str, ids))), digest(decoded(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op12_bpe_roundtrip"](spark, sf).collect()} == want
