"""Operators 3, 6 and 8: SimHash groups, recompression, I-Match."""
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlake.llm import imatch as M
from cohortlake.llm import simhash as H
from cohortlake.llm import substrings as R
from cohortlake.llm.components import components

from .conftest import frame, prose


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("options", [{}, {"bucket": 4}, {"bucket": 1}])
def test_simhash_groups_equal_brute_force(spark, options):
    r = random.Random(5)
    rows, base = [], prose(1, 300).split()
    for i in range(60):  # near copies of one text, copies of another, and others
        w = list(base)
        w[r.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, "copied text of a few words") for i in range(20)] + [(200 + i, prose(200 + i, 40)) for i in range(30)] + [(300, None), (301, "")]
    got = {x.doc_id: x for x in H.simhash_groups(frame(spark, rows), **options).collect()}
    fp = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_groups(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert {i: (x.fp % (1 << 64), x.component_id) for i, x in got.items()} == {i: (fp[i], want[i]) for i in fp}


@pytest.mark.parametrize("n_blocks", H.CUTS)
def test_pigeonhole_masks_keep_close_pairs(n_blocks):
    r, masks = random.Random(n_blocks), H.block_masks(n_blocks, 3)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_components_equal_brute_force(spark):
    r = random.Random(2)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_groups({x for e in edges for x in e}, lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))
    assert got == {n: root for n, root in want.items() if n != root}


def test_near_duplicates_keep_one_row(spark, awkward, nothing):
    kept = H.drop_near_duplicates(awkward)
    ids = sorted(x.doc_id for x in kept.where("doc_id is not null").collect())
    assert kept.columns == awkward.columns and ids == [1, 4, 5, 6, 8, 9]  # 2 and 3 have no words, as 1
    assert kept.where("doc_id is null").count() == 1 and H.drop_near_duplicates(nothing).count() == 0


def test_near_duplicates_of_an_id_on_different_texts(spark):
    a, b, c, d = (prose(i, 60) for i in range(70, 74))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (None, c), (None, prose(99, 60)), (None, prose(99, 60))]
    kept = H.drop_near_duplicates(frame(spark, rows)).collect()
    assert sorted((x.doc_id or 0, x.text) for x in kept) == sorted([(1, a), (2, b), (3, c), (3, d), (0, prose(99, 60))])


def brute_repeats(rows, window=13):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in docs:
        cover = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < d:
                cover[i:i + window] = [True] * window
        out.append((d, len(w), sum(cover), hashlib.sha256(b" ".join(x for x, c in zip(w, cover) if not c)).hexdigest()))
    return sorted(out)


def repeated_texts():
    r = random.Random(11)
    passage, runs = prose(77, 60), "a a a a a a a a a a a a a a a a b b b b b b b b b"
    rows = []
    for i in range(60):
        w = prose(i, r.randint(0, 120)).split()
        for piece in r.sample([passage, runs, "x " * r.randint(5, 40), "la li " * r.randint(5, 20), " ".join(passage.split()[10:23]), " ".join(passage.split()[10:22])], 2):
            at = r.randrange(len(w) + 1)
            w[at:at] = piece.split()
        rows.append((i, " ".join(w)))
    return rows + [(100, None), (101, ""), (102, passage), (102, passage), (103, "a " * 13), (104, "a " * 40), (105, prose(3, 2000) + " " + passage)]


def test_repeats_equal_brute_force(spark, monkeypatch):
    rows = repeated_texts()
    for parts in (1, 7):
        got = R.remove_repeats(frame(spark, rows).repartition(parts), texts=False)
        assert sorted(tuple(x) for x in got.collect()) == brute_repeats(rows)


def test_small_batches_give_the_same(spark):
    rows = repeated_texts()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = R.remove_repeats(frame(spark, rows).repartition(4), texts=False)
        assert sorted(tuple(x) for x in got.collect()) == brute_repeats(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_awkward(awkward, nothing):
    got = R.remove_repeats(awkward)
    assert got.count() == awkward.count() and R.remove_repeats(nothing).count() == 0
    assert {x.n_removed for x in got.where("doc_id is null").collect()} == {0}


def test_equal_windows_take_equal_anchors():
    from cohortlake.llm.common import CODES, word_hashes
    r = random.Random(4)
    shared = prose(1, 13).split()
    for trial in range(50):
        text = prose(trial, r.randint(0, 30)).split()
        at = r.randint(0, len(text))
        found = []
        for w in (text[:at] + shared + text[at:], shared):
            raw = " ".join(w).encode()
            data, ends = np.frombuffer(raw, np.uint8), np.cumsum([len(x) + 1 for x in w]) - 1
            first, name = R.windows(word_hashes(data, ends - np.array([len(x) for x in w]), ends, CODES[0]), np.zeros(len(w), np.int64))
            found.append(name[first == (at if len(w) > 13 else 0)][0])
        assert found[0] == found[1]


def test_imatch_order_edits_and_likeness(spark):
    rows = [(10 * i, prose(i, 20 + i)) for i in range(40)] + [(5, None), (None, "no id"), (400, prose(3, 23)), (400, prose(4, 24))]
    got = M.fingerprint_edits(frame(spark, rows).repartition(5), low=0.01, high=0.9).collect()
    order = sorted(((-(1 << 63) if d is None else d, d, t or "") for d, t in rows), key=lambda x: x[0])
    assert len(got) == len(rows)
    singles = [x for x in order if x[0] != 400]
    after = {d: order[i + 1][2] for i, (_, d, _) in enumerate(order[:-1])}
    by = {x.doc_id: x for x in got if x.doc_id != 400}
    for _, d, t in singles:
        nxt = after[d]
        if d == 390:
            continue  # followed by one of the two rows of id 400
        n = len(t)
        edited = t[:n - n // 2] + nxt[:n // 2]
        assert (by[d].n_chars, by[d].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    assert by[30].fingerprint in {x.fingerprint for x in got if x.doc_id == 400}  # equal texts
    mean = [sum(getattr(x, c) for x in got) / len(got) for c in ("near_edited", "near_next")]
    assert mean[0] > mean[1]


def test_imatch_awkward(spark, awkward, nothing):
    assert M.fingerprint_edits(awkward).count() == awkward.count() and M.fingerprint_edits(nothing).count() == 0
    one = M.fingerprint_edits(frame(spark, [(1, "ab")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"aa").hexdigest()
    assert M.likeness("00000000" * 3, "00000000" * 3) == 1.0


def test_lexicon_band_counts_documents(spark):
    rows = [(i, f"all half{'' if i % 2 else 'no'} own{i} all") for i in range(20)]
    assert M.lexicon(frame(spark, rows), low=0.3, high=0.7) == ["half", "halfno"]
    assert {r.term: r.df for r in M.document_frequency(frame(spark, rows)).where(F.col("df") == 20).collect()} == {"all": 20}


def test_texts_without_lexicon_terms_are_alike_only_if_equal():
    make = M.Fingerprinter(["common", "words"])
    a, b, again = (make.slots(t) for t in (b"rare one", b"rare two", b"one, rare"))
    assert a == again and M.likeness(a, b) == 0.0 and M.likeness(a, again) == 1.0 and set(make.slots(b" ,")) == {"0"}


def test_an_id_on_different_texts(spark):
    """Marks of one text never meet another text of the same id; nothing that stands nowhere else is removed."""
    from cohortlake.llm.substrings import remove_repeats
    shared, other = prose(71, 40), prose(72, 90)
    rows = [(1, shared), (2, prose(73, 20) + " " + shared), (2, "short text"), (2, other), (2, other), (3, other + " " + prose(74, 5)), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(df).collect())
    assert got == sorted([(1, 40, 0, shared), (2, 60, 40, prose(73, 20)), (2, 2, 0, "short text"), (2, 90, 0, other), (2, 90, 0, other), (3, 95, 90, prose(74, 5)), (3, 0, 0, "")])
