"""Operator 7: containment search."""
import random
import re

import pytest

from cohortlake.llm import contamination as B

from .conftest import frame, prose


def words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def shingles(w, n):
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    out = set()
    for j, t in items:
        w = words(t)
        n = min(5, len(w))
        own = shingles(w, n) if w else set()
        for d, x in docs:
            shared = len(own & shingles(words(x), n)) if own else 0
            if own and d is not None and j is not None and shared >= 0.8 * len(own) - 1e-9:
                out.add((j, d, len(own), shared))
    return out


@pytest.mark.parametrize("limit", [B.BROADCAST_ROWS, 0])
def test_pairs_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(B, "BROADCAST_ROWS", limit)
    r = random.Random(6)
    items = [(i, prose(500 + i, r.choice([1, 2, 4, 5, 6, 9, 20, 60, 130]))) for i in range(30)] + [(40, None), (41, ""), (42, "--"), (None, "an item without an id of course")]
    docs = []
    for i in range(80):
        w = prose(i, r.randint(0, 200)).split()
        item = words(r.choice(items[:30])[1])
        for k in range(r.randint(0, 3)):
            if item:
                item[r.randrange(len(item))] = "changed"
        at = r.randrange(len(w) + 1)
        w[at:at] = item
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w).title()))
    docs += [(90, None), (91, ""), (None, items[5][1]), (3, docs[4][1])]
    got = B.contained_items(frame(spark, docs).repartition(3), frame(spark, items, "item_id long, text string"))
    want = {}
    for j, d, n, shared in brute(docs, items):
        want[j, d] = max(want.get((j, d), (0, 0)), (shared, n))
    assert {(x.item_id, x.doc_id): (x.n_shared, x.n_shingles) for x in got.collect()} == want and len(want) > 20


def test_drop_contaminated(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "same text here for all of us to see")], "item_id long, text string")
    kept = B.drop_contaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 3
    assert B.drop_contaminated(nothing, items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert B.drop_contaminated(awkward, none).count() == awkward.count()


def test_main_path_has_no_python(spark):
    docs, items = frame(spark, [(1, prose(1, 30))]), frame(spark, [(1, prose(1, 10))], "item_id long, text string")
    plan = B.contained_items(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_rows_go_by_their_text(spark):
    """An id on a clean and a contaminated text keeps the clean one; a contaminated row without id goes; reserved-looking columns stay."""
    from cohortlake.llm.contamination import drop_contaminated
    item = " ".join(f"word{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "all clean here, nothing else at all", 5), (1, "before " + item + " after", 6), (None, item, 7), (None, "clean without id", 8), (2, None, 9), (2, item, 1)], "doc_id long, text string, __leak0 int")
    kept = drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r[2] for r in kept.collect()) == [5, 8, 9]
