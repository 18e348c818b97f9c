"""Operator 1: importance resampling."""
import random

import numpy as np
from pyspark.sql import functions as F

from cohortlake.llm import dsir as D

from .conftest import frame, prose


def corpus(n=300):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(i, r.randint(5, 200)).split()
        text = " ".join(f"{w}{r.choice(['###', '$$$'])}" for w in words) if bad else " ".join(words) + "."
        rows.append((i, text))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), int(i % 90 == 2)))
    return rows, labels


def test_unlabelled_rows_are_told_apart(spark):
    rows, labels = corpus()
    got = D.classify(frame(spark, rows).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    known = {x[0] for x in labels}
    right = [x.selected == (x.doc_id % 4 != 0) for x in got if x.doc_id not in known]
    assert len(got) == len(rows) and sum(right) / len(right) > 0.97


def test_filter_takes_the_same_decisions(spark):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (None, "text without an id"), (7, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    marks = spark.createDataFrame([*labels, (5000, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    scored = D.classify(docs, marks)
    kept = D.keep_selected(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in scored.where("selected").collect())
    assert scored.where("doc_id in (1000, 1001)").select("n_ngrams", "log_weight").distinct().collect() == [(0, 0.0)]


def test_without_labels_all_rows_stay(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert D.classify(awkward, none).where("selected").count() == awkward.count()
    assert D.classify(nothing, none).count() == 0 and D.keep_selected(nothing, none).count() == 0


def test_kth_largest_equals_sorting(spark):
    r = random.Random(3)
    keys = [r.randrange(1 << 50) for _ in range(200)] + [5] * 10
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 7, 200, 205, 210):
        assert D.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


def test_model_counts_cover_all_rows(spark):
    rows = [(1, "a b a"), (2, "b ###"), (3, None)]
    labelled = spark.createDataFrame([(1, 1)], "doc_id long, good int")
    ratio = D.fit(frame(spark, rows), labelled, buckets=64)
    raw, target = np.zeros(64), np.zeros(64)
    for (i, t) in rows[:2]:
        data = np.frombuffer(t.encode(), np.uint8)
        bucket, _ = D.ngrams(data, np.array([0, len(data)]), 64)
        np.add.at(raw, bucket, 1)
        if i == 1:
            np.add.at(target, bucket, 1)
    expected = raw * target.sum() / raw.sum()
    assert np.allclose(ratio, np.log(target + D.SMOOTHING) - np.log(expected + D.SMOOTHING))


def test_tokens_split_signs_from_words():
    data = np.frombuffer("Ab1 c### d\né!".encode(), np.uint8)
    a, b, row = D.tokens(data, np.array([0, 10, len(data)]))
    assert [bytes(data[x:y]).decode() for x, y in zip(a, b)] == ["Ab1", "c", "###", "d", "é", "!"] and row.tolist() == [0, 0, 0, 0, 1, 1]


def test_label_sample_is_bounded(spark):
    labels = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert D.label_sample(labels, 10).count() == 10


def test_toxic_rows_in_good_prose_are_found(spark):
    """Held-out toxic rows of quality 1, whose words are ordinary but for two or three, and toxic rows without a label."""
    r = random.Random(5)
    rows, labels = corpus(1200)
    insults = ["zork", "blaff", "grunt", "snivel"]
    toxic = {i for i in range(len(rows)) if i % 4 and i % 7 == 0}
    for i in toxic:
        words = rows[i][1].split()
        for w in r.sample(insults, 3):
            words.insert(r.randrange(len(words) + 1), w)
        rows[i] = (i, " ".join(words))
    labels = [(i, q, int(i in toxic)) for i, q, _ in labels]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {(x.good, x.toxic) for x in D.label_sample(known).collect()} == {(1, 0), (0, 0), (0, 1)}
    held_out = {x.doc_id for x in known.where(F.pmod(F.xxhash64(F.lit(D.SEED), "doc_id"), F.lit(D.HOLD_OUT)) == 0).collect()}
    docs = frame(spark, rows).repartition(4)
    got = {x.doc_id: x.selected for x in D.classify(docs, known).collect()}
    unseen = held_out | (got.keys() - {x[0] for x in labels})
    found = [not got[i] for i in toxic & unseen]
    kept = [got[i] for i in unseen if i % 4 and i not in toxic]
    assert len(found) > 50 and sum(found) / len(found) > 0.9 and sum(kept) / len(kept) > 0.95
    assert {x.doc_id for x in D.keep_selected(docs, known).collect()} == {i for i, s in got.items() if s}
