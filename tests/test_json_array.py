"""The range-wise array scan against Python's json, with ranges far smaller than elements and everything that could mislead it."""
import json

import pytest

from cohortlake.plans import fixtures as X
from cohortlake.sources import json_array as A
from cohortlake.sources import readers as RD

TRICKY = [{"case_id": 'quote " and \\ and } { ] [ "', "follow_ups": [{"ecog_performance_status": "{}", "karnofsky_performance_status": None}], "diagnoses": []},
          {"case_id": "x" * 3000 + "}" * 200, "follow_ups": None, "diagnoses": [{"prior_treatment": "yes, \\\\\" }"}] * 40},
          {"case_id": "é漢🙂", "other": {"deep": [[{"a": "]"}]]}}]


def rows(df):
    return sorted(json.dumps([r.case_id, r.follow_ups and [tuple(x) for x in r.follow_ups], r.diagnoses and [tuple(x) for x in r.diagnoses]]) for r in df.collect())


def want(docs):
    pick = lambda xs, *names: xs and [[x.get(n) for n in names] for x in xs]
    return sorted(json.dumps([d.get("case_id"), pick(d.get("follow_ups"), "ecog_performance_status", "karnofsky_performance_status"), pick(d.get("diagnoses"), "prior_treatment")]) for d in docs)


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_equals_json(spark, tmp_path, small_ranges, indent, ascii_only):
    docs = [{**TRICKY[i % 3], "case_id": f"{i}:" + TRICKY[i % 3]["case_id"]} for i in range(60)]
    (tmp_path / "a.json").write_text("﻿" + json.dumps(docs, indent=indent, ensure_ascii=ascii_only) + "\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([*TRICKY[:1], None, 'a "{ string', 3], ensure_ascii=ascii_only), encoding="utf-8")
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("\n".join(json.dumps(d, ensure_ascii=ascii_only) for d in TRICKY), encoding="utf-8")
    df = A.read_json_array(spark, str(tmp_path), RD.CASE_DOCUMENT_SCHEMA)
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 20
    assert rows(df) == want(docs + TRICKY[:1] + TRICKY)
    assert rows(RD.read_case_documents(spark, str(tmp_path / "a.json"))) == want(docs)


def test_many_lines_change_as_each_in_turn():
    """A batch is summed at once, with both beginnings, as line by line."""
    import random

    import pyarrow as pa
    draw = random.Random(2)
    for _ in range(500):
        lines = ["".join(draw.choice(["{", "[", "]", '"', '\\"', "a", ","]) for _ in range(draw.randrange(12))) for _ in range(draw.randrange(1, 5))]

        def each(inside):
            depth = 0
            for line in lines:
                change, inside = A._change(line, inside)
                depth += change
            return depth, inside
        outer, inner, odd = A._both_changes(pa.array(lines))
        assert (outer, odd) == each(False) and (inner, not odd) == each(True)


def test_missing_and_empty(spark, tmp_path):
    assert A.read_json_array(spark, str(tmp_path / "none.json"), RD.CASE_DOCUMENT_SCHEMA).collect() == []
    (tmp_path / "e.json").write_text("")
    assert A.read_json_array(spark, str(tmp_path / "e.json"), RD.CASE_DOCUMENT_SCHEMA).collect() == []


def test_arrays_of_bounded_size_are_written_and_read_back(spark, tmp_path, monkeypatch):
    """More documents than one array holds go to several files, none of which is written by one task with all of them."""
    monkeypatch.setattr(X, "ARRAY_DOCUMENTS", 10)
    docs = spark.range(95).selectExpr("id as case_id", "concat('a \"{[', id) as name")
    X.write_json_arrays(docs, str(tmp_path / "cases.json"), "case_id")
    assert len(list((tmp_path / "cases.json").glob("file=*/*.txt"))) == 10
    got = A.read_json_array(spark, str(tmp_path / "cases.json"), docs.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect()))
    X.write_json_arrays(docs.limit(0), str(tmp_path / "none.json"), "case_id")
    assert A.read_json_array(spark, str(tmp_path / "none.json"), docs.schema).count() == 0
