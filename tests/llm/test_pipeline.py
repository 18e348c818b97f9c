"""The pipeline, stage by stage, over the small tables."""
import re

import corpus_pipeline as P
from cohortlake.llm import contamination, dsir, packing, simhash

from .conftest import prose

SF = "/root/testdata/sf0.001"


def test_stages_act_on_what_was_kept(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "pack"] and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == columns
        seen.append((docs, after))
        docs = after
    kept = [({r.doc_id for r in a.collect()}, {r.doc_id for r in b.collect()}) for a, b in seen]
    scored = dsir.classify(seen[0][0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert kept[0][1] == {r.doc_id for r in scored.where("selected").collect()} and len(kept[0][1]) < len(kept[0][0])
    assert kept[1][1] == {r.component_id for r in simhash.simhash_groups(seen[1][0]).collect()}
    leaks = {r.doc_id for r in contamination.contained_items(seen[2][0], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert kept[2][1] == kept[2][0] - leaks and leaks
    texts = {r.doc_id: r for r in seen[3][1].collect()}
    assert kept[3][0] == kept[3][1] and all(r.n_chars == len(r.text) for r in texts.values())
    assert not any(re.search(r"[0-9a-f]{32}", r.text) for r in texts.values())
    before = {r.doc_id: r.text for r in seen[3][0].collect()}
    assert all("[SECRET]" in r.text or r.text == before[d] for d, r in texts.items())
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(texts) and max(r.length for r in packed) <= packing.CAPACITY


def test_stages_take_awkward_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id here at all", "en", "s", 3), (4, prose(4, 5000), "en", None, 1), (5, "twice", "en", "s", 5), (5, "twice", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for i, data in enumerate((rows, [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/{i}/{t}.parquet")
        got = P.run(spark, f"{tmp_path}/{i}").collect()
        assert {r.doc_id for r in got} == ({1, None, 4, 5} if data else set())


