"""Incremental scoring: each file is scored once; a rerun picks up only new files."""
import os
import tempfile

from cohortlake.plans.queries import MORTALITY_SCORER, RESPONSE_SCORER
from cohortlake.streaming import scoring as ST


def test_files_scored_once(spark):
    base = tempfile.mkdtemp(prefix="cl-stream-")
    inp, out, ck = (os.path.join(base, d) for d in ("in", "out", "ckpt"))
    os.makedirs(inp)
    cols = ["row_id", "age", "sex", "cancer_stage"]
    with open(os.path.join(inp, "a.csv"), "w") as fh:
        fh.write("row_id,age,sex,cancer_stage\n1,70,Male,IV\n2,,Female,IA\n")
    kw = dict(response_algorithm="linear", mortality_algorithm="linear")
    ST.score_files(spark, inp, ST.upload_schema(cols), out, ck, RESPONSE_SCORER, MORTALITY_SCORER, **kw)
    assert spark.read.parquet(out).count() == 2
    ST.score_files(spark, inp, ST.upload_schema(cols), out, ck, RESPONSE_SCORER, MORTALITY_SCORER, **kw)
    assert spark.read.parquet(out).count() == 2  # nothing new: the checkpoint remembers a.csv
    with open(os.path.join(inp, "b.csv"), "w") as fh:
        fh.write("row_id,age,sex,cancer_stage\n3,55,Male,IIIA\n")
    ST.score_files(spark, inp, ST.upload_schema(cols), out, ck, RESPONSE_SCORER, MORTALITY_SCORER, **kw)
    rows = {r.row_id: r for r in spark.read.parquet(out).collect()}
    assert sorted(rows) == ["1", "2", "3"]
    assert rows["2"].drug_name == "Cisplatin" and 0 < rows["3"].probability < 1


def test_a_stop_between_the_writes_leaves_every_row_once(spark, tmp_path):
    """Scores of a batch are written, then the job dies; the restart writes both outputs of that batch anew."""
    import pytest
    inp, out, bad, ck = (str(tmp_path / d) for d in ("in", "out", "bad", "ckpt"))
    os.makedirs(inp)
    cols = ["row_id", "age", "sex"]
    for name, lines in (("a", ["1,70,Male", "2,seventy,Male", "3,,Female"]), ("b", ["4,55,Female,extra", "5,NA,Male", "6,61.5,Female"])):
        with open(os.path.join(inp, f"{name}.csv"), "w") as fh:
            fh.write("\n".join([",".join(cols), *lines]) + "\n")

    def run(between=None):
        ST.score_uploads(spark, inp, cols, out, bad, ck, RESPONSE_SCORER, MORTALITY_SCORER, max_files_per_trigger=1, between=between, response_algorithm="linear", mortality_algorithm="linear")

    def stop(batch_id):
        if batch_id == 1:
            raise RuntimeError("stopped")
    with pytest.raises(Exception):
        run(stop)
    run()
    run()
    assert sorted(r.row_id for r in ST.read_batches(spark, out).collect()) == ["1", "3", "5", "6"]
    got = {r.line: (r.reason, os.path.basename(r.file)) for r in ST.read_batches(spark, bad).collect()}
    assert got == {"2,seventy,Male": ("age is not a number", "a.csv"), "4,55,Female,extra": (ST.TOO_LONG, "b.csv")}
