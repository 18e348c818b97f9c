"""The registered model queries run the families' own settings."""
import pytest

from cohortlake.operators import models as M
from cohortlake.plans import queries as Q


class Seen(Exception):
    pass


@pytest.mark.parametrize("name,use_grid", [("nested_cv_lightgbm", False), ("nested_cv_grid", True), ("nested_cv_tabnet", True), ("final_fit_xgboost", True), ("model_sweep", True)])
def test_own_rounds_grid_and_oversampling(monkeypatch, name, use_grid):
    found = []

    def seen(df, cfg):
        found.append(cfg)
        raise Seen

    monkeypatch.setattr(Q, "_mortality_training", lambda spark, sf: None)
    monkeypatch.setattr(Q, "_response_training", lambda spark, sf: None)
    monkeypatch.setattr(M, "nested_cv", seen)
    monkeypatch.setattr(M, "final_fit", seen)
    if name == "model_sweep":
        def sweep(tasks, algorithms, **kw):
            assert set(tasks) == {"response", "mortality"} and {*M.ALGORITHMS} < {*algorithms}
            seen(None, Q.TR.config("response", "xgboost", **{k: v for k, v in kw.items() if k not in ("threads", "limit")}))
        monkeypatch.setattr(Q.TR, "sweep", sweep)
    with pytest.raises(Seen):
        Q.QUERIES[name](None, "")
    assert [(c.trees, c.grid, c.oversample, c.use_grid) for c in found] == [(M.TREES, None, True, use_grid)]


def test_cohort_is_made_once(spark, monkeypatch):
    """Widths, medians, vocabularies and the encoding read stored rows: the sources are harmonized in one pass."""
    rows = [(f"r{i}", 60.0 + i % 7 if i % 5 else None, "Male" if i % 2 else "Female", 1.0 if i % 3 else None) for i in range(60)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def harmonized(spark, sf):
        from pyspark.sql import functions as F
        some = spark.createDataFrame(rows, "row_id string, age double, sex string, mortality_1yr double")
        cfg = Q.TR.config("mortality", "lightgbm")
        other = {c: F.lit(None).cast("double") for c in cfg.numeric if c not in some.columns} | {c: F.lit(None).cast("string") for c in cfg.categorical if c not in some.columns}
        return some.mapInArrow(counted, some.schema).withColumns(other)

    monkeypatch.setattr(Q, "harmonized", harmonized)
    got = Q.QUERIES["encoded_width"](spark, "").collect()
    assert [(r.n_wrong_width, r.n_rows) for r in got] == [(0, 40)] and seen.value == 60
