"""Plan shape at scale: map-only registry path, no cross joins, and a miniature of the driver's oracle gate."""
import math

import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from cohortlake.functions import labels as L
from cohortlake.plans import fixtures as X
from cohortlake.plans import harmonize as H

from conftest import SF_SMALL

SLOW = {"nested_cv_lightgbm", "final_fit_xgboost", "nested_cv_tabnet", "model_sweep", "fitted_model_scoring",
        "sampled_shapley_attribution"}


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_registry_path_is_map_only(spark):
    raw = spark.read.parquet(f"{SF_SMALL}/orders.parquet").selectExpr(*X._exprs(X.REGISTRY, "string"))
    exp = raw.select(raw.row_id.cast("string").alias("row_id"),
                     *[raw[s].cast("string").alias(X.REGISTRY_COLUMNS[c]) for s, c in X.REGISTRY_SHORT.items()])
    plan = plan_text(L.keep_useful_rows(H.registry_cohort(exp)))
    assert "Exchange" not in plan
    assert "WholeStageCodegen" in plan or "*(" in plan


def test_no_cartesian_products(spark):
    for name in ("harmonized_union", "fold_metrics", "best_threshold", "readiness_summary", "active_features",
                 "roc_curve", "event_time_table", "conformal_quantile", "prediction_sets", "column_level_fallback"):
        plan = plan_text(entry.queries()[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_entry_smoke(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 18


def norm(table):
    """Rows of an Arrow table or pandas frame as sorted tuples; a number is a number whatever its width, floats to six digits."""
    if isinstance(table, pd.DataFrame):
        table = pa.Table.from_pandas(table, preserve_index=False)

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 6) + 0.0 if isinstance(v, float) else v
    names = sorted(table.column_names)
    columns = []
    for n in names:
        c = table.column(n)
        if pa.types.is_decimal(c.type):
            c = c.cast(pa.float64())
        columns.append([str(plain(v)) for v in c.to_pylist()])
    return sorted(zip(*columns))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle_sf0001(spark, duck, name):
    if name in SLOW:
        pytest.skip("model fitting")
    s = entry.queries()[name](spark, SF_SMALL).toArrow()
    d = duck.execute(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(s.column_names) == sorted(d.column_names)
    assert norm(s) == norm(d)


def test_a_file_of_one_row_group_is_spread_over_tasks(spark, duck, monkeypatch):
    """More rows than a task should have are dealt out before the recodes; the rows stay the same."""
    monkeypatch.setattr(X, "_SCANS", {})
    monkeypatch.setattr(X, "TASK_ROWS", 30)
    orders = X.table(spark, SF_SMALL, "orders")
    assert orders.rdd.getNumPartitions() == -(-orders.count() // 30) > 1
    got = entry.queries()["registry_canonical"](spark, SF_SMALL).toArrow()
    assert norm(got) == norm(duck.execute(entry.oracle_sql()["registry_canonical"]).to_arrow_table())
