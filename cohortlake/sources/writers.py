"""Sinks (A9-A11, A13).

Large tables are written in parallel (one file per task, partitioned by
``source`` for the cohort).  Only already-aggregated reports (a few rows)
are coalesced to a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import TASK_LABEL


def write_cohort(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """The harmonized cohort, partitioned by source (registry rows stay map-only)."""
    w = df.write.mode(mode).partitionBy("source")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_task_tables(df: DataFrame, base: str, fmt: str = "parquet") -> dict[str, str]:
    """A10: one label-ready table per task (rows with a known label)."""
    out = {}
    for task, label in TASK_LABEL.items():
        path = f"{base.rstrip('/')}/{task}_training_ready"
        df.filter(F.col(label).isNotNull()).write.mode("overwrite").format(fmt).save(path)
        out[task] = path
    return out


def write_reports(coverage: DataFrame, readiness: DataFrame, base: str) -> dict[str, str]:
    """Coverage CSV (18 rows) and readiness JSON (1 row); both tiny, so one file each."""
    cov = f"{base.rstrip('/')}/feature_coverage_report"
    rdy = f"{base.rstrip('/')}/data_readiness_report"
    coverage.coalesce(1).write.mode("overwrite").option("header", "true").csv(cov)
    readiness.coalesce(1).write.mode("overwrite").json(rdy)
    return {"feature_coverage": cov, "readiness": rdy}


def append_run_reports(runs: DataFrame, path: str, fmt: str = "json") -> str:
    """Append run rows to the runs table."""
    runs.write.mode("append").format(fmt).save(path)
    return path


#: Folder of the empty files that make appended runs visible, beside the staged rows.
COMMITS, ROWS = "_commits", "rows"


def commit_run_reports(runs: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> str:
    """A13 with a commit: the rows of one run, visible as a whole or not at all, once however often they are appended.

    The rows are staged in a folder of their own for each attempt; then one
    empty file, whose creation is atomic, names run and attempt.  Readers
    (``readers.read_committed_runs``) take one attempt of each run that has
    such a file, so an attempt that died before is never seen, a repeated one
    adds nothing, and writers at the same time touch different files.
    """
    import uuid
    spark = runs.sparkSession
    if not run_id or any(c in run_id for c in "~/\\:"):
        raise ValueError("run_id must be a plain name")
    attempt = f"{run_id}~{uuid.uuid4().hex}"
    base = path.rstrip("/")
    runs.write.mode("error").format(fmt).save(f"{base}/{ROWS}/{attempt}")
    jvm = spark._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{base}/{COMMITS}/{attempt}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, False).close()
    return attempt
