"""Scans of the cohort's input shapes.

All text sources are read with every column as string and cast later, so
a stray value never changes a column's type.  Header checks and "first
existing path" probes touch file metadata only (bounded, driver-side);
rows are always read by Spark in parallel.
"""

from __future__ import annotations

import csv
from typing import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import FEATURE_ORDER, TASK_LABEL
from ..functions.text import coerce_feature_types, reader_na

CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "false", "mode": "PERMISSIVE"}

FOLLOW_UP = T.StructType([T.StructField("ecog_performance_status", T.StringType()),
                          T.StructField("karnofsky_performance_status", T.StringType())])
DIAGNOSIS = T.StructType([T.StructField("prior_treatment", T.StringType())])
CASE_DOCUMENT_SCHEMA = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("follow_ups", T.ArrayType(FOLLOW_UP)),
    T.StructField("diagnoses", T.ArrayType(DIAGNOSIS)),
])
STUDY_REQUIRED = ("sampleId", "clinicalAttributeId", "value")
MUTATION_FILE_PATTERN = r"/mutations_panel_[^/]*_mutations\.csv(/|$)"


def _csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None, **opts) -> DataFrame:
    r = spark.read.options(**{**CSV_OPTIONS, **opts})
    if schema is not None:
        r = r.schema(schema)
    return r.csv(paths if isinstance(paths, str) else list(paths))


def with_reader_nulls(df: DataFrame) -> DataFrame:
    """Apply the reference reader's missing-value tokens to every string column."""
    return df.select(*[reader_na(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, in whatever file system it is (metadata only)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def first_existing_csv(spark: SparkSession, candidates: Iterable[str], empty_schema: T.StructType | None = None
                       ) -> DataFrame | None:
    """A1/A2: scan the first candidate path that exists (all columns as text); None if none does."""
    for path in candidates:
        if path_exists(spark, path):
            return with_reader_nulls(_csv(spark, path))
    if empty_schema is not None:
        return spark.createDataFrame([], empty_schema)
    return None


def read_case_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A3: nested case documents (a JSON array per file, or JSON lines); a UTF-8 BOM is accepted.

    A single JSON array is not splittable (one task per file); convert it
    once to JSON lines or Parquet when it is large.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], CASE_DOCUMENT_SCHEMA)
    return spark.read.schema(CASE_DOCUMENT_SCHEMA).option("multiLine", multi_line).json(path)


def headers(spark: SparkSession, pattern: str, recursive: bool = False, like: str = "") -> DataFrame:
    """(path, columns) of every CSV file that matches; one distributed job over the files' first blocks.

    ``like`` is a regular expression on the path.  Returns a file's columns as its header line says.
    """
    def first_lines(batches):
        seen: set[str] = set()  # files of this task
        for b in batches:
            for path, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if path not in seen:
                    seen.add(path)
                    names = next(csv.reader([(line or "").lstrip("\ufeff")]), [])
                    yield pa.RecordBatch.from_pydict({"path": [path], "columns": [names]},
                                                     pa.schema([("path", pa.string()), ("columns", pa.list_(pa.string()))]))

    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(pattern) \
        .select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("at"))
    return lines.filter((F.col("at") == 0) & F.col("path").rlike(like)).select("path", "value") \
        .mapInArrow(first_lines, "path string, columns array<string>")


def files_with_columns(spark: SparkSession, pattern: str, required: Sequence[str], recursive: bool = False, like: str = "") -> dict[tuple, list[str]]:
    """Files by header, keeping only those that have every required column.

    The driver gets file names (as it does for any scan) grouped by distinct header.
    """
    if not path_exists(spark, pattern):
        return {}
    found = headers(spark, pattern, recursive, like).groupBy("columns").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return {tuple(r["columns"]): list(r["paths"]) for r in found.collect() if set(required).issubset(r["columns"])}


def read_study_tables(spark: SparkSession, base: str, pattern: str = "*/clinical_data.csv") -> DataFrame:
    """A4: every study's EAV clinical file; files lacking required columns are skipped.

    Keeps every column the files carry (missing ones as NULL) and adds
    ``study_dir``, the file's parent folder, from the file metadata.
    """
    cols = ["sampleId", "patientId", "studyId", "clinicalAttributeId", "value"]
    out = None
    for header_cols, fs in files_with_columns(spark, f"{base.rstrip('/')}/{pattern}", STUDY_REQUIRED).items():
        raw = with_reader_nulls(_csv(spark, fs))
        extra = [c for c in header_cols if c not in cols]
        part = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in cols],
                          *extra,
                          F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("study_dir"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols + ["study_dir"]])
        return spark.createDataFrame([], schema)
    return out


def read_mutation_panels(spark: SparkSession, base: str, required: Sequence[str] = ("gene",)) -> DataFrame:
    """A5: all ``mutations_panel_*_mutations.csv`` under ``base`` at any depth.

    A recursive listing filtered on the file path; files missing a
    required column are skipped.  Returns sampleId, patientId, gene (text);
    a file without sampleId or patientId has NULLs there and takes no part in
    the flags by sample or by patient.
    """
    cols = ["sampleId", "patientId", "gene"]
    out = None
    for _, fs in files_with_columns(spark, base, required, recursive=True, like=MUTATION_FILE_PATTERN).items():
        raw = with_reader_nulls(_csv(spark, fs))
        part = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in cols])
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in cols]))
    return out


def read_training_table(spark: SparkSession, path: str, task: str) -> DataFrame:
    """Feature columns + label of one task; missing file or column raises; unlabeled rows dropped."""
    label = TASK_LABEL[task]
    df = spark.read.parquet(path)
    required = FEATURE_ORDER + [label]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns for {task}: {missing}")
    keep = (["row_id"] if "row_id" in df.columns else []) + required
    return coerce_feature_types(df.select(*keep).filter(F.col(label).isNotNull()))


def read_reports(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Run reports; unreadable documents give no row, a missing path no rows.

    ``multi_line=True`` reads one (pretty-printed) JSON document per file, the
    report files' own shape; ``False`` reads JSON lines (the runs-table sink).
    """
    s = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    df = (spark.read.schema(s).option("multiLine", str(multi_line).lower()).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


# Fields of a run's report document that the runs table takes.
NESTED_REPORT_SCHEMA = T.StructType([
    T.StructField("task", T.StringType()), T.StructField("algorithm", T.StringType()),
    T.StructField("n_rows", T.LongType()), T.StructField("label_col", T.StringType()),
    T.StructField("notes", T.ArrayType(T.StringType())),
    T.StructField("outer_mean", T.StructType([T.StructField("auc", T.DoubleType()), T.StructField("brier", T.DoubleType())])),
    T.StructField("outer_auc_ci_95", T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])),
    T.StructField("best_threshold", T.StructType([T.StructField("threshold", T.DoubleType())]))])


def read_run_reports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A7 in the documents' own nested shape, flattened to the runs table; absent parts are NULL."""
    got = read_reports(spark, path, NESTED_REPORT_SCHEMA, multi_line)
    return got.select("task", "algorithm", "n_rows", "label_col", "notes", F.col("outer_mean.auc").alias("auc"), F.col("outer_mean.brier").alias("brier"),
                      F.col("outer_auc_ci_95.lower").alias("ci_lower"), F.col("outer_auc_ci_95.upper").alias("ci_upper"),
                      F.col("best_threshold.threshold").alias("threshold"))


def committed_attempts(spark: SparkSession, path: str) -> list[str]:
    """One attempt of each committed run under ``path`` (a name per run: a listing, not data)."""
    from .writers import COMMITS
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{COMMITS}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(folder))
    first: dict[str, str] = {}
    for n in names:
        if "~" in n and not n.startswith("."):
            first.setdefault(n.rsplit("~", 1)[0], n)
    return list(first.values())


def read_committed_runs(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A7 over ``writers.commit_run_reports``: the rows of committed runs, each once."""
    from .writers import ROWS
    found = committed_attempts(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(fmt).load([f"{path.rstrip('/')}/{ROWS}/{n}" for n in found])


def read_upload(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An uploaded CSV with a typed schema; over-long rows and bad casts are flagged, not raised.

    The row-length check needs the whole row, so keep every schema column in
    the query (CSV column pruning otherwise skips it).
    Returns the rows with ``_corrupt_record`` (NULL for good rows); callers
    report ``filter(_corrupt_record.isNotNull())`` and score the rest.
    """
    s = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(s).option("header", "true").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))
