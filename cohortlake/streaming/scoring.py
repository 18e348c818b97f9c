"""Incremental scoring of uploaded files as they arrive.

A stateless Structured Streaming query: file source (CSV, fixed schema)
-> the same batch-scoring projection -> Parquet sink with a checkpoint.
``availableNow`` processes every file present, then stops; a scheduler
re-runs it and the checkpoint makes each file count exactly once.
No watermark is needed: nothing is aggregated across rows.

``score_uploads`` also sets bad rows aside (A8 as files arrive): each micro
batch writes two tables, scores and rejected rows with file, line and
reason, each into a folder of its batch id.  A batch that is run again
(after a stop between the two writes, say) replaces its own folders, so
every row is found once in one of the two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.catalog import FEATURES
from ..functions.text import clean_text, to_number
from ..operators import serve as J


def upload_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def score_files(spark: SparkSession, input_dir: str, schema: T.StructType, output_dir: str, checkpoint_dir: str,
                response_model, mortality_model, max_files_per_trigger: int | None = None, **score_kw) -> str:
    """Run one ``availableNow`` pass over the upload folder; returns the output folder."""
    reader = spark.readStream.schema(schema).option("header", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream: DataFrame = reader.csv(input_dir)
    scored = J.score_batch(stream, response_model, mortality_model, **score_kw)
    q = (scored.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start(output_dir))
    q.awaitTermination()
    return output_dir


_LINE = "_corrupt_record"
TOO_LONG = "more values than columns"


def reject_reason(columns) -> Column:
    """Why an uploaded row of text can't be scored: too many values, or the first numeric feature that holds no number; NULL for good rows."""
    reason = F.when(F.col(_LINE).isNotNull(), F.lit(TOO_LONG))
    for f in FEATURES:
        if f.numeric and f.name in columns:
            reason = reason.when(clean_text(f.name).isNotNull() & to_number(f.name).isNull(), F.lit(f"{f.name} is not a number"))
    return reason


def score_uploads(spark: SparkSession, input_dir: str, columns, output_dir: str, rejected_dir: str, checkpoint_dir: str, response_model, mortality_model,
                  max_files_per_trigger: int | None = None, between: Callable[[int], None] | None = None, **score_kw) -> None:
    """One ``availableNow`` pass with both outputs; read them with ``read_batches``.

    ``between`` is called with the batch id after a batch's scores are written
    and before its rejected rows are.
    """
    schema = T.StructType([*upload_schema(columns).fields, T.StructField(_LINE, T.StringType())])
    reader = spark.readStream.schema(schema).option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.csv(input_dir).select("*", F.col("_metadata.file_path").alias("_file")).withColumn("_reason", reject_reason(columns))

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = J.score_batch(batch.filter("_reason is null").drop(_LINE, "_file", "_reason"), response_model, mortality_model, **score_kw)
        scored.write.mode("overwrite").parquet(f"{output_dir}/batch={batch_id}")
        if between:
            between(batch_id)
        line = F.coalesce(F.col(_LINE), F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]))
        bad = batch.filter("_reason is not null").select(F.col("_file").alias("file"), line.alias("line"), F.col("_reason").alias("reason"))
        bad.write.mode("overwrite").parquet(f"{rejected_dir}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches."""
    return spark.read.parquet(path).drop("batch")
