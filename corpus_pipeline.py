"""The corpus pipeline: documents in, packed training sequences out.

Five stages, each an operator of ``cohortlake.llm``, each over all that its
predecessor kept:

1. ``quality``: importance resampling drops the rows that it doesn't select.
2. ``near_dedup``: of each SimHash group (shingles of 3 words, 3 bits) the
   row of smallest id stays.
3. ``decontaminate``: rows that contain 0.8 or more of a benchmark item's
   5-word shingles go.
4. ``secrets``: found secrets are replaced in the text; no row goes.
5. ``pack``: best-fit packing into sequences of 2,048 tokens.

All but the last return the columns of documents.  Defined cases are those
of the operators; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.llm import contamination, dsir, packing, secrets, simhash
from cohortlake.llm.common import table
from cohortlake.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dsir.keep_selected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", scan_secrets), ("pack", pack)]

#: SQL can express neither the tokenizers nor the resampling; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
