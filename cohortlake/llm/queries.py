"""Registered queries of the corpus operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, trie, warc
from .common import table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return add


@query("op4_license_scan")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    from .licenses import scan_licenses
    return scan_licenses(table(spark, sf, "documents"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from .secrets import find_secrets
    found = find_secrets(table(spark, sf, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_token")


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    from .packing import pack
    return pack(table(spark, sf, "documents"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from .simhash import simhash_groups
    groups = simhash_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_equal")


@query("op8_imatch_fingerprints")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from .imatch import fingerprint_edits
    return fingerprint_edits(table(spark, sf, "documents"))


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from .substrings import remove_repeats
    return remove_repeats(table(spark, sf, "documents"), texts=False).withColumnRenamed("kept", "kept_sha256")


@query("op1_importance_resampling")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from .dsir import classify
    return classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_benchmark_contamination", contamination.oracle())
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op10_warc_revisits", warc.ORACLE)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.parse_records(warc.records_of_pages(table(spark, sf, "pages")))
    return warc.resolve_revisits(records).withColumn("merged", warc.header_lines(F.col("merged_headers"))).drop("merged_headers")


@query("op2_wrapper_induction")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from .wrappers import extract
    return extract(table(spark, sf, "pages"))


@query("op11_conversation_trie", trie.ORACLE)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    head = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4))
    return trie.prefix_trie(table(spark, sf, "conversations"), head, c - c % 20, most=3)


@query("op12_bpe_roundtrip")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    from .bpe import decode, encode
    both = decode(encode(table(spark, sf, "documents")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from .whitening import whiten
    return whiten(table(spark, sf, "embeddings"))
