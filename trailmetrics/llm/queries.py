"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetrics.llm import (
    exact_dedup, fill_in_middle, language_id, license_scan, mixing, near_dedup, packing, spelling_variants,
    spherical_caps, substring_dedup, url_filter, warc, winnowing,
)
from trailmetrics.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file; ``TOKENIZER_DIR`` names another folder that holds it."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def language_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_ids(table(spark, sf_dir, "documents"))


def example_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch time within 2024, worked out from the page's id."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(525600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + minute * 60).alias("fetched_at"))


def example_entries(pages: DataFrame) -> DataFrame:
    """List entries for some of the pages' hosts and domains, worked out from the names' MD5.

    Every second of these names is on another list as well, for a time that overlaps.
    """
    host = url_filter.host_of(F.col("url"))
    names = pages.select(F.explode(F.array(host, F.substring_index(host, ".", -3))).alias("pattern")).filter(
        "pattern <> ''").distinct()
    number = F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("int")
    first = F.col("number") % 200
    def moment(days: int, listed: Column, list_number: Column) -> Column:
        return F.struct((first + days).cast("bigint").alias("day"), listed.alias("listed"),
                        F.concat(F.lit("list "), list_number % 4).alias("category"))

    yes, no, own, other = F.lit(True), F.lit(False), F.col("number"), F.col("number") + 1
    moments = F.array(
        moment(0, yes, own), moment(60, no, own), moment(120, own % 2 == 0, own),
        moment(30, own % 2 == 0, other), moment(90, no, other))
    return (
        names.withColumn("number", number).filter("number % 3 = 0")
        .withColumn("moment", F.explode(moments))
        .select("pattern", "moment.category", "moment.listed",
                F.timestamp_seconds(F.lit(1704067200) + F.col("moment.day") * 86400).alias("at"))
    )


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filter.verdicts(example_captures(pages), example_entries(pages))
    return found.withColumn("valid_from", F.date_format("valid_from", "yyyy-MM-dd"))


def exact_dedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_training_order(mixing.assignments(table(spark, sf_dir, "documents"))).drop("passes")


def repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


def sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"), tokenizer_path())


def winnowed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_documents(table(spark, sf_dir, "documents"))


def fill_in_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), outputs=False).drop("output")


def spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical_caps.vector_components(table(spark, sf_dir, "embeddings"))


def all_queries() -> dict[str, Query]:
    return {
        "op1_license_scans": license_scans,
        "op2_minhash_near_dedup": minhash_near_dedup,
        "op3_language_id": language_ids,
        "op4_url_filters": url_filters,
        "op5_exact_dedup": exact_dedups,
        "op6_warc": warc_records,
        "op7_source_mixing": source_mixing,
        "op8_substring_dedup": repeated_substrings,
        "op9_packing": sequence_packing,
        "op10_fingerprints": winnowed_fingerprints,
        "op11_fill_in_middle": fill_in_middles,
        "op12_spelling_variants": spelling_groups,
        "op13_embedding_near_dedup": embedding_near_dedup,
    }
