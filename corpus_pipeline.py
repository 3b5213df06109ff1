"""From documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trailmetrics.llm import exact_dedup, language_id, mixing, near_dedup, packing  # noqa: E402
from trailmetrics.llm.common import table  # noqa: E402
from trailmetrics.llm.queries import tokenizer_path  # noqa: E402
from trailmetrics.session import materialize  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without any letter; name the language where it is missing and can be told.

    Documents whose language is merely uncertain (short ones above all) stay, and so do all with
    a letter where no row is labelled and nothing can be learned.
    """
    # numbered names, as columns of the input may be called what the operator adds
    numbers = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    found = language_id.identify(docs.toDF(*numbers.values()), language_id.fit(docs), numbers["text"]).filter(
        language_id.has_letter(F.col(numbers["text"])))
    lang = F.coalesce(numbers["lang"], F.nullif("lang_pred", F.lit(language_id.UNKNOWN)))
    return found.select(*[(lang if name == "lang" else F.col(n)).alias(name) for name, n in numbers.items()])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts one row, with the largest doc_id."""
    return exact_dedup.keepers(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of every group of near-duplicates (five words, 80 percent)."""
    return near_dedup.keepers(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source to its target, in training order; documents read twice come twice."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise the mix and pack it into sequences."""
    return packing.packed_sequences(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack),
]

#: Neither language identification nor tokenisation can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
