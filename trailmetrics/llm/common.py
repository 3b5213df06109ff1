"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmetrics.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id (bigint, may be null) and the whole text (null becomes empty).

    Everything else is dropped first, so further columns of any name do no harm.
    """
    return docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )


def quoted(name: str) -> str:
    """A column's name as it is, also with dots or backticks in it."""
    return "`" + name.replace("`", "``") + "`"


def map_batches(
    rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(work, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def changes(data: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group of equal (number) keys starts."""
    new = np.zeros(data.num_rows, bool)
    new[:1] = True
    for key in keys:
        values = data.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` as tables of whole groups, with the groups' bounds.

    Only the group at the end of a batch is held back, so groups must be small.
    """
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        starts = changes(rows, keys)
        held = rows.slice(starts[-1])
        if starts[-1]:
            yield rows.slice(0, starts[-1]).combine_chunks(), starts
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])
