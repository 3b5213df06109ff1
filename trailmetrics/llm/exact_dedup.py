"""Exact duplicates by a Grace hash: partition by content hash until every bucket fits a table.

Every text has a SHA-256 digest; its leading bits name the bucket.  Bucket sizes (bytes of
distinct texts) are counted first, and a bucket over ``bucket_bytes`` is cut by further
bits, again and again, until each part fits.  Spark's shuffle files are the spill files.

Copies inside an input chunk are merged before anything moves, so a text that fills a third
of all rows reaches its bucket as one row per chunk.  In a bucket an open-addressing table
compares complete texts; two different texts with one digest end the job rather than being
merged.  The rows then take class size and keeper from their digest's class.

Null texts count as empty; rows without a doc_id are counted as copies and never kept
before a row that has one; a class without any doc_id has no keep_id.  ``exact_duplicates``
marks every row that repeats the kept doc_id and text; ``keepers`` leaves one row a class,
of such rows the one whose columns, as JSON, have the smallest SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmetrics.llm.common import as_bytes, id_and_text, map_batches, quoted
from trailmetrics.session import materialize, ship_package

BUCKET_BYTES = 32 << 20
CHUNK_BYTES = 16 << 20
HASH_BITS = 60  # of the digest, as a whole number
STEP_BITS = 3

RECORDS = "code bigint, text string, top_id bigint, n_top bigint, n bigint"


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self, slots: int = 1024) -> None:
        self._slots = np.full(slots, -1, np.int64)
        self.codes: list[int] = []
        self.texts: list[bytes] = []
        self.top_ids: list[int | None] = []
        self.top_counts: list[int] = []  # rows with the top id
        self.counts: list[int] = []
        self.bytes = 0

    def add(self, code: int, text: bytes, top_id: int | None, n_top: int, n: int) -> None:
        mask = len(self._slots) - 1
        at = code & mask
        while (entry := self._slots[at]) >= 0:
            if self.codes[entry] == code and self.texts[entry] == text:
                held = self.top_ids[entry]
                if top_id == held:
                    self.top_counts[entry] += n_top
                elif top_id is not None and (held is None or top_id > held):
                    self.top_ids[entry], self.top_counts[entry] = top_id, n_top
                self.counts[entry] += n
                return
            at = (at + 1) & mask
        self._slots[at] = len(self.codes)
        self.codes.append(code)
        self.texts.append(text)
        self.top_ids.append(top_id)
        self.top_counts.append(n_top)
        self.counts.append(n)
        self.bytes += len(text)
        if 2 * len(self.codes) > len(self._slots):
            self._grow()

    def _grow(self) -> None:
        self._slots = np.full(2 * len(self._slots), -1, np.int64)
        mask = len(self._slots) - 1
        for entry, code in enumerate(self.codes):
            at = code & mask
            while self._slots[at] >= 0:
                at = (at + 1) & mask
            self._slots[at] = entry

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(self.codes, pa.int64()), pa.array(self.texts, pa.binary()).cast(pa.string()),
            pa.array(self.top_ids, pa.int64()), pa.array(self.top_counts, pa.int64()), pa.array(self.counts, pa.int64()),
        ], names=["code", "text", "top_id", "n_top", "n"])


def digest_code(digest: Column) -> Column:
    """The first ``HASH_BITS`` bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def merge_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge copies that are in the same chunk of about ``CHUNK_BYTES`` distinct text."""
    held = ContentTable()
    for batch in batches:
        for code, text, top_id, n_top, n in zip(
            batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(),
            batch.column(3).to_pylist(), batch.column(4).to_pylist(),
        ):
            held.add(code, text, top_id, n_top, n)
            if held.bytes >= CHUNK_BYTES:
                yield held.batch()
                held = ContentTable()
    if held.codes:
        yield held.batch()


def bucket_cuts(sizes: DataFrame, bucket_bytes: int) -> list[tuple[int, int]]:
    """(bits, prefix) of buckets that are cut further, from (code, bytes) of distinct texts.

    The first cut makes buckets a quarter full on average, so only buckets with giant
    texts appear here; one text alone is never cut.
    """
    total = sizes.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    bits = max(0, (4 * total // bucket_bytes).bit_length())
    cuts = [(bits, -1)]
    parents: set[int] | None = None
    while bits <= HASH_BITS - STEP_BITS:
        level = sizes.withColumn("prefix", F.shiftright("code", HASH_BITS - bits))
        if parents is not None:
            level = level.filter(F.shiftright("prefix", STEP_BITS).isin(sorted(parents)))
        full = (
            level.groupBy("prefix")
            .agg(F.sum("bytes").alias("bytes"), (F.max("code") > F.min("code")).alias("several"))
            .filter((F.col("bytes") > bucket_bytes) & F.col("several"))
            .select("prefix").collect()
        )
        parents = {row["prefix"] for row in full}
        if not parents:
            break
        cuts += [(bits, prefix) for prefix in sorted(parents)]
        bits += STEP_BITS
    return cuts


def split_bits(code: Column, cuts: list[tuple[int, int]]) -> tuple[Column, Column]:
    """Depth at which the code's bucket fits, and the bucket's leading bits."""
    depths = [cuts[0][0], *sorted({bits + STEP_BITS for bits, prefix in cuts if prefix >= 0})]
    bits, prefix = F.lit(depths[0]), F.shiftright(code, HASH_BITS - depths[0])
    for depth in depths[1:]:
        parents = [p for b, p in cuts if b == depth - STEP_BITS and p >= 0]
        inside = F.shiftright(code, HASH_BITS - depth + STEP_BITS).isin(parents)
        bits = F.when(inside, depth).otherwise(bits)
        prefix = F.when(inside, F.shiftright(code, HASH_BITS - depth)).otherwise(prefix)
    return bits, prefix


def classes_in_bucket(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct text of a bucket."""
    table = ContentTable()
    for batch in batches:
        for code, text, top_id, n_top, n in zip(
            batch.column("code").to_pylist(), as_bytes(batch.column("text")),
            batch.column("top_id").to_pylist(), batch.column("n_top").to_pylist(), batch.column("n").to_pylist(),
        ):
            table.add(code, text, top_id, n_top, n)
    digests = [hashlib.sha256(text).hexdigest() for text in table.texts]
    if len(set(digests)) < len(digests):
        raise ValueError("two different texts have the same SHA-256 digest")
    yield pa.RecordBatch.from_arrays([
        pa.array(digests, pa.string()), pa.array(table.top_ids, pa.int64()),
        pa.array(table.top_counts, pa.int64()), pa.array(table.counts, pa.int64()),
    ], names=["text_sha256", "keep_id", "n_keep", "group_size"])


def content_classes(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(text_sha256, keep_id, n_keep: rows with that id, group_size), one row per distinct text."""
    rows = id_and_text(docs)
    coded = rows.select(
        digest_code(F.sha2("text", 256)).alias("code"), "text", F.col("doc_id").alias("top_id"),
        F.lit(1).cast("bigint").alias("n_top"), F.lit(1).cast("bigint").alias("n"))
    sizes = coded.select("code", F.octet_length("text").cast("bigint").alias("bytes")).groupBy("code").agg(
        F.max("bytes").alias("bytes"))
    cuts = bucket_cuts(sizes, bucket_bytes)
    merged = map_batches(coded, merge_chunk, RECORDS)
    bits, prefix = split_bits(F.col("code"), cuts)
    bucketed = merged.withColumn("bits", bits).withColumn("prefix", prefix)
    ship_package(docs.sparkSession)
    return bucketed.groupBy("bits", "prefix").applyInArrow(
        classes_in_bucket, "text_sha256 string, keep_id bigint, n_keep bigint, group_size bigint")


def exact_duplicates(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row per input row.

    ``kept`` marks the row with the largest doc_id of its class; of rows that repeat that
    doc_id and text, all are marked.
    """
    rows = id_and_text(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    found = content_classes(docs, bucket_bytes)
    return rows.join(found, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keepers(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per distinct text, with all its columns whatever their names.

    Few texts have several rows with the kept doc_id (or none with one); only those rows go
    through a further grouping, which merges them before they move.  The classes, without texts, are a
    written table.
    """
    found = materialize(
        content_classes(docs).select("text_sha256", F.col("keep_id").alias("doc_id"), "n_keep"), "exact-classes")
    rows = docs.select(
        F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("text_sha256"),
        F.col("doc_id").cast("bigint").alias("doc_id"), F.struct(*map(quoted, docs.columns)).alias("row"))
    same = (rows["text_sha256"] == found["text_sha256"]) & rows["doc_id"].eqNullSafe(found["doc_id"])
    tops = rows.join(found, same).select(rows["text_sha256"], "row", "n_keep")
    first = tops.filter("n_keep > 1").groupBy("text_sha256").agg(
        F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row"))
    return tops.filter("n_keep = 1").select("row").union(first.select("row")).select("row.*")
