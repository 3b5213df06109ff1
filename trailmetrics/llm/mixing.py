"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a weight schedule over training progress 0..1: straight lines between
knots.  Its integral is the source's weight.  The mix takes ``share`` times the words of
all documents, split by weight; a source gives at most ``repeats`` times its size, and what
it cannot give goes to the others by weight until none is above (water level).

Documents of a source stand in a fixed pseudo-random order (MD5 of the doc_id).  The running
sum of their words is the source's token demand at the moment a document is due; inverting
the integrated schedule at that demand gives the document's training position, and range
sorting by position interleaves the sources.  The last document of a source is cut at the
source's target.

A null text has size 0, a null source is a source of its own (last in order), a null doc_id
sorts by the hash of an empty string; rows that repeat a doc_id are taken as rows of their
own.  Sources are a dimension: their table, not the documents, is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmetrics.llm.common import quoted

Schedule = list[tuple[float, float]]

#: Weight schedules given to the sources in turn: (progress, weight) knots; integrals 3, 1, 2.
SCHEDULES: list[Schedule] = [
    [(0.0, 4.0), (0.5, 3.0), (1.0, 2.0)],
    [(0.0, 1.0), (1.0, 1.0)],
    [(0.0, 1.0), (1.0, 3.0)],
]
SHARE = 1.5
REPEATS = 2
ORDER_DIGITS = 3  # hexadecimal digits of the order key that name a block of a source

NO_SOURCE = "n"  # other keys start with an s
WORD = r"[^\x20\x09-\x0D]+"


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def progress_at(demand: Column, schedule: Schedule) -> Column:
    """Progress at which the integral of the schedule is ``demand`` (a share of its whole)."""
    goal = demand * F.lit(integral(schedule))
    result, before = F.lit(1.0), 0.0
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        slope = (w1 - w0) / (t1 - t0)
        rest = goal - F.lit(before)
        x = 2 * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))))
        pieces.append((before + area, F.lit(t0) + x))
        before += area
    for end, x in reversed(pieces):
        result = F.when(goal < F.lit(end), x).otherwise(result)
    return result


def targets(sizes: DataFrame, schedules: list[Schedule], share: float, repeats: int) -> DataFrame:
    """(key, source_size, kind, target) from (key, source_size); kind: place in ``schedules``."""
    in_order = Window.orderBy(F.col("key") == NO_SOURCE, "key")
    weights = F.array(*[F.lit(integral(s)) for s in schedules])
    ranked = sizes.withColumn("kind", (F.row_number().over(in_order) - 1) % len(schedules)).withColumn(
        "weight", F.get(weights, F.col("kind"))).withColumn("most", F.lit(float(repeats)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), "kind", "key")
    ahead, every = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    levels = (
        ranked.withColumn("n", F.row_number().over(by_fill))
        .withColumn("wanted", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("most").over(ahead), F.lit(0.0)))
                    / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))))
        .withColumn("open", F.col("level") * F.col("weight") < F.col("most"))
        .withColumn("water", F.min_by("level", F.when(F.col("open"), F.col("n"))).over(every))
    )
    target = F.when(F.col("water").isNull(), F.col("most")).otherwise(
        F.least("most", F.col("water") * F.col("weight")))
    return levels.select("key", "source_size", "kind", target.alias("target"))


def assignments(
    docs: DataFrame, schedules: list[Schedule] | None = None, share: float = SHARE,
    repeats: int = REPEATS, carry: list[str] | None = None,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken and passes.

    ``passes`` lists each reading of the document: its number, the words it takes and its
    training position.  ``carry`` names further input columns to keep (as ``carried``).
    """
    schedules = schedules or SCHEDULES
    source = F.col("source").cast("string")
    ties = ["tie"] if carry else []  # rows that repeat an id keep their order in reruns
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit(NO_SOURCE)).alias("key"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))).alias("order"),
        *([F.struct(*map(quoted, carry)).alias("carried"), F.xxhash64("text").alias("tie")] if carry else []),
    ).withColumn("block", F.substring("order", 1, ORDER_DIGITS))
    blocks = rows.groupBy("key", "block").agg(F.sum("size").alias("words"))
    sources = blocks.groupBy("key").agg(F.sum("words").alias("source_size"))
    goals = targets(sources, schedules, share, repeats)
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "key", "block", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead")
    ).join(goals, "key")
    inside = Window.partitionBy("key", "block").orderBy("order", "size", *ties).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("near", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["key", "block"])
        .withColumn("start", F.col("ahead") + F.col("near"))
        .withColumn("goal", F.floor("target"))
    )

    def reading(number: int) -> Column:
        due = F.lit(number) * F.col("source_size") + F.col("start")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - due)).cast("bigint")
        share_due = due / F.nullif(F.col("target"), F.lit(0.0))
        position = F.lit(1.0)
        for kind, schedule in enumerate(schedules):
            position = F.when(F.col("kind") == kind, progress_at(share_due, schedule)).otherwise(position)
        return F.struct(F.lit(number).alias("pass"), words.alias("words"),
                        F.when(words > 0, position).alias("position"))

    read = placed.withColumn("every", F.array(*[reading(i) for i in range(repeats)]))
    passes = F.filter("every", lambda p: p["words"] > 0)
    taken = F.aggregate("every", F.lit(0).cast("bigint"), lambda a, p: a + p["words"])
    return read.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), passes.alias("passes"),
        *(["carried"] if carry else []))


def in_training_order(assigned: DataFrame) -> DataFrame:
    """Documents sorted by first training position, those not taken last."""
    return assigned.withColumn("position", F.get("passes", F.lit(0))["position"]).orderBy(
        F.col("position").asc_nulls_last(), "doc_id")


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its first ``words`` words."""
    found = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1)
    return F.array_join(F.slice(found, 1, words.cast("int")), "")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself, in training order: a row per reading, with the columns of ``docs``.

    A reading that takes only part of a document has the text cut after its last word.
    """
    columns = docs.columns
    read = assignments(docs, carry=columns, **options).select(
        "size", "carried", F.explode("passes").alias("read"))
    whole = F.col("read.words") >= F.col("size")
    text = F.when(whole, F.col("carried.text")).otherwise(first_words(F.col("carried.text"), F.col("read.words")))
    keep = [text.alias(c) if c == "text" else F.col(f"carried.{quoted(c)}").alias(c) for c in columns]
    return read.orderBy("read.position", "carried.doc_id").select(*keep)
