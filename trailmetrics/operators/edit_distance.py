"""Edit distances of tool sequences, to given paths and among all sequences.

Tools are numbered by a table, never by a list on the driver, and a distinct sequence becomes a
text of one symbol per tool, so the built-in ``levenshtein`` (banded where a limit is given)
counts edits of whole tools.

Sequences within ``k`` edits are found by a filter on length and position: cut into k + 1
pieces, the shorter one has a piece that no edit touches, which stands in the longer one at
most k places away.  Pieces and windows meet in an equi-join; every pair is then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmetrics.functions.sequences import normalised_edit_distance
from trailmetrics.operators.ordering import running_total
from trailmetrics.session import materialize

SALTS = 8  # shares of a tool or piece that many sequences have in common


def tool_numbers(sequences: DataFrame) -> DataFrame:
    """(tool, number) from 0, in the tools' order; stored."""
    tools = sequences.select(F.explode("tool_sequence").alias("tool")).distinct().withColumn("one", F.lit(1).cast("long"))
    return materialize(running_total(tools, [], ["tool"], "one", "number").select("tool", "number"), "tool-numbers")


def _symbol(number: Column) -> Column:
    """One character per number, from above the basic plane (a million tools)."""
    return F.decode(F.unhex(F.lpad(F.hex(number + 0x10000), 8, "0")), "UTF-32")


def symbol_texts(sequences: DataFrame, numbers: DataFrame) -> DataFrame:
    """(tool_sequence, symbols) of every distinct sequence; an empty one has an empty text."""
    distinct = materialize(
        sequences.select("tool_sequence").distinct().withColumn("sequence", F.monotonically_increasing_id()), "sequences")
    placed = distinct.select("sequence", F.posexplode("tool_sequence").alias("pos", "tool")).withColumn(
        "salt", F.pmod("sequence", F.lit(SALTS)).cast("int"))
    spread = numbers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    texts = placed.join(spread, ["tool", "salt"]).groupBy("sequence").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", _symbol(F.col("number")).alias("s")))),
                                 lambda e: e["s"]), "").alias("symbols"))
    return materialize(
        distinct.join(texts, "sequence", "left").select("tool_sequence", F.coalesce("symbols", F.lit("")).alias("symbols")),
        "symbol-texts")


def distances_to_paths(runs: DataFrame, paths: DataFrame, key: str = "task_cluster") -> DataFrame:
    """``runs`` with ``edits`` and ``ned`` (2 * edits / both lengths) to the path of their cluster.

    The distance is worked out once per cluster and distinct sequence.
    """
    both = materialize(runs.select("tool_sequence").union(paths.select("tool_sequence")).distinct(), "both-sequences")
    texts = symbol_texts(both, tool_numbers(both))
    best = paths.join(texts, "tool_sequence").select(key, F.col("symbols").alias("b"))
    distinct = runs.select(key, "tool_sequence").distinct().join(texts, "tool_sequence").withColumnRenamed("symbols", "a")
    measured = distinct.join(best, key).select(
        key, "tool_sequence", F.levenshtein("a", "b").alias("edits"),
        normalised_edit_distance(F.col("a"), F.col("b")).alias("ned"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = runs.withColumn("salt", F.pmod(F.xxhash64(*runs.columns), F.lit(SALTS)).cast("int"))
    return salted.join(measured, [key, "tool_sequence", "salt"]).drop("salt")


def near_sequences(sequences: DataFrame, edits: int) -> DataFrame:
    """(a, b, edits) of distinct sequences a < b (as arrays) that are at most ``edits`` apart."""
    pieces = edits + 1
    texts = materialize(
        symbol_texts(sequences, tool_numbers(sequences)).withColumn("id", F.monotonically_increasing_id())
        .withColumn("n", F.length("symbols")), "numbered-texts")
    piece = "struct(int(floor(i * {n} / {p})) AS at, int(floor((i + 1) * {n} / {p}) - floor(i * {n} / {p})) AS size)"
    shorter = texts.select("id", "n", "symbols", F.explode(F.expr(f"sequence(0, {edits})")).alias("i")).withColumn(
        "cut", F.expr(piece.format(n="n", p=pieces))).select(
        F.col("id").alias("short_id"), F.col("n").alias("length"), "i",
        F.expr("substring(symbols, cut.at + 1, cut.size)").alias("piece"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    windows = (
        texts.select("id", "n", "symbols", F.explode(F.expr(f"sequence(greatest(0, n - {edits}), n)")).alias("length"))
        .select("*", F.explode(F.expr(f"sequence(0, {edits})")).alias("i"))
        .withColumn("cut", F.expr(piece.format(n="length", p=pieces)))
        .withColumn("at", F.explode(F.expr(
            f"filter(sequence(cut.at - {edits}, cut.at + {edits}), p -> p >= 0 and p + cut.size <= n)")))
        .select(F.col("id").alias("long_id"), "length", "i", F.expr("substring(symbols, at + 1, cut.size)").alias("piece"),
                F.pmod("id", F.lit(SALTS)).cast("int").alias("salt"))
        .distinct()
    )
    found = windows.join(shorter, ["length", "i", "piece", "salt"]).filter("short_id <> long_id").select(
        "short_id", "long_id").distinct()
    one = texts.select(F.col("id").alias("short_id"), F.col("tool_sequence").alias("short"), F.col("symbols").alias("s"))
    other = texts.select(F.col("id").alias("long_id"), F.col("tool_sequence").alias("long"), F.col("symbols").alias("l"))
    verified = found.join(one, "short_id").join(other, "long_id").withColumn(
        "edits", F.levenshtein("s", "l", edits)).filter("edits >= 0")
    return verified.select(
        F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"), "edits").distinct()
