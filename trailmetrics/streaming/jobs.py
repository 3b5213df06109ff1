"""Streaming jobs over the event log.

Event times are often out of order between files, so every stateful job takes the
watermark delay as a parameter (default one hour).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trailmetrics.functions.measures import is_terminal, success_value
from trailmetrics.sources.ingest import parse_lines, validate
from trailmetrics.sources.schemas import EVENT_LOG_DDL

# Fixed value: how often new events are written.
FLUSH_SECONDS = 5
DEFAULT_DELAY = "1 hour"


# --- sources ------------------------------------------------------------------


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stored events as a stream."""
    reader = spark.readStream.schema(EVENT_LOG_DDL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def line_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines dropped into a folder, as a stream of text."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def event_time(column: str = "timestamp") -> Column:
    """Event time as the UTC instant of the stored wall-clock time, whatever the zone of
    the session; watermarks need this type."""
    return F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone())


# --- transformations -------------------------------------------------------------


def live_tail(events: DataFrame, workflow_id: str | None = None) -> DataFrame:
    """All events, or those of one workflow."""
    return events if workflow_id is None else events.filter(F.col("workflow_id") == workflow_id)


def without_duplicates(events: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Each event_id once; a repeat within the delay is skipped (the stored table of the
    reference refuses the whole batch instead)."""
    return (
        events.withColumn("event_time", event_time())
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .drop("event_time")
    )


def daily_timeline(events: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Finished runs per day; a tumbling window."""
    return (
        events.filter(is_terminal())
        .withColumn("event_time", event_time())
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day"))
        .agg(
            F.count("*").alias("workflows"), F.avg("duration_ms").alias("avg_duration_ms"),
            F.avg(success_value()).alias("success_rate"),
        )
        .select(
            F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86400).cast("int")).alias("day"),
            "workflows", "avg_duration_ms", "success_rate",
        )
    )


def completions_with_task(events: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Terminal events joined with the stored task description (stream-static)."""
    return events.filter(is_terminal()).select("workflow_id", "status", "timestamp").join(
        embeddings.select("workflow_id", "task_description"), "workflow_id"
    )


STATE_BUCKETS = 2048  # workflows share a state by hash, so a batch costs one call per bucket, not per workflow
STATE_DDL = "ids array<string>, steps array<bigint>, first array<bigint>, started array<boolean>, wake array<bigint>"
ACTIVE_DDL = "workflow_id string, state string, steps int, first_seen timestamp"


def workflow_states(events: DataFrame, delay: str = DEFAULT_DELAY, idle_ms: int = 86_400_000) -> DataFrame:
    """Updates of running workflows: ``active`` with the highest step and first time,
    ``closed`` at the terminal event (the state is dropped), ``abandoned`` after
    ``idle_ms`` of event time without an end.

    Events reach a state in batches, and four values are kept per workflow; a bucket's timer is
    the earliest of its workflows.
    A closed workflow keeps a mark until the idle time has passed, so events that
    arrive after the end do not open it again.
    """
    fields = ["workflow_id", "steps", "first", "started", "wake"]

    def update(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        def rows(kind, found: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({
                "workflow_id": found.index, "state": kind, "steps": found["steps"].to_numpy("int32"),
                "first_seen": pd.to_datetime(found["first"].to_numpy("int64"), unit="us")})

        watermark = state.getCurrentWatermarkMs()
        values = state.get if state.exists else [[]] * len(fields)
        known = pd.DataFrame(dict(zip(fields, values))).astype(
            {"steps": "int64", "first": "int64", "started": "bool", "wake": "int64"}).set_index("workflow_id")
        parts = [] if state.hasTimedOut else [
            batch.assign(at=batch["at"].astype("datetime64[us]").astype("int64")).groupby("workflow_id").agg(
                steps=("step_number", "max"), first=("at", "min"), newest=("at", "max"), started=("started", "any"),
                ended=("ended", "any"))
            for batch in batches if len(batch)]
        quiet = known
        if parts:
            new = pd.concat(parts).groupby(level=0).agg(
                {"steps": "max", "first": "min", "newest": "max", "started": "any", "ended": "any"})
            old = known.reindex(new.index)
            was_closed = (old["steps"] < 0).to_numpy()
            ended = new["ended"].to_numpy("bool") | was_closed
            new["steps"] = new["steps"].clip(lower=0).astype("int64").where(~(old["steps"] > new["steps"]), old["steps"]).astype("int64")
            new["first"] = new["first"].where(~(old["first"] < new["first"]), known["first"].reindex(new.index, fill_value=0))
            new["started"] = new["started"].astype("bool") | known["started"].reindex(new.index, fill_value=False)
            new["wake"] = (new["newest"] // 1000).clip(lower=watermark) + idle_ms
            shown = ~was_closed & (new["started"].to_numpy("bool") | ended)
            yield rows(pd.Series(ended[shown]).map({True: "closed", False: "active"}).to_numpy(object), new[shown])
            new["steps"] = new["steps"].where(~ended, -1)
            quiet = known[~known.index.isin(new.index)]
        late = (quiet["wake"] < watermark).to_numpy()
        lost = quiet[late]
        yield rows("abandoned", lost[(lost["steps"] >= 0) & lost["started"]])
        kept = quiet[~late]
        if parts:
            kept = pd.concat([kept, new[kept.columns]])
        if kept.empty:
            state.remove()
            return
        state.update((kept.index.tolist(), *[kept[name].tolist() for name in fields[1:]]))
        state.setTimeoutTimestamp(max(int(kept["wake"].min()), watermark + 1))

    slim = events.select(
        "workflow_id", "step_number", event_time().alias("at"), is_terminal().alias("ended"),
        (F.col("activity") == "workflow:start").alias("started"),
        F.pmod(F.xxhash64("workflow_id"), F.lit(STATE_BUCKETS)).cast("int").alias("bucket"),
    )
    return (
        slim.withWatermark("at", delay)
        .groupBy("bucket")
        .applyInPandasWithState(update, ACTIVE_DDL, STATE_DDL, "update", GroupStateTimeout.EventTimeTimeout)
    )


# --- sinks -----------------------------------------------------------------------


def append_to(
    stream: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append to Parquet, exactly once; every five seconds or all there is and stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{FLUSH_SECONDS} seconds")
    return writer.start()


def ingest(
    lines: DataFrame, events_path: str, refused_path: str, checkpoint: str, once: bool = False,
    strict_ids: bool = True,
) -> list[StreamingQuery]:
    """Validate JSON lines; good events and refused lines go to their own tables."""
    accepted, refused = validate(parse_lines(lines, "value"), strict_ids)
    return [
        append_to(accepted, events_path, f"{checkpoint}/accepted", once),
        append_to(refused.select("raw", "reason"), refused_path, f"{checkpoint}/refused", once),
    ]


def update_tables(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "update", once: bool = False
) -> StreamingQuery:
    """Write every batch of updates to its own folder; a repeated batch replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{FLUSH_SECONDS} seconds")
    return writer.start()


def current_states(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Latest update per key."""
    rest = [c for c in updates.columns if c not in keys and c not in ("b",)]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def ingest_then(
    lines: DataFrame, events_path: str, refused_path: str, checkpoint: str,
    analyse: Callable[[DataFrame], DataFrame], strict_ids: bool = True,
) -> DataFrame:
    """Take in all waiting events, then run a batch analysis over the whole log."""
    for query in ingest(lines, events_path, refused_path, checkpoint, once=True, strict_ids=strict_ids):
        query.awaitTermination()
    return analyse(lines.sparkSession.read.parquet(events_path))
