"""Ingest, derived tables and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import event, log, run
from trailmetrics.sources import derived, ingest, snapshots
from trailmetrics.streaming import jobs

ID = "550e8400-e29b-41d4-a716-4466554400{:02d}"
RUN = "660e8400-e29b-41d4-a716-446655440001"


def message(n, **given):
    row = {
        "event_id": ID.format(n), "workflow_id": RUN, "timestamp": f"2025-02-23T10:00:{n:02d}",
        "activity": "tool_call:check_ticket", "agent_name": "triage-agent", "agent_role": "triage",
    }
    row.update(given)
    return json.dumps({k: v for k, v in row.items() if v is not ...})


def checked(spark, *messages):
    lines = spark.createDataFrame([(m,) for m in messages], "value string")
    return ingest.validate(ingest.parse_lines(lines))


def test_minimal_event_gets_defaults(spark):
    good, bad = checked(spark, message(1))
    row = good.collect()[0]
    assert bad.count() == 0
    assert (row["status"], row["duration_ms"], row["step_number"], row["tool_parameters"]) == ("success", 0.0, 0, "{}")
    assert row["tool_name"] is None and row["parent_event_id"] is None and str(row["cost_usd"]) == "0.000000"
    assert ingest.normalise(good).collect() == good.collect()  # idempotent


def test_full_event(spark):
    params = {"ticket_id": "T-1001"}
    row = checked(spark, message(
        1, tool_name="check_ticket", tool_parameters=params, cost_usd=0.002, duration_ms=230,
        llm_prompt_tokens=100, step_number=1))[0].collect()[0]
    assert json.loads(row["tool_parameters"]) == params and row["duration_ms"] == 230.0
    assert str(row["cost_usd"]) == "0.002000" and row["step_number"] == 1


@pytest.mark.parametrize("given,reason", [
    ({"status": "great"}, "bad status"), ({"activity": "  "}, "blank activity"), ({"agent_name": ...}, "missing agent_name"),
    ({"event_id": "7"}, "bad event_id"), ({"timestamp": "soon"}, "bad timestamp"), ({"duration_ms": "long"}, "bad duration_ms"),
])
def test_bad_events_are_refused(spark, given, reason):
    good, bad = checked(spark, message(1), message(2, **given))
    assert good.count() == 1 and [r["reason"] for r in bad.collect()] == [reason]


def test_text_that_is_no_json(spark):
    assert checked(spark, "not json")[1].collect()[0]["reason"] == "missing event_id"


def test_append_and_read(spark, tmp_path):
    path = str(tmp_path / "events")
    events = log(spark, run("w1", "ab"))
    assert ingest.append_events(events.filter(F.lit(False)), path) == 0
    assert not (tmp_path / "events").exists()
    assert ingest.append_events(events, path) == 4
    assert ingest.append_events(log(spark, [event("w2", 0, "workflow:start")]), path) == 1
    assert ingest.read_events(spark, path).count() == 5


def test_step_outcomes(spark):
    answers = ['{"error": "no stock"}', '{"id": 1}', '[1, 2]', "plain", '"text"']
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, tool_response string")
    rows = ingest.with_step_outcome(df).orderBy("i").collect()
    assert [(r["status"], r["error_message"]) for r in rows] == [("failure", "no stock")] + [("success", None)] * 4
    assert rows[1]["tool_response"] == '{"id": 1}'
    assert json.loads(rows[2]["tool_response"]) == {"output": "[1, 2]"}
    assert json.loads(rows[3]["tool_response"]) == {"output": "plain"}


def test_orphan_parents(spark):
    events = log(spark, [event("w", 0, "workflow:start", event_id="p"),
                         event("w", 1, "tool_call:a", parent_event_id="p"), event("w", 2, "tool_call:b", parent_event_id="gone")])
    got = {r["parent_event_id"]: r["parent_activity"] for r in ingest.steps_with_parent(events).collect()}
    assert got == {"p": "workflow:start", "gone": None}


def test_upsert_keeps_first_description(spark):
    ddl = "workflow_id string, task_description string, embedding array<float>, model_version string, created_at timestamp_ntz"
    from datetime import datetime

    old = spark.createDataFrame([("w", "first", [1.0], "m1", datetime(2024, 1, 2))], ddl)
    new = spark.createDataFrame([("w", "second", [2.0], "m2", datetime(2024, 1, 1)), ("x", "new", None, "m2", datetime(2024, 1, 1))], ddl)
    got = {r["workflow_id"]: (r["task_description"], r["embedding"], r["model_version"]) for r in derived.upsert_embeddings(old, new).collect()}
    assert got == {"w": ("first", [2.0], "m2"), "x": ("new", None, "m2")}


def test_replace_clear_and_store(spark, tmp_path):
    path = str(tmp_path / "paths")
    old = spark.createDataFrame([("a", 1), ("b", 2)], "task_cluster string, n int")
    derived.store(old, path)
    stored = spark.read.parquet(path)
    new = spark.createDataFrame([("b", 9), ("c", 3)], "task_cluster string, n int")
    derived.store(derived.replace_paths(stored, new), path)  # reads what it overwrites
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 9), ("c", 3)}
    derived.store(derived.cleared(spark.read.parquet(path)), path)
    assert spark.read.schema("task_cluster string, n int").parquet(path).count() == 0


def test_snapshot_versions(spark, tmp_path):
    path = str(tmp_path / "paths")
    ddl = "task_cluster string, n int"
    old = spark.createDataFrame([("a", 1), ("b", 2)], ddl)
    new = spark.createDataFrame([("b", 9), ("c", 3)], ddl)
    rows = lambda version=None: {tuple(r) for r in snapshots.read(spark, path, version).collect()}
    with pytest.raises(ValueError):
        snapshots.read(spark, path)
    assert snapshots.update(spark, path, lambda now: old, "one") == 1
    assert snapshots.update(spark, path, lambda now: derived.replace_paths(now, new), "two") == 2
    assert snapshots.update(spark, path, lambda now: old.limit(0), "two") == 2  # that batch is there
    assert rows() == {("a", 1), ("b", 9), ("c", 3)} and rows(1) == {("a", 1), ("b", 2)}
    with pytest.raises(Exception, match="broken"):
        snapshots.update(spark, path, lambda now: now.withColumn("n", F.raise_error(F.lit("broken")).cast("int")))
    assert len(rows()) == 3 and len(list((tmp_path / "paths" / "data").iterdir())) == 2  # no half-written files
    assert snapshots.update(spark, path, derived.cleared) == 3 and rows() == set()
    assert snapshots.expire(spark, path, keep=1) == 2 and len(list((tmp_path / "paths" / "data").iterdir())) == 1
    assert snapshots.update(spark, path, lambda now: old, "one") == 1  # batches outlive their files


def test_snapshot_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "paths")
    row = lambda n: spark.createDataFrame([(n,)], "n int")
    snapshots.update(spark, path, lambda now: row(0))
    seen = []

    def slow(now):
        """Another writer is quicker while this one works, but only the first time."""
        if not seen:
            snapshots.update(spark, path, lambda other: other.union(row(1)))
        seen.append(now.count())
        return now.union(row(2))

    assert snapshots.update(spark, path, slow) == 3 and seen == [1, 2]
    assert sorted(r["n"] for r in snapshots.read(spark, path).collect()) == [0, 1, 2]


@pytest.mark.parametrize("offset, limit", [(0, 3), (95, 10), (40, 25), (99, 1), (100, 5), (500, 5)])
def test_far_pages(spark, offset, limit):
    from trailmetrics.operators.paging import page

    rows = [(i * 37 % 100, i % 4) for i in range(100)]
    frame = spark.createDataFrame(rows, "k int, g int").repartition(5)
    found = [tuple(r) for r in page(frame, [F.desc("g"), F.col("k")], offset, limit).collect()]
    assert found == sorted(rows, key=lambda r: (-r[1], r[0]))[offset : offset + limit]
    assert page(frame.limit(0), [F.col("k")], offset, limit).collect() == []


def test_purge_takes_ids_first(spark):
    events = log(spark, run("g", "a", mode="guided"), run("e", "a", mode="exploration"))
    vectors = spark.createDataFrame([("g",), ("e",)], "workflow_id string")
    kept_events, kept_vectors = derived.without_guided(events, vectors)
    assert {r[0] for r in kept_events.select("workflow_id").distinct().collect()} == {"e"}
    assert [r[0] for r in kept_vectors.collect()] == ["e"]


# --- streams ---------------------------------------------------------------------


def drop(folder, name, *messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(messages) + "\n")


def test_stream_ingest_then_analysis(spark, tmp_path):
    inbox = tmp_path / "in"
    drop(inbox, "1.json", message(1), message(2, status="great"))
    places = [str(tmp_path / p) for p in ("events", "refused", "checkpoint")]

    def count(events):
        return events.groupBy("workflow_id").count()

    once = jobs.ingest_then(jobs.line_stream(spark, str(inbox), 1), *places, count)
    assert once.collect()[0]["count"] == 1
    drop(inbox, "2.json", message(3), message(4))
    again = jobs.ingest_then(jobs.line_stream(spark, str(inbox), 1), *places, count)
    assert again.collect()[0]["count"] == 3  # nothing is read twice
    assert [r["reason"] for r in spark.read.parquet(places[1]).collect()] == ["bad status"]


def states(spark, tmp_path, *batches, delay="1 hour", idle_ms=3_600_000):
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    for rows in batches:
        log(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.workflow_states(jobs.event_stream(spark, source), delay, idle_ms)
        jobs.update_tables(stream, out, str(tmp_path / "check"), once=True).awaitTermination()
    updates = spark.read.parquet(f"{out}/*")
    return {r["workflow_id"]: (r["state"], r["steps"]) for r in jobs.current_states(updates, ["workflow_id"]).collect()}


def test_running_workflows(spark, tmp_path):
    from datetime import datetime

    later = datetime(2024, 1, 5)
    got = states(
        spark, tmp_path,
        run("a", "xy", end=False) + run("b", "x", end=False),
        run("b", "x")[-1:] + [event("a", 7, "tool_call:x")],
        [event("b", 3, "tool_call:x"), event("z", 0, "workflow:start", timestamp=later)],
        [event("z", 1, "tool_call:x", timestamp=later)],
    )
    assert got["b"][0] == "closed"  # an event after the end does not open it again
    assert got["a"] == ("abandoned", 7) and got["z"] == ("active", 1)


def test_duplicates_are_skipped(spark, tmp_path):
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = run("a", "xy")
    log(spark, rows, rows[:2]).coalesce(1).write.parquet(source)
    log(spark, rows[2:]).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.without_duplicates(jobs.event_stream(spark, source, 1))
    jobs.append_to(stream, out, str(tmp_path / "check"), once=True).awaitTermination()
    assert spark.read.parquet(out).count() == len(rows)


def test_workflows_share_states(spark, tmp_path, monkeypatch):
    """All workflows in one state: each keeps its own steps, end and timer."""
    from datetime import datetime

    monkeypatch.setattr(jobs, "STATE_BUCKETS", 1)
    later = datetime(2024, 1, 5)
    got = states(
        spark, tmp_path,
        run("a", "xy", end=False) + run("b", "x", end=False) + run("c", "xyz", end=False),
        run("b", "x")[-1:] + [event("a", 7, "tool_call:x"), event("d", 4, "tool_call:x")],
        [event("b", 3, "tool_call:x"), event("z", 0, "workflow:start", timestamp=later)],
        [event("z", 1, "tool_call:x", timestamp=later), event("c", 9, "tool_call:x", timestamp=later)],
    )
    assert got["b"][0] == "closed" and got["a"] == ("abandoned", 7) and got["z"] == ("active", 1) and "d" not in got
    assert got["c"] in {("abandoned", 3), ("active", 9)}
