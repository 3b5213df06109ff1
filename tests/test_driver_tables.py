"""The adapter stores a derived table only when a query reads it."""

import os

from trailmetrics.plans.registry import all_queries
from trailmetrics.sources import driver_tables

SF_DIR = "/root/testdata/sf0.001"


def fresh(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(driver_tables, "_LOADED", {})
    monkeypatch.setattr("trailmetrics.session.shared_dir", lambda _: str(tmp_path))
    return lambda: {name.rsplit("-", 1)[0] for name in os.listdir(tmp_path / "trailmetrics")} if (
        tmp_path / "trailmetrics").is_dir() else set()


def test_shop_queries_derive_no_agent_tables(spark, tmp_path, monkeypatch):
    folders = fresh(spark, tmp_path, monkeypatch)
    assert all_queries()["refund_eligibility"](spark, SF_DIR).count() > 0
    assert not folders() & {"event_logs", "workflow_embeddings", "labels", "optimal_paths"}


def test_labels_need_no_texts(spark, tmp_path, monkeypatch):
    folders = fresh(spark, tmp_path, monkeypatch)
    assert all_queries()["most_frequent_sequences"](spark, SF_DIR).count() > 0
    assert "labels" in folders() and not folders() & {"workflow_embeddings", "optimal_paths"}
    tables = driver_tables.load_tables(spark, SF_DIR)
    assert tables.labels.count() == tables.workflow_embeddings.count()
