"""Kept answers, JSON in and out, the log of jobs, the layout of the catalogue."""

import json

import pytest

from skein.operators.catalog import Catalog, LayoutError
from skein.operators.metrics import job_summary
from skein.plans.cache import AnswerCache, prewarm
from skein.plans.request import QueryError
from skein.plans.responses import document, failure, list_values
from skein.plans.settings import Settings, from_environment
from skein.sources.jobs import JobLog
from skein.sources.outbox import append_events, high_mark


def test_answers_live_and_end():
    now, made = [0.0], []
    c = AnswerCache(most=2, clock=lambda: now[0])
    ask = lambda q, kind="query", g=1: c.get(kind, g, "cfg", q, lambda: made.append(q) or q.upper())
    assert [ask("a"), ask("a"), ask("a", g=2)] == ["A", "A", "A"] and made == ["a", "a"] and c.ratio() == pytest.approx(1 / 3)
    now[0] = 31
    ask("a")
    assert made == ["a"] * 3
    ask("t", "tags")
    ask("b")
    ask("t", "tags")
    assert made == ["a", "a", "a", "t", "b"]  # the tags live longest and stay
    with pytest.raises(ZeroDivisionError):
        c.get("query", 1, "cfg", "bad", lambda: 1 / 0)
    assert prewarm(range(80), lambda r: 1 / (r % 2)) == 25


def test_json():
    assert list_values("a, b,,", ["c", " "]) == ["a", "b", "c"]
    assert json.loads(failure(QueryError("query_too_long", "too long"))) == {"error": {"code": "query_too_long", "message": "too long"}}
    assert document(b'{"entity_id": "1", "entity_type": " Post "}')["entity_type"] == "post" and document(b'{"doc_id": "x"}')["entity_type"] == "document"
    for body, code in ((b"{} {}", "invalid_json"), (b"[1]", "invalid_json"), (b'{"entity_type":"planet","entity_id":"1"}', "invalid_entity_type"), (b"{}", "missing_entity_id"), (b'{"entity_id":"1","source_version":-1}', "negative_source_version"), (b" " * 70_000, "body_too_large")):
        with pytest.raises(QueryError) as e:
            document(body)
        assert e.value.code == code


def test_jobs(spark, tmp_path):
    log = JobLog(spark, f"file://{tmp_path}")
    with log.job("full_rebuild", generation_id=3):
        pass
    with pytest.raises(RuntimeError), log.job("entity_rebuild", "post", "1"):
        raise RuntimeError("no source")
    log.job("outbox_batch").__enter__()
    assert [(r.job_type, r.status, r.error) for r in log.table().orderBy("id").collect()] == [("full_rebuild", "success", None), ("entity_rebuild", "failed", "no source"), ("outbox_batch", "running", None)]
    s = job_summary(log.table()).first()
    assert (s.failed, s.running, s.last_failure) == (1, 1, "no source") and s.last_success is not None


def test_newer_layout_is_not_opened(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    c.log.append(0, {"layout": 99, "generations": []})
    with pytest.raises(LayoutError):
        c.generations()


def test_settings_of_the_environment():
    s = from_environment({"SKEIN_WORKER_BATCH_SIZE": "9999", "SKEIN_WORKER_MAX_ATTEMPTS": " 3 ", "SKEIN_CACHE_ENTRIES": "many", "SKEIN_WORKER_ENABLED": "Off", "SKEIN_CURSOR_SECRET": " s ", "SKEIN_SCORING_TITLE_WEIGHT": "0", "SKEIN_SCORING_TAGS_WEIGHT": "nan", "OTHER_WORKER_BATCH_SIZE": "1"})
    assert (s.worker_batch_size, s.worker_max_attempts, s.cache_entries, s.worker_enabled, s.cursor_secret) == (500, 3, 2048, False, "s")
    assert (s.config.scoring.title_weight, s.config.scoring.tags_weight, s.config.scoring.payload_weight) == (0.0, 5.0, 1.0)
    assert from_environment({}) == Settings()


def test_events_are_appended_in_bulk(spark, tmp_path):
    rows = spark.range(3).selectExpr("CAST(id AS STRING) AS id", "id AS event_order")
    append_events(rows, f"{tmp_path}/feed")
    append_events(rows.selectExpr("concat('x', id) AS id", "event_order + 3 AS event_order"), f"{tmp_path}/feed")
    feed = spark.read.parquet(f"{tmp_path}/feed")
    assert feed.count() == 6 and high_mark(feed) == 5
