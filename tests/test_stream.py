"""Generations, rebuilds and the stream worker."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from skein.operators.catalog import Catalog, IndexUnavailable, Moved, RebuildInProgress, rebuild, rebuild_entity
from skein.operators.search import RESULT, search
from skein.operators.tags import tag_index
from skein.plans.request import Request
from skein.plans.responses import answer
from skein.queries import index
from skein.sources.adapters import ROW
from skein.sources.manifests import ManifestLog
from skein.sources.outbox import acknowledged, claim, eligible, failed, marked, released
from skein.streaming.outbox import EVENT_SCHEMA, OutboxStream, event_stream

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
T = datetime(2025, 1, 1)


def source_rows(spark, titles):
    """Adapter rows of posts: id -> title."""
    rows = [("post", k, v, "published", "public", "b", "u", '["mod"]', "[]", "[]", "a secret body", 1, 2, 0, 0, T, T, "{}") for k, v in titles.items()]
    kinds = dict.fromkeys(ROW, "string") | dict.fromkeys(["view_count", "like_count", "download_count", "favorite_count"], "bigint") | dict.fromkeys(["created_at", "updated_at"], "timestamp")
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds[c]}" for c in ROW))


def events(spark, *rows):
    """(id, entity, action, order)"""
    return spark.createDataFrame([(i, "post", e, a, n, T) for i, e, a, n in rows], EVENT_SCHEMA)


def feed_rows(spark, *rows):
    """Events with the state of their delivery."""
    return events(spark, *rows).withColumns({"attempts": F.lit(0), "failed_at": F.lit(None).cast("timestamp"), "processed_at": F.lit(None).cast("timestamp")})


def titles(catalog):
    return {r.entity_id: (r.title, r.status, r.source_version) for r in catalog.rows().collect()}


def test_generation_states(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    with pytest.raises(IndexUnavailable):
        c.active()
    one = c.create(5)
    with pytest.raises(RebuildInProgress):
        c.create(6)
    c.activate(one)
    two = c.create(6)
    c.activate(two)
    assert {g["id"]: g["status"] for g in c.generations()} == {one: "retired", two: "active"}
    c.activate(one)
    assert c.active()["id"] == one
    three = c.create(7)
    c.fail(three, "x")
    with pytest.raises(ValueError):
        c.activate(three)
    stale = c.create(8)
    assert c.recover() == [] and c.recover(lease_s=-1) == [stale]  # young, then old


def test_a_living_build_is_not_taken_for_dead(spark, tmp_path):
    now = [NOW]
    c = Catalog(spark, f"file://{tmp_path}/c", lambda: now[0])
    id = c.create(1)
    now[0] = datetime(2026, 2, 1, tzinfo=timezone.utc)
    with c.building(id):  # created long ago, but its lease is fresh
        assert c.recover() == []
        with pytest.raises(RebuildInProgress):
            rebuild(c, lambda: source_rows(spark, {"1": "x"}), lambda: feed_rows(spark))
        assert c.generations()[-1]["status"] == "building"
    assert c.recover() == [id]


def test_of_two_writers_one_fails_and_a_killed_one_leaves_no_cut_entry(spark, tmp_path):
    log = ManifestLog(spark, f"file://{tmp_path}/log")
    log.append(0, {"a": 1})
    with pytest.raises(FileExistsError):
        log.append(0, {"b": 2})
    assert log.last() == (1, {"a": 1}) and sorted(x.name for x in (tmp_path / "log").iterdir() if not x.name.startswith(".")) == ["000000000000.json"]
    (tmp_path / "log" / "_dead").write_text('{"cut')  # what a writer that died has left
    log.append(1, {"c": 3})
    assert log.all() == [{"a": 1}, {"c": 3}]
    c, d = (Catalog(spark, f"file://{tmp_path}/c") for _ in range(2))
    id = c.create(1)
    seen = c.generations()[0]
    d.put(id, {"files": {}, "schema": None, "tags": None, "documents": 7})
    with pytest.raises(Moved):
        c.put(id, {"files": {}, "schema": None, "tags": None, "documents": 8}, seen=seen)
    assert c.generations()[0]["documents"] == 7


def test_rows_that_are_lost_on_the_way_make_a_generation_invalid(spark, tmp_path, monkeypatch):
    c = Catalog(spark, f"file://{tmp_path}/c", lambda: NOW)
    good = rebuild(c, lambda: source_rows(spark, {"1": "x", "2": "y"}), lambda: feed_rows(spark))
    whole = Catalog.read
    monkeypatch.setattr(Catalog, "read", lambda self, g, buckets=None: whole(self, g, buckets).where("entity_id = '1'"))
    with pytest.raises(ValueError, match="invalid generation"):
        rebuild(c, lambda: source_rows(spark, {"1": "x", "2": "y"}), lambda: feed_rows(spark))
    assert c.active()["id"] == good and c.generations()[-1]["status"] == "failed"


def test_claim_acknowledge_fail_release(spark):
    kinds = "id string, event_order bigint, created_at timestamp, updated_at timestamp, processed_at timestamp, failed_at timestamp, locked_at timestamp, last_error string, attempts int"
    feed = spark.createDataFrame([(x, n, T, T, None, None, None, None, 1) for n, x in enumerate("abcd")] + [("z", 9, T, T, NOW, None, None, None, 1)], kinds)
    picked = claim(feed, NOW, 3)
    feed = marked(feed, picked, NOW)
    assert {r.id for r in feed.where("locked_at IS NOT NULL").collect()} == {"a", "b", "c"} and [r.id for r in claim(feed, NOW).collect()] == ["d"]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    later = datetime(2026, 1, 2, tzinfo=timezone.utc)
    feed, lost = acknowledged(feed, ids("a", "d"), NOW, later)
    assert [r.id for r in lost.collect()] == ["d"]
    feed, lost = failed(feed, spark.createDataFrame([("b", "界" * 400)], "id string, error string"), NOW, later)
    assert lost.count() == 0
    feed, _ = released(feed, ids("c"), NOW)
    rows = {r.id: r for r in feed.collect()}
    assert rows["a"].processed_at and not rows["a"].locked_at and rows["b"].attempts == 2 and rows["b"].last_error == "界" * 333 and rows["b"].failed_at
    assert rows["c"].attempts == 1 and not rows["c"].locked_at and not rows["d"].processed_at and len(rows) == 5
    assert {r.id for r in eligible(feed, later).collect()} == {"c", "d"}  # b rests


def test_rebuild_catches_up_and_keeps_post_bodies_private(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c", lambda: NOW)
    old = feed_rows(spark, ("a", "1", "upsert", 3))
    new = old.unionByName(feed_rows(spark, ("b", "2", "delete", 4), ("c", "1", "update", 5)))
    seen = []

    def feed():
        seen.append(1)
        return old if len(seen) < 3 else new  # the feed grows during the build

    id = rebuild(c, lambda: source_rows(spark, {"1": "First mod", "2": "Second"}), feed)
    assert c.active()["id"] == id and c.active()["watermark"] == 5
    assert titles(c) == {"1": ("First mod", "active", 5), "2": ("Second", "deleted", 4)}
    page = search(c.rows(), Request(query="secret", highlight=True, scoring_time=NOW), generation=id)
    row = page.items.collect()[0]
    assert page.total == 1 and row.entity_id == "1" and "secret" not in str(row.asDict()) and "secret" not in answer(page)
    assert page.items.columns[: len(RESULT)] == RESULT and set(page.items.columns) - set(RESULT) == {"score", "matched", "hl_title", "hl_tags", "hl_keywords", "hl_payload"}
    assert {r.tag: r.total_count for r in c.tags().collect()} == {"mod": 1}


def test_rebuild_catches_up_until_nothing_is_left(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c", lambda: NOW, buckets=1)
    feed = [("a", "1", "update", 50)]
    late = [("k", "2", "delete", 7)] + [(f"e{n}", "1", "update", 50 + n) for n in range(1, 7)]  # the first lies below the mark
    looks = []

    def events_now():
        looks.append(1)
        if len(looks) > 2 and late:
            feed.append(late.pop(0))
        return feed_rows(spark, *feed)

    rebuild(c, lambda: source_rows(spark, {"1": "one", "2": "two"}), events_now)
    assert titles(c) == {"1": ("one", "active", 56), "2": ("two", "deleted", 7)} and c.active()["watermark"] == 56


def test_switch_and_stream_lose_no_event(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c", lambda: NOW, buckets=1)
    feed, looks = [("a", "1", "update", 5)], []
    posts = lambda: source_rows(spark, {"1": "one", "2": "two", "3": "three"})
    old = rebuild(c, posts, lambda: feed_rows(spark, *feed))
    w = OutboxStream(c, posts, f"file://{tmp_path}/ck")

    def events_now():
        looks.append(1)
        seen = feed_rows(spark, *feed)
        if len(looks) == 3:  # the stream gets and commits an event between the last look and the switch
            feed.append(("b", "2", "delete", 6))
            w.apply(events(spark, feed[-1], ("x", " ", "update", 6)), 0)
        return seen

    new = rebuild(c, posts, events_now)
    assert c.active()["id"] == new != old and titles(c)["2"] == ("two", "deleted", 6)
    assert c.active()["batch"] == 0 and [r.id for r in w.dead().collect()] == ["x"]
    turned = []

    def posts_then_switch():  # the switch comes while a batch is at work on the generation before
        if not turned:
            turned.append(rebuild(c, posts, lambda: feed_rows(spark, *feed)))
        return posts()

    OutboxStream(c, posts_then_switch, f"file://{tmp_path}/ck").apply(events(spark, ("c", "3", "delete", 8)), 1)
    assert c.active()["id"] == turned[0] and titles(c)["3"] == ("three", "deleted", 8) and c.active()["batch"] == 1


def test_failed_rebuild_leaves_the_active_generation(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c", lambda: NOW)
    good = rebuild(c, lambda: source_rows(spark, {"1": "x"}), lambda: feed_rows(spark))
    with pytest.raises(Exception):
        rebuild(c, lambda: source_rows(spark, {"1": "x", " 1": "same key"}), lambda: feed_rows(spark))
    assert c.active()["id"] == good and c.generations()[-1]["status"] == "failed"


def test_stream_applies_late_repeated_and_broken_events_once(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c", lambda: NOW)
    rebuild(c, lambda: source_rows(spark, {"1": "one", "2": "two", "4": "four"}), lambda: feed_rows(spark))
    inbox = f"{tmp_path}/inbox"
    events(spark, ("a", "1", "update", 10), ("b", "2", "delete", 11), ("x", " ", "update", 12)).coalesce(1).write.mode("append").parquet(inbox)
    w = OutboxStream(c, lambda: source_rows(spark, {"1": "one, again", "2": "two", "3": "three"}), f"file://{tmp_path}/ck", attempts=2, retry_s=0)
    w.start(event_stream(spark, inbox), available_now=True).awaitTermination()
    assert titles(c) == {"1": ("one, again", "active", 10), "2": ("two", "deleted", 11), "4": ("four", "active", 0)}
    late = events(spark, ("c", "2", "update", 7), ("a", "1", "update", 10), ("d", "3", "insert", 13), ("e", "4", "update", 14))
    late.coalesce(1).write.mode("append").parquet(inbox)
    w.start(event_stream(spark, inbox), available_now=True).awaitTermination()
    assert titles(c) == {"1": ("one, again", "active", 10), "2": ("two", "deleted", 11), "3": ("three", "active", 13), "4": ("four", "deleted", 14)}
    assert [(r.id, r.attempts, r.last_error) for r in w.dead().collect()] == [("x", 2, "no entity id")]
    before = c.active()["files"]
    w.apply(late, c.active()["batch"])  # the same batch again
    assert c.active()["files"] == before
    whole = {r.tag: r.total_count for r in tag_index(c.rows()).collect()}
    assert {r.tag: r.total_count for r in c.tags().collect()} == whole == {"mod": 2}


def test_entity_rebuild(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c", lambda: NOW)
    rebuild(c, lambda: source_rows(spark, {"1": "old", "2": "x", "3": "y"}), lambda: feed_rows(spark))
    before = c.active()["files"]
    report = rebuild_entity(c, source_rows(spark, {"1": "new"}), "post", "1", 3)
    after = c.active()["files"]
    assert [k for k in after if after[k] != before.get(k)] == [k for k in before if after[k] != before[k]] and len(after) - len([k for k in after if after[k] == before.get(k)]) == 1  # one bucket was rewritten
    assert report.collect()[0].applied and titles(c)["1"] == ("new", "active", 3)
    assert not rebuild_entity(c, source_rows(spark, {"1": "older"}), "post", "1", 2).collect()[0].applied
    assert titles(c)["1"][0] == "new"


def test_eligible_events(spark):
    rows = [("ok", None, None, None, 0), ("done", NOW, None, None, 1), ("locked", None, NOW, None, 1), ("expired", None, datetime(2025, 12, 31), None, 1), ("resting", None, None, NOW, 1), ("used up", None, None, datetime(2025, 1, 1), 10)]
    df = spark.createDataFrame(rows, "id string, processed_at timestamp, locked_at timestamp, failed_at timestamp, attempts int")
    assert {r.id for r in eligible(df, NOW).collect()} == {"ok", "expired"}
    assert eligible(df.where(F.lit(False)), NOW).count() == 0


def test_outbox_range_follows_the_generations(spark, tmp_path):
    feed_rows(spark, *[(f"e{n}", "1", "update", n) for n in (3, 4, 5, 8, 9)]).withColumn("updated_at", F.col("created_at")).write.parquet(f"{tmp_path}/search_index_events.parquet")

    def ids(*generations):
        rows = spark.createDataFrame(generations, "id bigint, status string, source_high_watermark bigint")
        rows.write.mode("overwrite").parquet(f"{tmp_path}/index_generations.parquet")
        return sorted(r.id for r in index.outbox_range(spark, str(tmp_path)).collect())

    assert ids((1, "retired", 9), (2, "active", 3), (3, "building", 8)) == ["e4", "e5", "e8"]
    assert ids((2, "active", 4), (3, "failed", 5)) == ["e5", "e8", "e9"]
    assert ids((3, "failed", 5)) == ["e3", "e4", "e5", "e8", "e9"]


def test_upserts_take_all_other_generations(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/search_index.parquet").where("generation_id IN (4, 6)")
    rows.withColumn("generation_id", F.when(F.col("generation_id") == 6, 21).otherwise(40 + F.length("entity_id") % 2).cast("bigint")).write.parquet(f"{tmp_path}/search_index.parquet")
    spark.createDataFrame([(21, "active", 1), (40, "retired", 0), (41, "building", 2)], "id bigint, status string, source_high_watermark bigint").write.parquet(f"{tmp_path}/index_generations.parquet")
    want = rows.where("generation_id = 4").select("entity_type", "entity_id").distinct().count()
    assert want > 0 and index.QUERIES["rejected_writes"](spark, str(tmp_path)).count() == want
