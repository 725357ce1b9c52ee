"""Changes, intervals and increments against brute force and odd inputs."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.operators import incremental
from skein.operators.changes import apply_changes
from skein.operators.current import active_generation, current_rows, listed_rows
from skein.operators.incremental import IncrementalJob, pending_events
from skein.operators.intervals import _pieces, merge_intervals, points_in, subtract_intervals, to_intervals
from skein.operators.skew import lookup_join, running_total

BASE = "entity_type string, entity_id string, status string, source_version bigint, indexed_at timestamp, title string, color string"
FEED = "entity_type string, entity_id string, action string, event_order bigint, created_at timestamp, id string, updated_at timestamp, title string, color string, extra string"


def t(n):
    return datetime(2025, 1, 1, 0, 0, n)


def state(spark, base, feed):
    fields = {c: (F.col(c), F.col(c)) for c in ("title", "color")}
    df = apply_changes(spark.createDataFrame(base, BASE), spark.createDataFrame(feed, FEED), fields)
    return {(r.entity_type, r.entity_id): (r.source_version, r.title, r.color) for r in df.collect()}


def test_changes_by_column(spark):
    base = [("post", "1", "active", 5, t(1), "old", "red"), ("post", "1", "active", 4, t(9), "older", "x"), ("post", "gone", " DELETED ", 5, t(1), "g", None), ("post", "h", "Hidden", None, None, None, None)]
    feed = [
        (" post", "1\t", "Update ", 6, t(3), "a", t(3), None, "blue", "clash"),  # keeps the title
        ("post", "1", "update", 4, t(4), "b", t(4), "too old", None, None),
        ("post", "1", "update", 6, t(3), "a", t(3), None, "blue", "again"),
        ("post", "gone", "update", 4, t(3), "c", t(3), "x", None, None),  # older than the removed row
        ("post", "2", "insert", 1, t(1), "d", t(1), "two", "green", None),
        ("post", "2", "delete", 2, t(2), "e", t(2), None, None, None),
        ("post", "2", "update", 3, t(3), "f", t(3), None, "white", None),  # nothing from before the removal
        ("post", "3", "insert", 1, t(1), "g", t(1), "three", None, None),
        ("post", "3", "DELETE", 1, t(2), "a", t(2), None, None, None),  # the later time wins
        ("post", "4", "delete", 1, t(1), "a", t(1), None, None, None),
        ("post", "4", None, 1, t(1), "b", t(1), "four", None, None),  # the greater id wins
        ("post", " ", "insert", 1, t(1), "h", t(1), "x", None, None),
        ("post", None, "insert", 1, t(1), "i", t(1), "x", None, None),
        ("post", "5", "insert", None, t(1), "j", t(1), "x", None, None),
        (None, "6", "insert", 1, None, None, None, None, None, None),
    ]
    want = {("post", "1"): (6, "old", "blue"), ("post", "h"): (0, None, None), ("post", "2"): (3, None, "white"), ("post", "4"): (1, "four", None), (None, "6"): (1, None, None)}
    assert state(spark, base, feed) == want
    random.Random(1).shuffle(feed)
    assert state(spark, base, feed + feed[:4]) == want
    assert state(spark, [], []) == {} and state(spark, base[:1], []) == {("post", "1"): (5, "old", "red")}


def test_changes_against_replay(spark):
    rng = random.Random(7)
    base = [("e", str(k), rng.choice(["active", "deleted"]), rng.randint(0, 9), t(0), f"b{k}", rng.choice([None, "c"])) for k in range(0, 40, 2)]
    feed = [("e", str(0 if rng.random() < 0.3 else rng.randrange(40)), rng.choice(["insert", "update", "delete"]), rng.randint(0, 20), t(rng.randrange(9)), f"i{n}", t(0), rng.choice([None, f"t{n}"]), rng.choice([None, f"c{n}"]), "") for n in range(400)]
    live = {("e", b[1]): [b[3], True, b[5], b[6]] if b[2] == "active" else [b[3], False, None, None] for b in base}
    for f in sorted(feed, key=lambda f: (f[3], f[4], f[5])):
        s = live.setdefault(("e", f[1]), [f[3], False, None, None])
        if f[3] < s[0]:
            continue
        if f[2] == "delete":
            s[:] = [f[3], False, None, None]
        elif f[2] == "insert":
            s[:] = [f[3], True, f[7], f[8]]
        else:
            s[:] = [f[3], True, f[7] or s[2], f[8] or s[3]]
    got = state(spark, base, feed)
    want = {k: (s[0], s[2], s[3]) for k, s in live.items() if s[1]}
    assert got == want


def points(iv):
    return {n for r in iv.collect() for n in range(r.lo, r.hi + 1)}


def test_intervals_against_sets(spark):
    rng, edge = random.Random(3), 1 << 16
    near = lambda: rng.choice([0, edge, 2 * edge, -edge]) + rng.randint(-12, 12)
    a, b = {near() for _ in range(90)}, {near() for _ in range(60)}
    df = lambda s: spark.createDataFrame([(x,) for x in s] * 2 + [(None,)], "n bigint")
    ia, ib = to_intervals(df(a), "n"), to_intervals(df(b), "n")
    assert points(ia) == a and points(merge_intervals(ia.unionByName(ib))) == a | b and points(subtract_intervals(ia, ib)) == a - b
    assert {r.n for r in points_in(df(a), "n", ib).collect()} == a & b
    rows = sorted((r.lo, r.hi) for r in merge_intervals(ia.unionByName(ib)).collect())
    assert all(y[0] > x[1] + 1 or y[0] == 0 for x, y in zip(rows, rows[1:]))  # cut at multiples of 2**32
    long = spark.createDataFrame([(5, 3 * edge), (3 * edge + 1, 3 * edge + 9), (7, 2), (None, 1)], "lo bigint, hi bigint")
    assert [(r.lo, r.hi) for r in merge_intervals(long).collect()] == [(5, 3 * edge + 9)]
    none = ia.limit(0)
    assert points(subtract_intervals(none, ib)) == set() and points(subtract_intervals(ia, none)) == a and merge_intervals(none).count() == 0


def test_pending(spark):
    rows = [("a", 5, None), ("b", 6, t(1)), ("b", 6, None), ("c", 6, None), ("d", 7, t(1)), ("e", 3, None), ("f", 9, None), ("f", 9, None), (None, 8, None), ("g", None, None), ("h", None, None), ("h", 10, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, event_order bigint, processed_at timestamp, attempts string")
    ids = lambda m: sorted(r.event_id for r in pending_events(df, m).collect())
    assert ids(4) == ["a", "c", "f", "h"] and ids(None) == ["a", "c", "e", "f", "h"] and ids(100) == []
    assert pending_events(df.limit(0), 0).count() == 0


def test_pending_events_depend_on_the_intervals(spark, monkeypatch):
    rows = [("a", 5, None), ("b", 6, t(1)), ("c", 6, None), ("d", 7, t(1)), ("e", 3, None), ("f", 9, None)]
    df = spark.createDataFrame(rows, "id string, event_order bigint, processed_at timestamp")
    ids = lambda: sorted(r.event_id for r in pending_events(df, 4).collect())
    assert ids() == ["a", "c", "f"]
    monkeypatch.setattr(incremental, "points_in", lambda points, seq, iv: points.select(seq).distinct().limit(0))
    assert ids() == ["a", "b", "c", "d", "f"]  # nothing is known to be processed
    monkeypatch.setattr(IncrementalJob, "settle", lambda self, upto: None)
    assert ids() == ["a", "b", "c", "d", "e", "f"]


def test_settled_numbers_are_never_read_again_and_changed_records_are(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "event_order bigint, id string, seen int")
    job = IncrementalJob(spark, f"file://{tmp_path}/job", watch=["seen"])
    take = lambda *r: (job.run(rows(*r), lambda d: d), sorted((x.event_order, x.id, x.seen) for x in job.output().collect()))[1]
    assert take((1, "a", 1), (2, "b", 1), (70_000, "c", 1)) == [(1, "a", 1), (2, "b", 1), (70_000, "c", 1)]
    job.run(rows((1, "a", 2), (2, "b", 1), (2, "b", None)), lambda d: d)
    assert sorted((x.event_order, x.id, str(x.seen)) for x in job.output().collect()) == [(1, "a", "1"), (1, "a", "2"), (2, "b", "1"), (2, "b", "None"), (70_000, "c", "1")]
    job.settle(2)
    assert job.settled() == 2 and [(r.lo, r.hi) for r in job.processed().collect()] == [(70_000, 70_000)]
    job.run(rows((1, "late", 1), (3, "d", 1)), lambda d: d)
    assert job.output().count() == 6 and job.settled() == 2
    job.settle(1)
    assert job.settled() == 2


def test_long_intervals_are_cut_in_steps(spark):
    iv = spark.createDataFrame([(5, 3 * (1 << 32) + 7)], "lo bigint, hi bigint")
    assert merge_intervals(iv.where("lo < 0")).count() == 0
    pieces = _pieces(iv)
    assert pieces.count() == 3 * (1 << 16) + 1 and pieces.selectExpr("sum(hi - lo + 1)").first()[0] == 3 * (1 << 32) + 3


def test_increments_survive_failures_and_late_rows(spark, tmp_path):
    job = IncrementalJob(spark, f"file://{tmp_path}/job")
    source = lambda *n: spark.createDataFrame([(x, f"v{x}") for x in n], "event_order bigint, v string")
    done = lambda: sorted(r.event_order for r in job.output().collect()) if job.output() else []
    job.run(source(1, 2, 5), lambda d: d)
    assert done() == [1, 2, 5]

    def broken(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        job.run(source(1, 2, 5, 6), broken)
    assert done() == [1, 2, 5]
    job.run(source(1, 2, 3, 5, 6), lambda d: d)  # 3 is late
    assert done() == [1, 2, 3, 5, 6] and sorted((r.lo, r.hi) for r in job.processed().collect()) == [(1, 3), (5, 6)]
    job.run(source(1, 2, 3, 5, 6), lambda d: d)
    assert done() == [1, 2, 3, 5, 6]
    with pytest.raises(Exception):
        job.log.append(2, {})  # two writers: the second loses


def test_increments_take_a_late_id_of_an_old_number(spark, tmp_path):
    job = IncrementalJob(spark, f"file://{tmp_path}/job")
    feed = [(1, "a", "x"), (1, "a", "x"), (2, "b", "x"), (None, "n", "x")]
    run = lambda *more: job.run(spark.createDataFrame([*feed, *more], "event_order bigint, id string, v string"), lambda d: d.select("event_order", "id").distinct())
    done = lambda: sorted((r.event_order, str(r.id)) for r in job.output().collect())
    run()
    run((1, "late", "x"), (1, "a", "seen again"), (4, "c", "x"))
    assert done() == [(1, "a"), (1, "late"), (2, "b"), (4, "c")]
    run((1, "late", "x"), (2, None, "x"), (4, "c", "x"))
    run((1, "late", "x"), (2, None, "x"), (4, "c", "x"))
    assert done() == [(1, "a"), (1, "late"), (2, "None"), (2, "b"), (4, "c")]
    assert sorted((r.lo, r.hi) for r in job.processed().collect()) == [(1, 2), (4, 4)]
    with pytest.raises(ValueError):
        job.run(spark.createDataFrame([(9,)], "event_order bigint"), lambda d: d)


def test_current_and_listed(spark):
    rows = [(1, "a", "1", 1, t(1), "x", " Hidden"), (1, "a", "1", 2, t(1), "y", None), (1, "a", "1", 2, t(1), "y", None), (1, "a", "1", 2, t(0), "z", "hidden"), (1, "b", "1", None, None, "n", "DELETED\t"), (2, "a", "9", 9, t(1), "w", "active")]
    df = spark.createDataFrame(rows, "generation_id bigint, entity_type string, entity_id string, source_version bigint, indexed_at timestamp, title string, status string")
    assert sorted(r.title for r in current_rows(df, 1, ["title"]).collect()) == ["n", "y"]
    assert [r.title for r in listed_rows(df, 1, ["title"]).collect()] == ["y"] and current_rows(df, None, ["title"]).count() == 0
    g = spark.createDataFrame([(1, "retired", 3), (2, " Active", None)], "id bigint, status string, source_high_watermark bigint")
    assert active_generation(g) == (2, 0) and active_generation(g.where("id = 1")) is None


def test_lookup_join_and_running_total(spark):
    keys = ["hot"] * 500 + [f"k{i}" for i in range(300)] + ["x" * 5000] * 40 + [None] * 20
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = lookup_join(rows, table, "k", "n", hot_rows=10)
    assert got.count() == 840 and got.where("k = 'hot'").first().n == 500 and got.select("i").distinct().count() == 840
    long = lookup_join(rows, table, "k", "n", hot_rows=30)  # the long key is hot too and goes as a digest
    assert long.count() == 840 and long.where("length(k) = 5000").count() == 40 and long.columns == got.columns
    assert lookup_join(rows, table.limit(0), "k", "n").count() == 0
    nums = spark.createDataFrame([(i % 7, i, i + 1) for i in range(200)], "a int, b int, v bigint")
    got = {(r.a, r.b): r.before for r in running_total(nums, ["a", "b"], "v", "before").collect()}
    at = 0
    for a, b in sorted(got):
        assert got[a, b] == at
        at += b + 1
    assert running_total(nums.limit(0), ["a", "b"], "v", "before").count() == 0
