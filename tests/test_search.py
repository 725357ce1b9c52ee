"""Search over small fixtures."""

import random
from datetime import datetime, timezone

import pytest

from skein.operators.scoring import _density
from skein.operators.search import search
from skein.operators.tags import tag_index, tag_page
from skein.operators.view import searchable
from skein.operators.writes import tombstone, upsert
from skein.plans.config import Config
from skein.plans.cursor import CursorError
from skein.plans.request import Clause, Filters, Range, Request

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)
SCHEMA = "entity_type string, entity_id string, title string, status string, category_id string, author_id string, tags array<string>, keywords array<string>, weight int, view_count int, like_count int, download_count int, payload string, created_at timestamp, updated_at timestamp, indexed_at timestamp, source_version bigint"


def row(id, title="", tags=(), status="active", payload="{}", views=0, day=1, kind="post", keywords=(), version=0):
    t = datetime(2025, 1, day)
    return (kind, id, title, status, None, None, None if tags is None else list(tags), list(keywords), 0, views, 0, 0, payload, t, t, t, version)


@pytest.fixture(scope="module")
def view(spark):
    rows = [
        row("1", "模组 guide", ["mod"]),
        row("2", "modern house", ["Foo_Bar"]),
        row("3", "mod useful pack", ["fooxbar"], payload='{"mcVersions":["1.8","1.21.5"]}'),
        row("4", "big mods", ["foo%bar"], payload='{"mcVersions":["1.20.4"],"platform":"Java"}', views=2_147_483_647),
        row("5", "hidden mod", status=" HIDDEN "),
        row("6", "gone mod", status="DELETED"),
        row("7", "mod", ["a"], kind="video"),
        row("8", None, None, None, None, keywords=[None]),
    ]
    return searchable(spark.createDataFrame(rows, SCHEMA)).cache()


def ids(view, **parts):
    config = parts.pop("config", Config())
    return {r.entity_id for r in search(view, Request(scoring_time=NOW, **parts), generation=1, config=config, with_facets=False).items.collect()}


def test_recall(view):
    assert ids(view, query="模组") == {"1", "3", "4", "7"}  # the title itself, mod, mods
    assert ids(view, query="整合包", config=Config(synonyms={"整合包": ["mod pack"]})) == {"3"}
    assert ids(view, query="house modern") == {"2"}
    assert ids(view) == {"1", "2", "3", "4", "7", "8"}
    assert ids(view, status="deleted") == {"6"} and ids(view, filters=Filters(statuses=("Hidden", "DELETED"))) == {"5", "6"}


def test_clauses(view):
    assert ids(view, must=(Clause("title", "useful pack", "phrase"),)) == {"3"} == ids(view, must=(Clause("_all", "pack", "phrase"),))
    assert ids(view, must=(Clause("title", "pack useful", "phrase"),)) == set()
    assert ids(view, must=(Clause("title", "mo ho", "prefix"),)) == {"2"}
    assert ids(view, must=(Clause("title", "modern hous", "fuzzy"),)) == {"2"}
    assert ids(view, must=(Clause("title", "mod"),), should=(Clause("title", "pack"), Clause("title", "big"))) == {"3", "4"}
    assert ids(view, must_not=(Clause("_all", "mod"),)) == {"2", "8"}


def test_filters(view):
    assert ids(view, filters=Filters(version=Range(gte="1.20", lte="1.21"))) == {"4"}
    assert ids(view, filters=Filters(platforms=("JAVA",))) == {"4"}
    assert ids(view, tags=("foo_bar",)) == {"2"} and ids(view, filters=Filters(tags_any=("MOD", "a"))) == {"1", "7"}
    assert ids(view, filters=Filters(view_count=Range(gt=5))) == {"4"} and ids(view, entity_type="video") == {"7"}


def test_pages_do_not_overlap_and_cover_all(view):
    seen, cursor = [], ""
    while True:
        page = search(view, Request(sort="popular", limit=2, cursor=cursor, scoring_time=NOW), generation=1, secret=b"s", with_facets=False)
        seen += [r.entity_id for r in page.items.collect()]
        assert page.total == 6
        if not page.next:
            break
        cursor = page.next
    assert len(seen) == len(set(seen)) == 6 and seen[0] == "4"
    with pytest.raises(CursorError):
        search(view, Request(sort="popular", query="mod", cursor=page.next or cursor), generation=1, secret=b"s")


def test_facets_highlight_and_literal_boost(view):
    page = search(view, Request(query="mod", highlight=True, scoring_time=NOW), generation=1)
    assert {r.value: r.n for r in page.facets["entity"].collect()} == {"post": 3, "video": 1}
    marked = {r.entity_id: r.hl_title for r in page.items.collect()}
    assert marked["3"] == "<mark>mod</mark> useful pack" and marked["4"] == "big <mark>mods</mark>" and marked["1"] == "<mark>模组</mark> guide"


def test_tags(view):
    t = tag_index(view)
    assert {r.tag: r.total_count for r in t.collect()} == {"mod": 1, "foo_bar": 1, "fooxbar": 1, "foo%bar": 1, "a": 1}
    for q in ("foo_bar", "foo%bar", "FOOXBAR"):
        assert [r.tag for r in tag_page(t, q).collect()] == [q.lower()]
    assert tag_page(t, "foo\\bar").count() == 0 and tag_index(view, []).count() == 0


def test_version_gate(spark):
    cur = spark.createDataFrame([row("1", "v10", ["t"], version=10), row("2", "v0", version=0)], SCHEMA)
    new = spark.createDataFrame([row(" 1 ", "v9", version=9), row("2", "v3", version=3), row("3", "new", version=1), row("3", "newer", version=2)], SCHEMA)
    state, report = upsert(cur, new, NOW)
    assert {r.entity_id: (r.title, r.source_version) for r in state.collect()} == {"1": ("v10", 10), "2": ("v3", 3), "3": ("newer", 2)}
    assert {r.entity_id: r.applied for r in report.collect()} == {"1": False, "2": True, "3": True}
    state, report = upsert(cur, new, NOW, versioned=False)
    assert {r.entity_id: r.source_version for r in state.collect()} == {"1": 10, "2": 0, "3": 0} and {r.entity_id: r.applied for r in report.collect()} == {"1": False, "2": True, "3": True}
    keys = spark.createDataFrame([("post", "1", 10, "bye"), ("post", "9", 4, None), ("post", "2", None, "x")], "entity_type string, entity_id string, source_version bigint, reason string")
    state, report = tombstone(cur, keys, NOW)
    got = {r.entity_id: r for r in state.collect()}
    assert (got["1"].status, got["1"].title, got["1"].tags, got["1"].payload) == ("deleted", "v10", ["t"], '{"reason":"bye"}')
    assert (got["9"].status, got["9"].tags, got["9"].source_version) == ("deleted", [], 4)
    assert not tombstone(cur, keys.where("entity_id = '1'"), NOW, versioned=False)[1].first().applied
    empty = upsert(cur.limit(0), new.limit(0), NOW)
    assert empty[0].count() == empty[1].count() == 0
    with pytest.raises(Exception):
        upsert(cur, spark.createDataFrame([row(" ", "no id")], SCHEMA), NOW)[0].collect()


def test_postings_agree_with_the_scan(view, spark, tmp_path):
    from skein.operators.postings import candidates, matched_by_postings, save_postings
    from skein.operators.predicates import matches

    save_postings(view, f"file://{tmp_path}/p")
    p = spark.read.parquet(f"file://{tmp_path}/p")
    for groups in ([[["mod"]]], [[["mod"], ["mods"], ["模", "组"]]], [[["mod"]], [["pack"], ["big", "mods"]]], [[["nothing"]]]):
        for field in ("_all", "title", "tags"):
            want = {r.entity_id for r in view.where(matches(groups, field)).collect()}
            assert {r.entity_id for r in matched_by_postings(view, p, groups, field).collect()} == want
    with pytest.raises(ValueError):
        candidates(p, [])


def test_density_against_all_stretches(spark):
    rng, groups, weights = random.Random(1), [["a", "x'"], ["b"], ["c", "a"]], {"tok_a": 0.5, "tok_b": 0.3, "tok_c": 0.2, "tok_d": 0.0}
    rows = [[[rng.choice(["a", "b", "c", "x'", "d", "e"]) for _ in range(rng.randrange(8))] for _ in weights] for _ in range(120)]

    def worth(parts):
        told = [(w, [i for i, g in enumerate(groups) if t in g]) for tokens, w in zip(parts, weights.values()) for t in tokens]
        holds = lambda a, z: {g for _, gs in told[a : z + 1] for g in gs} == {0, 1, 2}
        total = 0.0
        for a in range(len(told)):
            for z in range(a, len(told)):
                if holds(a, z) and (a == z or not holds(a + 1, z) and not holds(a, z - 1)):
                    inside = [w for w, gs in told[a : z + 1] if gs]
                    total += len(inside) / sum(1 / w for w in inside) / (1 + z - a + 1 - len(inside)) if min(inside) > 0 else 0.0
        return total

    df = spark.createDataFrame(rows, ", ".join(f"{c} array<string>" for c in weights))
    got = [r.d for r in df.select(_density(groups, weights).alias("d")).collect()]
    assert got == pytest.approx([worth(r) for r in rows]) and sum(1 for x in got if x) > 50
