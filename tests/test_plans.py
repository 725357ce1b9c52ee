"""Shapes of physical plans that matter at scale."""

import contextlib
import io
from pathlib import Path

import pytest

from skein.operators import search
from skein.operators.current import current_rows, listed_rows
from skein.plans.config import Config
from skein.plans.request import Clause, Filters, Request, checked
from skein.plans.textquery import parse
from skein.queries import feed, index
from skein.queries.search import view
from skein.session import load

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_generation_and_columns_reach_the_scan(spark):
    p = plan(listed_rows(load(spark, FOLDER, "search_index"), 6, ["tags"]))
    assert "EqualTo(generation_id,6)" in p and "payload" not in p and p.count("Exchange") == 2  # in the tree and in the details
    p = plan(current_rows(load(spark, FOLDER, "search_index").where("entity_type = 'post'"), 6, ["title"]))
    assert "EqualTo(entity_type,post)" in p


def test_a_request_reads_what_it_needs(spark):
    r = checked(Request(must=(Clause("title", "forge"),), filters=Filters(entity_types=("post",))))
    assert search.needed_columns(r) == ["status", "title"]
    p = plan(search.matched(view(spark, FOLDER, *search.needed_columns(r)), r, parse("", {}), Config()).select("entity_id"))
    assert "payload" not in p and "ArrowEvalPython" not in p and "EqualTo(entity_type,post)" in p


def test_top_k_is_not_a_sort_and_only_scores_python_where_needed(spark):
    from skein.queries.search import NOW

    r = checked(Request(sort="popular"))
    rows, _ = search.ranked(view(spark, FOLDER, "status", "weight", "view_count", "like_count", "download_count", "created_at", "updated_at", "indexed_at", "title", "tags", "keywords", "payload"), r, Config(), NOW)
    p = plan(rows.orderBy(*search.order("popular")).limit(21).select("entity_id", "score"))
    assert "TakeOrderedAndProject" in p and "ArrowEvalPython" not in p


@pytest.mark.parametrize("name", ["p2_state", "p3_found"])
def test_feed_has_no_nested_loops(spark, name):
    p = plan(feed.QUERIES[name](spark, FOLDER))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_changes_take_one_shuffle_and_no_join(spark):
    p = plan(feed.p2_state(spark, FOLDER)).split("\n\n")[0]
    assert p.count("Exchange") == 1 and "Join" not in p


def test_existence_passes_the_barrier_in_the_plan(spark):
    p = plan(feed.p2_found(spark, FOLDER))
    assert p.split("\n\n")[0].count("Exchange") == 1 and "_written" in p and "_wall" in p and "Join" not in p


def test_a_search_over_a_snapshot_shuffles_nothing_and_runs_no_python(spark):
    from skein.queries.search import QUERIES

    for name in ("snapshot_match", "snapshot_relevance"):
        p = plan(QUERIES[name](spark, FOLDER))
        assert "Exchange" not in p and "Python" not in p and "Arrow" not in p


@pytest.mark.parametrize("name", ["source_resource", "category_id_or_slug", "official_tags_agg", "versioned_upsert", "tombstone", "source_versions"])
def test_joins_are_equi_joins(spark, name):
    p = plan(index.QUERIES[name](spark, FOLDER))
    assert "NestedLoop" not in p and "Cartesian" not in p and "Join" in p
