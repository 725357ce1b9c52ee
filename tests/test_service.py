"""The object that a front end calls."""

import pytest
from pyspark.sql import functions as F

from skein.operators.catalog import IndexUnavailable
from skein.operators.documents import build_documents
from skein.plans.config import Config
from skein.plans.cursor import CursorError
from skein.plans.request import Filters, QueryError, Request
from skein.service import SearchService
from test_stream import NOW, feed_rows, source_rows


def test_service(spark, tmp_path):
    posts = {"1": "First mod", "2": "Second mod", "3": "Third"}
    feed = [("a", "1", "update", 4)]
    s = SearchService(spark, f"file://{tmp_path}", lambda: source_rows(spark, posts), lambda: feed_rows(spark, *feed), secret=b"s", clock=lambda: NOW, buckets=2)
    with pytest.raises(IndexUnavailable):
        s.search(Request(query="mod"))
    id = s.rebuild()
    ids = lambda p: [r.entity_id for r in p.items.collect()]
    page = s.search(Request(query="first", limit=1))
    assert ids(page) == ["1"] and page.total == 1 and set(s.timing) == {"open_ms", "search_ms"}
    pages = s.search(Request(sort="popular", limit=1))
    assert pages.total == 3 and ids(s.search(Request(sort="popular", limit=1, cursor=pages.next))) != ids(pages)
    s.configure(Config(synonyms={"first": ["third"]}))
    with pytest.raises(CursorError):
        s.search(Request(sort="popular", limit=1, cursor=pages.next))
    assert sorted(ids(s.search(Request(query="first")))) == ["1", "3"]
    with pytest.raises(QueryError):
        s.search(Request(query="???"))
    new = build_documents(source_rows(spark, {"9": "Ninth"})).withColumn("source_version", F.lit(8).cast("bigint"))
    assert s.upsert(new).first().applied and ids(s.search(Request(query="ninth"))) == ["9"]
    assert not s.upsert(new.withColumn("source_version", F.lit(7).cast("bigint"))).first().applied
    gone = spark.createDataFrame([("post", " 9\t", 9, "spam")], "entity_type string, entity_id string, source_version bigint, reason string")
    assert s.delete(gone).first().applied and s.search(Request(query="ninth")).total == 0
    assert s.search(Request(query="ninth", filters=Filters(statuses=("deleted",)))).total == 1
    posts["1"] = "Changed"
    feed.append(("b", "1", "update", 6))
    assert s.rebuild_entity("post", "1").first().applied and ids(s.search(Request(query="changed"))) == ["1"]
    assert {r.tag: r.total_count for r in s.tags().collect()} == {"mod": 3}
    told = s.status()
    assert (told["generation"], told["documents"], told["by_type"]) == (id, 4, {"post": 4}) and told["lag_seconds"] > 0 and told["jobs"]["failed"] == 0
    assert s.catalog.active()["documents"] == s.catalog.rows().count()
