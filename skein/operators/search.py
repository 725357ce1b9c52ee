"""Search over one generation: total, facets, a page of results and the cursor to the next."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import predicates, scoring
from skein.operators.highlight import highlighted
from skein.plans import cursor as cursors
from skein.plans.config import Config
from skein.plans.request import Request, checked
from skein.plans.textquery import TextQuery, parse, tokenize
from skein.session import materialize

#: Buckets of a facet.
BUCKETS = 20
RESULT = ["entity_type", "entity_id", "title", "status", "category_id", "author_id", "tags", "keywords", "weight", "view_count", "like_count", "download_count", "payload", "created_at", "updated_at", "source_version"]


def matched(view: DataFrame, r: Request, q: TextQuery, c: Config) -> DataFrame:
    """Rows of the view that answer a checked request, whatever the page."""
    test = predicates.filters(r.filters)
    if q.groups:
        test = test & predicates.matches(q.groups)
    if r.must or r.should or r.must_not:
        test = test & predicates.clauses(r.must, r.should, r.must_not, c.synonyms)
    return view.where(test)


def needed_columns(r: Request) -> list[str]:
    """The stored columns that decide whether a row answers a checked request."""
    need = {"status"}
    fields = {c.field.strip().lower() for c in (*r.must, *r.should, *r.must_not)} | ({"_all"} if r.query else set())
    need |= (fields - {"_all"}) | ({"title", "tags", "keywords", "payload"} if "_all" in fields else set())
    f = r.filters
    need |= {c for c, v in (("category_id", f.category_ids), ("tags", f.tags_any or f.tags_all), ("payload", f.platforms or f.version.bounds())) if v}
    need |= {c for c in ("view_count", "like_count", "download_count", "created_at", "updated_at") if getattr(f, c).bounds()}
    return sorted(need)


def order(sort: str) -> list[Column]:
    """A total order: score and time descending, then type and id in binary order."""
    by = [F.desc("sort_time"), F.asc("entity_type"), F.asc("entity_id")]
    return by if sort == "latest" else [F.desc("score"), *by]


def after(sort: str, score: float, time: datetime, entity_type: str, entity_id: str) -> Column:
    """Rows that come behind the given place of the order."""
    later = (F.col("entity_type") > entity_type) | ((F.col("entity_type") == entity_type) & (F.col("entity_id") > entity_id))
    t = F.lit(time).cast("timestamp")
    later = (F.col("sort_time") < t) | ((F.col("sort_time") == t) & later)
    return later if sort == "latest" else (F.col("score") < score) | ((F.col("score") == score) & later)


def facet(rows: DataFrame, value: str | Column, buckets: int = BUCKETS) -> DataFrame:
    """(value, n): the most frequent values, ties by value; null is no value."""
    v = (F.col(value) if isinstance(value, str) else value).alias("value")
    return rows.select(v).where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(buckets)


def totals(rows: DataFrame) -> DataFrame:
    """(kind, value, n): rows in all, per entity type, category and tag, in one scan and one shuffle of partial counts."""
    one = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    own = F.array(one("total", F.lit("")), one("entity", F.col("entity_type")), one("category", F.col("category_id")))
    cells = F.explode(F.concat(own, F.transform("tags", lambda t: one("tag", t)))).alias("c")
    return rows.select(cells).where("c.value IS NOT NULL").groupBy("c.kind", "c.value").agg(F.count("*").alias("n"))


def facets(counts: DataFrame, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """The facets of ``totals``: most frequent values first."""
    top = lambda k: counts.where(F.col("kind") == k).orderBy(F.desc("n"), F.asc("value")).limit(buckets).select("value", "n")
    return {k: top(k) for k in ("entity", "category", "tag")}


@dataclass
class Page:
    """items in order; total counts all matches; facets of all matches; next is the cursor behind the last item."""

    items: DataFrame
    total: int
    facets: dict[str, DataFrame]
    next: str | None


def ranked(view: DataFrame, r: Request, c: Config, now: datetime) -> tuple[DataFrame, TextQuery]:
    """All matches with score, matched fields (and parts of the score if asked) - not yet ordered or cut."""
    q = parse(r.query, c.synonyms)
    rows = matched(view, r, q, c)
    more = [t for x in (*r.must, *r.should) for t in tokenize(x.value)]
    cols = {"score": F.round(scoring.score(r.sort, q, c.scoring, now), 9), "matched": scoring.matched_fields(q, more)}
    if r.explain and r.sort != "latest":
        cols |= {"text_score": scoring.text_rank(q, c.scoring) + scoring.boost(q), "popularity_score": scoring.popularity(c.scoring), "freshness_score": scoring.freshness(now, c.scoring.time_decay_factor)}
    return rows.withColumns(cols), q


def search(view: DataFrame, request: Request, *, generation: int, config: Config = Config(), secret: bytes = b"", with_facets: bool = True) -> Page:
    """Answers a request over one immutable generation, so count, items and facets agree.

    Plan: two scans with one boolean column (status, type, times and counters can be pushed down). One counts the total and
    all facets together; the other scores the matches and takes limit + 1 rows (TakeOrderedAndProject), which are all that
    reaches the driver; the page is a local relation, so that snippets are made of its rows only. It holds RESULT, scores and
    snippets: neither tokens nor flattened texts of a row are returned. ``with_facets`` False:
    only the total is counted. Raises QueryError and CursorError.
    """
    r = checked(request)
    now = r.scoring_time or datetime.now(timezone.utc)
    digest = cursors.query_digest(replace(r, scoring_time=None))
    place = None
    if r.cursor:
        place = cursors.bind(cursors.decode(r.cursor, secret), sort=r.sort, generation=generation, config=config.digest(), query=digest)
        now = datetime.fromisoformat(place.scoring_time)
    rows, q = ranked(view, r, config, now)
    behind = rows if place is None else rows.where(after(r.sort, place.score, datetime.fromisoformat(place.sort_time), place.entity_type, place.entity_id))
    keep = [*RESULT, *[x for x in rows.columns if x in ("score", "matched", "text_score", "popularity_score", "freshness_score")], "sort_time", "payload_text"]
    top = behind.select(*keep).orderBy(*order(r.sort)).limit(r.limit + 1)
    ends = top.collect()
    items = view.sparkSession.createDataFrame(ends[: r.limit], top.schema)
    if r.highlight:
        more = [t for x in (*r.must, *r.should) for t in tokenize(x.value)]
        items = highlighted(items, list(dict.fromkeys([*q.expanded, *more])))
    items = items.drop("payload_text", "sort_time")
    found = matched(view, r, q, config)
    if with_facets:
        counts = materialize(totals(found), "facets")
        whole = counts.where("kind = 'total'").first()
        total, buckets = (whole.n if whole else 0), facets(counts)
    else:
        total, buckets = found.count(), {}
    last = ends[r.limit - 1] if len(ends) > r.limit else None
    cursor = last and cursors.encode(
        cursors.Cursor(r.sort, last.score, last.sort_time.replace(tzinfo=timezone.utc).isoformat(), last.entity_type, last.entity_id, generation, config.digest(), digest, now.isoformat()), secret
    )
    return Page(items, total, buckets, cursor)


def by_category_or_slug(rows: DataFrame, categories: DataFrame, ref: str = "category", columns: Sequence[str] = ("name",)) -> DataFrame:
    """Left join on a category's id or slug; the id wins, of several slugs the lowest id. Two equi joins instead of one on OR."""
    named = lambda k: categories.select(F.col(k).alias(f"_{k}"), F.struct("id", *columns).alias(f"_by_{k}"))
    slugs = named("slug").groupBy("_slug").agg(F.min("_by_slug").alias("_by_slug"))
    both = rows.join(named("id"), rows[ref] == F.col("_id"), "left").join(slugs, rows[ref] == F.col("_slug"), "left")
    return both.select(*rows.columns, F.coalesce("_by_id", "_by_slug").alias("category_row"))
