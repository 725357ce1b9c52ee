"""A search request, checked and completed on the driver before any data is touched."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime

from skein.plans.textquery import tokenize

#: Kinds of entities, fields of clauses, operators of clauses.
ENTITY_TYPES = ("resource", "post", "server", "video", "document", "user", "organization", "tag", "official_tag")
SORTS = ("relevance", "latest", "popular")
FIELDS = ("_all", "title", "tags", "keywords")
OPERATORS = ("match", "phrase", "prefix", "fuzzy")
#: Limits of a request.
MAX_CHARACTERS, MAX_TERMS, MAX_CLAUSES, MAX_MUST_NOT, MAX_FUZZY, MAX_VALUES, MAX_VALUES_ALL = 256, 24, 32, 8, 2, 50, 128
PAGE, MAX_PAGE = 20, 100


class QueryError(ValueError):
    """A request that cannot be answered; ``code`` says why."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


@dataclass(frozen=True)
class Clause:
    field: str
    value: str
    operator: str = ""


@dataclass(frozen=True)
class Range:
    gte: object = None
    gt: object = None
    lte: object = None
    lt: object = None

    def bounds(self) -> list[tuple[str, object]]:
        return [(op, v) for op, v in ((">=", self.gte), (">", self.gt), ("<=", self.lte), ("<", self.lt)) if v is not None and v != ""]


@dataclass(frozen=True)
class Filters:
    entity_types: tuple[str, ...] = ()
    category_ids: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    tags_any: tuple[str, ...] = ()
    tags_all: tuple[str, ...] = ()
    platforms: tuple[str, ...] = ()
    view_count: Range = Range()
    like_count: Range = Range()
    download_count: Range = Range()
    created_at: Range = Range()
    updated_at: Range = Range()
    version: Range = Range()


@dataclass(frozen=True)
class Request:
    query: str = ""
    sort: str = ""
    must: tuple[Clause, ...] = ()
    should: tuple[Clause, ...] = ()
    must_not: tuple[Clause, ...] = ()
    filters: Filters = field(default_factory=Filters)
    entity_type: str = ""
    category_id: str = ""
    status: str = ""
    tags: tuple[str, ...] = ()
    limit: int = 0
    cursor: str = ""
    explain: bool = False
    highlight: bool = False
    scoring_time: datetime | None = None


def version_key(raw: str) -> int | None:
    """major * 1,000,000 + minor * 1,000 + patch of a version of one to three parts of one to three digits, else None."""
    raw = raw.strip().removeprefix("v")
    if not re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){0,2}", raw):
        return None
    return sum(int(x) * m for x, m in zip(raw.split("."), (1_000_000, 1_000, 1)))


def page_size(limit: int) -> int:
    return PAGE if limit == 0 else min(max(limit, 1), MAX_PAGE)


def checked(r: Request) -> Request:
    """The request with defaults filled in and single-value fields moved into its filters; raises QueryError."""
    text = r.query.strip()
    if len(text) > MAX_CHARACTERS:
        raise QueryError("query_too_long")
    sort = r.sort.strip().lower() or ("relevance" if text else "latest")
    if sort not in SORTS:
        raise QueryError("invalid_sort")
    if sort == "relevance" and not text:
        raise QueryError("invalid_sort_for_query")
    words = tokenize(text)
    if len(set(words)) > MAX_TERMS:
        raise QueryError("query_term_limit_exceeded")
    if text and not words:
        raise QueryError("invalid_query_text")
    f = r.filters
    f = replace(
        f,
        entity_types=(*f.entity_types, *filter(None, [r.entity_type])),
        category_ids=(*f.category_ids, *filter(None, [r.category_id])),
        statuses=(*f.statuses, *filter(None, [r.status])),
        tags_all=(*f.tags_all, *r.tags),
    )
    _check_clauses(r)
    _check_filters(f)
    return replace(r, query=text, sort=sort, filters=f, entity_type="", category_id="", status="", tags=(), limit=page_size(r.limit))


def _check_clauses(r: Request) -> None:
    if len(r.must_not) > MAX_MUST_NOT:
        raise QueryError("must_not_limit_exceeded")
    every = [*r.must, *r.should, *r.must_not]
    for c in every:
        name, op, value = c.field.strip().lower(), c.operator.strip().lower() or "match", c.value.strip()
        if name not in FIELDS:
            raise QueryError("invalid_query_field")
        if op not in OPERATORS:
            raise QueryError("invalid_query_operator")
        if not value or not tokenize(value):
            raise QueryError("invalid_query_clause")
        if op == "prefix" and len(value) < 2:
            raise QueryError("prefix_too_short")
        if op == "fuzzy" and len(value) < 3:
            raise QueryError("fuzzy_too_short")
    if len(every) > MAX_CLAUSES:
        raise QueryError("query_clause_limit_exceeded")
    if sum(c.operator.strip().lower() == "fuzzy" for c in every) > MAX_FUZZY:
        raise QueryError("fuzzy_limit_exceeded")


def _check_filters(f: Filters) -> None:
    lists = (f.entity_types, f.category_ids, f.statuses, f.tags_any, f.tags_all, f.platforms)
    if any(len(x) > MAX_VALUES for x in lists) or sum(map(len, lists)) > MAX_VALUES_ALL:
        raise QueryError("filter_value_limit_exceeded")
    if any(version_key(str(v)) is None for _, v in f.version.bounds()):
        raise QueryError("invalid_minecraft_version")
