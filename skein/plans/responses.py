"""JSON in and out: answers, errors, documents to be written, lists in one string."""

from __future__ import annotations

import json
from collections.abc import Iterable

from skein.plans.request import ENTITY_TYPES, QueryError

#: Longest document body, in bytes.
LONGEST = 64 * 1024


def list_values(*raw: str | Iterable[str]) -> list[str]:
    """Values given one by one or with commas between them; blank ones dropped."""
    flat = [x for r in raw for x in ([r] if isinstance(r, str) else r)]
    return [v for x in flat for v in (p.strip() for p in x.split(",")) if v]


def answer(page) -> str:
    """A search page as one JSON object."""
    items = [json.loads(x) for x in page.items.toJSON().collect()]  # at most a hundred rows
    for i in items:
        i |= {"category_id": i.get("category_id") or "", "author_id": i.get("author_id") or ""}
    facets = {k: [{"value": r.value, "count": r.n} for r in f.collect()] for k, f in page.facets.items()}  # at most 20 rows each
    return json.dumps({"items": items, "total": page.total, "facets": facets, "next_cursor": page.next}, ensure_ascii=False)


def failure(e: Exception) -> str:
    """An error as one JSON object."""
    return json.dumps({"error": {"code": getattr(e, "code", "internal_error"), "message": str(e)}}, ensure_ascii=False)


def document(body: bytes) -> dict:
    """One JSON object to be written: at most LONGEST bytes, nothing behind it, a known entity type (or none: document)."""
    if len(body) > LONGEST:
        raise QueryError("body_too_large")
    try:
        doc = json.loads(body)
    except ValueError as e:
        raise QueryError("invalid_json") from e
    if not isinstance(doc, dict):
        raise QueryError("invalid_json")
    kind = str(doc.get("entity_type") or "").strip().lower() or "document"
    if kind not in ENTITY_TYPES:
        raise QueryError("invalid_entity_type")
    if not str(doc.get("entity_id") or doc.get("doc_id") or "").strip():
        raise QueryError("missing_entity_id")
    if int(doc.get("source_version") or 0) < 0:
        raise QueryError("negative_source_version")
    return doc | {"entity_type": kind}
