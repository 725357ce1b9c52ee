"""Signed cursors: where a page ended, and for which search."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import asdict, dataclass

from skein.plans.request import Request


class CursorError(ValueError):
    """The cursor is damaged, forged or of another search."""


@dataclass(frozen=True)
class Cursor:
    sort: str
    score: float
    sort_time: str
    entity_type: str
    entity_id: str
    generation: int
    config: str
    query: str
    scoring_time: str


def query_digest(r: Request) -> str:
    """Names the search a cursor belongs to; the place in it and the page size do not count."""
    d = asdict(r) | {"cursor": "", "limit": 0, "explain": False, "highlight": False, "scoring_time": None}
    return hashlib.sha256(json.dumps(d, sort_keys=True, default=str, ensure_ascii=False).encode()).hexdigest()


def _b64(b: bytes) -> str:
    return base64.urlsafe_b64encode(b).rstrip(b"=").decode()


def _raw(s: str) -> bytes:
    return base64.urlsafe_b64decode(s + "=" * (-len(s) % 4))


def encode(c: Cursor, secret: bytes) -> str:
    body = json.dumps(asdict(c), sort_keys=True).encode()
    return f"{_b64(body)}.{_b64(hmac.new(secret, body, hashlib.sha256).digest())}"


def decode(text: str, secret: bytes) -> Cursor:
    try:
        body, sign = map(_raw, text.split("."))
        if not hmac.compare_digest(sign, hmac.new(secret, body, hashlib.sha256).digest()):
            raise CursorError("wrong signature")
        return Cursor(**json.loads(body))
    except CursorError:
        raise
    except (ValueError, TypeError) as e:
        raise CursorError("unreadable cursor") from e


def bind(c: Cursor, *, sort: str, generation: int, config: str, query: str) -> Cursor:
    """The cursor, if it belongs to this search over this generation with these settings."""
    if (c.sort, c.generation, c.config, c.query) != (sort, generation, config, query):
        raise CursorError("cursor does not match this search")
    return c
