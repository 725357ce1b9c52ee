"""Settings that are fixed at the start of a program, from its environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace
from math import isfinite

from skein.plans.config import SCORING, Config

#: Name, default, least, most.
NUMBERS = (
    ("request_timeout_ms", 5_000, 100, 120_000),
    ("cache_entries", 2_048, 128, 100_000),
    ("worker_batch_size", 200, 1, 500),
    ("worker_poll_interval_ms", 2_000, 100, 60_000),
    ("worker_lock_ttl_ms", 120_000, 1_000, 3_600_000),
    ("worker_retry_delay_ms", 30_000, 100, 3_600_000),
    ("worker_max_attempts", 10, 1, 100),
)


@dataclass(frozen=True)
class Settings:
    request_timeout_ms: int = 5_000
    cache_entries: int = 2_048
    worker_batch_size: int = 200
    worker_poll_interval_ms: int = 2_000
    worker_lock_ttl_ms: int = 120_000
    worker_retry_delay_ms: int = 30_000
    worker_max_attempts: int = 10
    worker_enabled: bool = True
    cursor_secret: str = ""
    config: Config = Config()


def _number(raw: str | None, kind: type, default, least, most):
    """The number of a text within its range; the default where it is none."""
    try:
        x = kind((raw or "").strip())
    except ValueError:
        return default
    return min(max(x, least), most) if isfinite(x) else default


def from_environment(env: Mapping[str, str] = os.environ, prefix: str = "SKEIN_") -> Settings:
    """Settings of the variables ``prefix`` + NAME: numbers within their ranges, what is no number as if it were unset;
    booleans are 1, true, yes, on and 0, false, no, off in any case; weights of the scoring where they are set."""
    get = lambda name: env.get(prefix + name.upper())
    found = {name: _number(get(name), int, *rest) for name, *rest in NUMBERS}
    said = (get("worker_enabled") or "").strip().lower()
    found["worker_enabled"] = said not in ("0", "false", "no", "off")
    found["cursor_secret"] = (get("cursor_secret") or "").strip()
    base = Config()
    weights = {name: float(_number(raw, float, *rest)) for name, *rest in SCORING if (raw := get(f"scoring_{name}")) is not None}
    return Settings(**found, config=replace(base, scoring=replace(base.scoring, **weights)).clamped())
