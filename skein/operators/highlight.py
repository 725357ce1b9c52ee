"""Marked snippets of the rows of one page."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest snippet, in characters, by field.
TITLE, LIST_ITEM, PAYLOAD = 160, 80, 220


def lowered(text: str) -> str:
    """Lower case, character by character, so that places in it are places in the text."""
    return "".join(x if len(x := c.lower()) == 1 else x[0] for c in text)


def snippet(text: str, terms: list[str], longest: int) -> str:
    """HTML of the text with every term marked; a long text is cut to a window that begins a third before the first hit."""
    text = text.strip()
    low, spans = lowered(text), []
    for term in {t.lower() for t in terms if t}:
        spans += [(m.start(), m.start() + len(term)) for m in re.finditer(f"(?={re.escape(term)})", low)]
    merged: list[list[int]] = []
    for a, z in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(z, merged[-1][1])
        else:
            merged.append([a, z])
    lo, hi = 0, len(text)
    if hi > longest:
        lo = min(max(0, (merged[0][0] if merged else 0) - longest // 3), hi - longest)
        hi = lo + longest
    out, at = ["..."] if lo else [], lo
    for a, z in merged:
        a, z = max(a, lo), min(z, hi)
        if a < z:
            out += [html.escape(text[at:a]), "<mark>", html.escape(text[a:z]), "</mark>"]
            at = z
    return "".join([*out, html.escape(text[at:hi]), "..." if hi < len(text) else ""])


def highlighted(page: DataFrame, terms: list[str]) -> DataFrame:
    """Adds hl_title, hl_tags, hl_keywords, hl_payload to a page (at most a hundred rows); null where nothing is marked."""
    any_in = lambda s: bool(s) and any(t in s.lower() for t in terms if t)

    @F.pandas_udf("hl_title string, hl_tags array<string>, hl_keywords array<string>, hl_payload string")
    def mark(title: pd.Series, tags: pd.Series, keywords: pd.Series, payload: pd.Series) -> pd.DataFrame:
        one = lambda s, n: snippet(s, terms, n) if any_in(s) else None
        many = lambda xs: [snippet(x, terms, LIST_ITEM) for x in xs if any_in(x)] or None
        return pd.DataFrame({"hl_title": title.map(lambda s: one(s, TITLE)), "hl_tags": tags.map(many), "hl_keywords": keywords.map(many), "hl_payload": payload.map(lambda s: one(s, PAYLOAD))})

    return page.withColumn("_hl", mark("title", "tags", "keywords", "payload_text")).select(*page.columns, "_hl.*")
