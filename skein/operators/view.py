"""The searchable form of index rows: normal lists and the token columns that queries touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.terms import folded
from skein.functions.text import flatten_payload, sorted_strings, tokens, version_keys
from skein.operators.current import current_rows

STORED = ["title", "status", "category_id", "author_id", "tags", "keywords", "weight", "view_count", "like_count", "download_count", "payload", "created_at", "updated_at", "indexed_at", "source_version"]


def searchable(rows: DataFrame, index_text: Column | None = None) -> DataFrame:
    """Rows with normal status, tags and keywords and, per field, tokens in order: tok_a title, tok_b tags, tok_c keywords,
    tok_d payload (and a private text, that is searched through tok_d and is in no other column).

    A blank status is active. platform, version_keys and sort_time are derived here so that filters stay plain comparisons.
    Columns that a query does not use are pruned away with the work behind them; what would derive from a column that
    ``rows`` lacks is left out.
    """
    have = set(rows.columns)
    base = {
        "status": lambda: F.when(F.length(folded("status")) > 0, folded("status")).otherwise("active"),
        "tags": lambda: sorted_strings("tags"),
        "keywords": lambda: sorted_strings("keywords"),
    }
    cols = {c: f() for c, f in base.items() if c in have}
    if "payload" in have:
        cols["payload_text"] = flatten_payload("payload")
    derived = {
        "tok_a": (["title"], lambda: tokens("title")),
        "tok_b": (["tags"], lambda: tokens(F.array_join("tags", " "))),
        "tok_c": (["keywords"], lambda: tokens(F.array_join("keywords", " "))),
        "tok_d": (["payload"], lambda: tokens("payload_text") if index_text is None else tokens(F.concat_ws(" ", "payload_text", index_text))),
        "platform": (["payload"], lambda: F.lower(F.coalesce(F.get_json_object("payload", "$.platform"), F.lit("")))),
        "version_keys": (["payload"], lambda: version_keys("payload")),
        "sort_time": (["updated_at", "created_at", "indexed_at"], lambda: F.coalesce("updated_at", "created_at", "indexed_at")),
    }
    out = rows.withColumns(cols) if cols else rows
    more = {c: f() for c, (need, f) in derived.items() if have.issuperset(need)}
    return out.withColumns(more) if more else out


def open_view(index: DataFrame, generation: int | None, columns: Sequence[str] | None = None) -> DataFrame:
    """The current rows of a generation in searchable form, with what derives from ``columns`` (stored ones; None: all).

    Finding the current row of a key folds whole rows, so columns must be named here to be left out of the scan
    (search.needed_columns names those of a request); a snapshot of operators.catalog has one row per key and prunes by itself.
    """
    keep = [c for c in STORED if columns is None or c in columns]
    return searchable(current_rows(index, generation, keep))
