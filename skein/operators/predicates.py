"""Filters and text clauses compiled to one boolean column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import any_of, similarity
from skein.plans.request import Clause, Filters, Range, version_key
from skein.plans.textquery import parse, tokenize

#: Least trigram similarity of a fuzzy match.
FUZZY = 0.35
_TOKENS = {"title": ("tok_a",), "tags": ("tok_b",), "keywords": ("tok_c",), "_all": ("tok_a", "tok_b", "tok_c", "tok_d")}


def _folded(values: Sequence[str]) -> list[str]:
    return sorted({v for v in (x.strip().lower() for x in values) if v})


def _both(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _either(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _compare(c: Column, op: str, v: object) -> Column:
    return {">=": c >= v, ">": c > v, "<=": c <= v, "<": c < v}[op]


def field_tokens(field: str) -> Column:
    """The tokens of a field; those of _all follow each other in the order title, tags, keywords, payload."""
    cols = _TOKENS[field]
    return F.col(cols[0]) if len(cols) == 1 else F.concat(*map(F.col, cols))


def field_text(field: str) -> Column:
    """The raw text of a field; that of _all ends in the payload as JSON text."""
    joined = {"title": F.coalesce("title", F.lit("")), "tags": F.array_join("tags", " "), "keywords": F.array_join("keywords", " ")}
    return joined[field] if field in joined else F.concat_ws(" ", *joined.values(), F.coalesce("payload", F.lit("")))


def matches(groups: Sequence[Sequence[Sequence[str]]], field: str = "_all") -> Column:
    """Every group has an alternative all of whose tokens occur in the field."""
    own = field_tokens(field)

    def group(alternatives: Sequence[Sequence[str]]) -> Column:
        single = [a[0] for a in alternatives if len(a) == 1]
        tests = [F.arrays_overlap(own, any_of(single))] if single else []
        return _either(tests + [_both([F.array_contains(own, t) for t in a]) for a in alternatives if len(a) > 1])

    return _both([group(g) for g in groups]) if groups else F.lit(True)


def phrase(tokens: Sequence[str], field: str = "_all") -> Column:
    """The tokens stand next to each other in this order."""
    line = F.concat(F.lit(" "), F.array_join(field_tokens(field), " "), F.lit(" "))
    return F.instr(line, f" {' '.join(tokens)} ") > 0


def prefix(tokens: Sequence[str], field: str = "_all") -> Column:
    """Each token begins some token of the field."""
    begins = lambda p: F.exists(field_tokens(field), lambda t: t.startswith(p))
    return _both([begins(p) for p in tokens])


def fuzzy(value: str, field: str = "_all") -> Column:
    """Trigram similarity of the raw field and the value is at least FUZZY."""
    return similarity(field_text(field), value) >= FUZZY


def clause(c: Clause, synonyms: Mapping[str, list[str]]) -> Column:
    field, op, value = c.field.strip().lower(), c.operator.strip().lower() or "match", c.value.strip()
    if op == "match":
        return matches(parse(value, synonyms).groups, field)
    if op == "phrase":
        return phrase(tokenize(value), field)
    if op == "prefix":
        return prefix(tokenize(value), field)
    return fuzzy(value, field)


def clauses(must: Sequence[Clause], should: Sequence[Clause], must_not: Sequence[Clause], synonyms: Mapping[str, list[str]]) -> Column:
    """All of must, at least one of should (if there is any, also beside must), none of must_not."""
    parts = [clause(c, synonyms) for c in must]
    if should:
        parts.append(_either([clause(c, synonyms) for c in should]))
    parts += [~clause(c, synonyms) for c in must_not]
    return _both(parts) if parts else F.lit(True)


def in_range(c: Column, r: Range) -> Column:
    """Within all bounds; null never is."""
    parts = [_compare(c, op, v) for op, v in r.bounds()]
    return _both(parts) if parts else F.lit(True)


def versions_in_range(r: Range) -> Column:
    """One version satisfies all bounds together."""
    bounds = [(op, version_key(str(v))) for op, v in r.bounds()]
    return F.exists("version_keys", lambda k: _both([_compare(k, op, v) for op, v in bounds])) if bounds else F.lit(True)


def has_all(column: str, values: Sequence[str]) -> Column:
    return F.size(F.array_except(any_of(values), F.col(column))) == 0


def filters(f: Filters) -> Column:
    """All filters of a request. Without a list of statuses, hidden and deleted rows stay out; an empty list is no filter.
    Category ids keep their case, everything else is folded."""
    parts = []
    if v := _folded(f.entity_types):
        parts.append(F.col("entity_type").isin(v))
    if v := list(dict.fromkeys(x.strip() for x in f.category_ids if x.strip())):
        parts.append(F.col("category_id").isin(v))
    parts.append(F.col("status").isin(v) if (v := _folded(f.statuses)) else ~F.col("status").isin("hidden", "deleted"))
    if v := _folded(f.tags_any):
        parts.append(F.arrays_overlap("tags", any_of(v)))
    if v := _folded(f.tags_all):
        parts.append(has_all("tags", v))
    if v := _folded(f.platforms):
        parts.append(F.col("platform").isin(v))
    for name in ("view_count", "like_count", "download_count", "created_at", "updated_at"):
        if getattr(f, name).bounds():
            parts.append(in_range(F.col(name), getattr(f, name)))
    if f.version.bounds():
        parts.append(versions_in_range(f.version))
    return _both(parts)
