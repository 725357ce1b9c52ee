"""Scores as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.operators.predicates import field_text
from skein.plans.config import Scoring
from skein.plans.textquery import TextQuery


def freshness(now: datetime, decay: float) -> Column:
    """exp(-days / decay) since the last change; 1 for times ahead of ``now``. ``now`` is fixed for all pages of a search."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("sort_time")) / 86_400_000_000
    return F.exp(-F.greatest(F.lit(0.0), age) / decay)


def popularity(s: Scoring) -> Column:
    """Weighted logarithms of the counters; negative ones count as 0. Doubles throughout, so no counter overflows."""
    part = lambda c, w: F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) * w
    return part("view_count", s.view_count_weight) + part("download_count", s.download_count_weight) + part("like_count", s.like_count_weight) + part("weight", 0.05)


def field_weights(s: Scoring) -> dict[str, float]:
    """Weights of the four token columns as shares of their sum."""
    w = {"tok_a": s.title_weight, "tok_b": s.tags_weight, "tok_c": s.keywords_weight, "tok_d": s.payload_weight}
    total = sum(w.values())
    return {k: v / (total if total > 0 else 1.0) for k, v in w.items()}


def text_rank(q: TextQuery, s: Scoring) -> Column:
    """Cover density, squashed to r / (r + 1).

    One group of single tokens: every occurrence is a cover of its own, so r is the weighted number of occurrences, in
    plain expressions. Otherwise the covers are found by _density over the token columns, in array expressions.
    """
    if not q.groups:
        return F.lit(0.0)
    weights = field_weights(s)
    if len(q.groups) == 1 and all(len(a) == 1 for a in q.groups[0]):
        words = [a[0] for a in q.groups[0]]
        r = sum((F.size(F.filter(c, lambda t: t.isin(words))) * F.lit(w) for c, w in weights.items()), F.lit(0.0))
    else:
        r = _density([sorted({t for a in g for t in a}) for g in q.groups], weights)
    return r / (r + 1)


def _density(groups: list[list[str]], weights: dict[str, float]) -> Column:
    """Sum over minimal covers: stretches that hold a token of every group and contain no shorter such stretch. A cover is
    worth the harmonic mean of its tokens' weights over one plus the number of other tokens in it (Clarke, Cormack and
    Tudhope 1999); one with a token of weight 0 is worth nothing.

    All in array expressions: the tokens of the fields in a row are cut down to those of some group, with place, weight and
    the groups as bits; going over them, the last place of each group is kept, and where the earliest of these moves
    on a minimal cover ends.
    """
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    bits = " | ".join(f"IF(t IN ({', '.join(map(quoted, g))}), {1 << i}L, 0L)" for i, g in enumerate(groups))
    ends = [" + ".join(f"size({c})" for c in list(weights)[: k + 1]) for k in range(len(weights))]
    weight = "CASE " + " ".join(f"WHEN i < {e} THEN {float(w)!r}D" for e, w in zip(ends, weights.values())) + " END"
    hits = f"filter(transform(concat({', '.join(weights)}), (t, i) -> struct(i AS p, {bits} AS g, {weight} AS w)), x -> x.g != 0)"
    n = len(groups)
    last = f"transform(a.last, (l, k) -> IF(shiftright(h.g, k) & 1 = 1, h.i, l))"
    cover = "slice(hits, array_min(n.last) + 1, h.i - array_min(n.last) + 1)"
    worth = f"transform(array({cover}), s -> IF(exists(s, x -> x.w <= 0), 0D, size(s) / aggregate(s, 0D, (r, x) -> r + 1 / x.w) / (element_at(s, -1).p - s[0].p + 2 - size(s))))[0]"
    step = f"transform(array(struct({last} AS last)), n -> struct(n.last AS last, greatest(a.lo, array_min(n.last)) AS lo, a.total + IF(array_min(n.last) > a.lo, {worth}, 0D) AS total))[0]"
    walk = f"aggregate(transform(hits, (x, i) -> struct(x.g AS g, i AS i)), struct(array_repeat(-1, {n}) AS last, -1 AS lo, 0D AS total), (a, h) -> {step}, a -> a.total)"
    return F.expr(f"transform(array({hits}), hits -> {walk})[0]")


def boost(q: TextQuery) -> Column:
    """What literal mentions of asked versions and loaders add."""
    text = F.lower(field_text("_all"))
    parts = [F.when(F.instr(text, word) > 0, value).otherwise(0.0) for word, value in sorted(q.boosts().items())]
    return sum(parts, F.lit(0.0))


def score(sort: str, q: TextQuery, s: Scoring, now: datetime) -> Column:
    """latest: 0 (only time orders); popular: popularity and freshness; relevance: text, popularity and freshness."""
    if sort == "latest":
        return F.lit(0.0)
    rest = popularity(s) * s.popularity_score_weight + freshness(now, s.time_decay_factor) * s.freshness_score_weight
    return rest if sort == "popular" else (text_rank(q, s) + boost(q)) * s.text_score_weight + rest


def matched_fields(q: TextQuery, more: list[str] = []) -> Column:
    """Names of the fields whose lowered text contains any expanded term or the whole query, as substrings."""
    words = list(dict.fromkeys([*(q.expanded or q.terms), *more]))
    needles = words + ([q.normalized] if q.normalized and words else [])
    text = {"title": F.coalesce("title", F.lit("")), "tags": F.array_join("tags", " "), "keywords": F.array_join("keywords", " "), "payload": F.col("payload_text")}

    def hit(c: Column) -> Column:
        found = F.lit(False)
        for w in needles:
            found = found | F.contains(F.lower(c), F.lit(w))
        return found

    return F.filter(F.array(*[F.when(hit(c), n) for n, c in text.items()]), lambda x: x.isNotNull())


def substring_score(q: TextQuery, s: Scoring, now: datetime) -> Column:
    """The older score without an index of tokens: shares of terms that a field contains as substrings (the whole query
    counts one and a half), weighted by field, plus boosts, popularity and freshness of updated_at; six digits."""
    terms = q.expanded or q.terms
    text = {"title": F.coalesce("title", F.lit("")), "tags": F.array_join("tags", " "), "keywords": F.array_join("keywords", " "), "payload": F.col("payload_text")}
    weights = {"title": s.title_weight, "tags": s.tags_weight, "keywords": s.keywords_weight, "payload": s.payload_weight}

    def share(c: Column) -> Column:
        low = F.lower(F.btrim(c))
        found = sum((F.when(F.contains(low, F.lit(t)), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))
        whole = F.when(F.contains(low, F.lit(q.normalized)), 1.5).otherwise(0.0) if q.normalized else F.lit(0.0)
        return (found + whole) / (len(terms) + 1)

    words = sum((share(c) * weights[k] for k, c in text.items()), F.lit(0.0)) if terms else F.lit(0.0)
    fresh = F.when(F.col("updated_at").isNull(), 0.0).otherwise(F.exp(-F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("updated_at")) / 86_400_000_000) / s.time_decay_factor))
    return F.round((words + boost(q)) * s.text_score_weight + popularity(s) * s.popularity_score_weight + fresh * s.freshness_score_weight, 6)
